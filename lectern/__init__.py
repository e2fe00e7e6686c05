"""Lectern: narration-text and quality-control analytics as Spark DataFrame jobs."""
