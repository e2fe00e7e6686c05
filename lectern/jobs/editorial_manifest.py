"""spark-submit entry: reads texts, one a file, and writes the manifest of their reading units.

    spark-submit -m lectern.jobs.editorial_manifest TEXTS MANIFEST"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans.segments import reading_units
from ..sources import files

VERSION = "reading-units-1"


def run(spark: SparkSession, texts: str, manifest: str) -> None:
    units = reading_units(files.texts(spark, texts), ["path", "text_sha"], "text")
    files.write_manifest(units.withColumn("ordinal", F.col("k")).drop("k"), manifest, VERSION)


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), *sys.argv[1:3])
