"""Readers and sinks of files: whole texts, JSON documents, inventories, concat lists, audio.

Every reader is one of Spark's own, so that paths may lie in any store it reads, and a file is one row at most."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import riff

#: Kind of a file by its suffix; anything else is "other".
KINDS = {"wav": "audio", "mp3": "audio", "json": "data", "jsonl": "data", "txt": "text", "md": "text"}
EDGE_S = 0.02
AUDIO = "path string, seconds double, rate int, peak double, rms double, head_peak double, tail_peak double, error string"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, text_sha) of each file as a whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.sha2("value", 256).alias("text_sha"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file (or element of its array). The schema is given, so files aren't read twice; what doesn't fit is null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _files(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def inventory(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, bytes, modified, suffix, kind) of the files below `path`; their contents aren't read."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return _files(spark, path, pattern).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), suffix.alias("suffix"), F.coalesce(F.try_element_at(kinds, suffix), F.lit("other")).alias("kind"))


def digests(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, bytes, sha256) of each file. A file of over 2 GB is no Spark row, and fails the read."""
    return _files(spark, path, pattern).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def concat_list(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, file) of the lines `file '...'` of list files. Blank lines and comments are skipped; any other line fails
    the job when it is read. A list is one row, so that its order is that of the file."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    file = F.regexp_extract("line", r"^\s*file\s+'(.+)'\s*$", 1)
    checked = F.when(file != "", file).otherwise(F.raise_error(F.concat(F.lit("no concat line: "), F.col("line"))))
    return lines.select("path", (F.col("at") + 1).alias("position"), checked.alias("file"))


def _levels(path: str) -> tuple:
    """Levels of one file, read in blocks from any store that Arrow reads."""
    try:
        system, where = fs.FileSystem.from_uri(path)
        with system.open_input_stream(where) as f:
            form, blocks = riff.walk(f)
            levels = riff.Levels(int(form.rate * EDGE_S))
            for x in blocks:
                levels.add(x)
    except (riff.RiffError, OSError, pa.ArrowException) as e:
        return path, None, None, None, None, None, None, str(e) or type(e).__name__
    return path, levels.n / form.rate, form.rate, levels.peak, levels.rms, levels.head, levels.tail_peak, None


def audio_levels(spark: SparkSession, path: str) -> DataFrame:
    """AUDIO of each WAV file: length, peak, RMS and peaks of the first and last 20 ms; `error` where it can't be decoded. Spark lists the
    files and deals them out; a task reads a file block by block and holds none as a whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_levels(p) for p in batch["path"]], columns=[c.split()[0] for c in AUDIO.split(", ")])

    found = _files(ship(spark), path, "*.wav").select("path")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, AUDIO)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """A JSON object a line, null fields included."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_report(rows: DataFrame, path: str, line: Column, order: list[str]) -> None:
    """A line of text a row, in order within and between part files."""
    rows.sort(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def write_manifest(units: DataFrame, path: str, version: str) -> None:
    """A JSON document for each text (`path`, `text_sha`): its units in order, and the version of the rules that made them. Units are
    columns `ordinal` and whatever else there is."""
    own = [c for c in units.columns if c not in ("path", "text_sha")]
    rows = units.groupBy("path", "text_sha").agg(F.array_sort(F.collect_list(F.struct("ordinal", *(c for c in own if c != "ordinal")))).alias("units"))
    rows.select(F.lit(version).alias("version"), F.col("path").alias("source"), "text_sha", F.size("units").alias("n_units"), "units").write.mode("overwrite").json(path)
