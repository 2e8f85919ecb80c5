"""Files of a folder as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """path, filename, length and content of the files of a folder whose names match; content is
    only read where it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")
