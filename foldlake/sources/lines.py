"""Text files as lines, and what is found in folders and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tars

LINES = "source string, line_no int, line string"


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """LINES of every file under ``path`` (folders are searched) whose name matches ``glob``."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    files = files.select(stem(F.col("_metadata.file_path")).alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))
    return files


def resolve(spark: SparkSession, paths: list[str], lists: list[str], glob: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing) paths: the files under ``paths`` that match ``glob``, and the entries of list files that none of
    them has. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(paths).select("path")
    if not lists:
        return found, found.limit(0)
    named = spark.read.text(lists).select(F.trim("value").alias("entry")).filter("entry <> ''").distinct()
    name = F.element_at(F.split("path", "/"), -1)
    return found, named.join(found.select(name.alias("entry")).distinct(), "entry", "left_anti").withColumnRenamed("entry", "path")


def existing_ids(spark: SparkSession, path: str, glob: str = "*.pdb", pattern: str = r"([^/]+?)(\.[A-Za-z0-9]+)?$") -> DataFrame:
    """Ids of the files under ``path``, by the first group of ``pattern`` in their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", pattern, 1).alias("id")).distinct()


def read_tar(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """archive, name, content of the members of the tar files under ``path`` whose names end in ``suffix``. What is no archive gives
    one row without name."""
    return tars.contents(tars.members(spark, path, suffix))


def split_tar_lines(members: DataFrame) -> DataFrame:
    return members.filter(F.col("name").isNotNull()).select(stem(F.col("name")).alias("source"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\r?\n")).alias("line_no", "line"))


def detect_format(lines: DataFrame) -> DataFrame:
    """source, format: cif where a line has loop_ in any case, else pdb where a later line starts with ATOM, else unknown."""
    f = lines.groupBy("source").agg(F.max(F.lower("line").contains("loop_")).alias("cif"), F.max(F.col("line").startswith("ATOM ") & (F.col("line_no") > 0)).alias("pdb"))
    return f.select("source", F.when(F.col("cif"), "cif").when(F.col("pdb"), "pdb").otherwise("unknown").alias("format"))


def ordered(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("line_no")
