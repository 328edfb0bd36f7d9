"""Readers and writers for record files, nested results, sectioned text and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sections that an inventory counts.
COUNTED = ["JUNCTIONS", "RESERVOIRS", "TANKS", "PIPES", "PUMPS", "VALVES"]


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Record files of all seeds below a path as one frame; only the named columns are read."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df.select(*columns) if columns else df


def write_records(df: DataFrame, path: str, by: tuple[str, ...] = ("seed", "network_id")) -> None:
    """One folder per seed and network; readers see whole files only."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def read_csv_records(spark: SparkSession, path: str, schema: str, arms: list[str] | None = None, networks: list[str] | None = None) -> DataFrame:
    """CSV records of the schema (DDL) filtered by arm and network; what isn't a number reads as null."""
    kind = T.StructType.fromDDL(schema)
    raw = spark.read.option("header", True).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in kind])).csv(path)
    df = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kind])
    for column, values in (("arm", arms), ("network_id", networks)):
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


def write_csv_gz(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def read_results_json(spark: SparkSession, path: str, depth: int = 3) -> DataFrame:
    """(file, result): nested result files, `depth` levels of names above their numbers."""
    kind: T.DataType = T.DoubleType()
    for _ in range(depth):
        kind = T.MapType(T.StringType(), kind)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", kind).alias("result"))


def flatten_results(df: DataFrame, names: list[str]) -> DataFrame:
    """(file, *names, value): a row per number of nested result maps; missing values and empty maps go."""
    now, kept = df.select("file", F.col("result").alias("__m")), ["file"]
    for name in names:
        now = now.select(*kept, F.explode("__m").alias(name, "__m"))
        kept.append(name)
    return now.where("__m is not null").select(*kept, F.col("__m").alias("value"))


def section_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, pos, section, line) of text files with [SECTION] headers: comments after ; and blanks go, headers are
    upper-cased, repeated sections merge by name, lines before the first header are left out."""
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw"))
    clean = text.withColumn("line", F.trim(F.regexp_replace("raw", ";.*$", ""))).where("line <> ''")
    head = F.when(F.col("line").rlike(r"^\[.*\]$"), F.upper(F.trim(F.regexp_extract("line", r"^\[(.*)\]$", 1))))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return clean.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(w)).where("head is null and section is not null").select("file", "pos", "section", "line")


def section_options(lines: DataFrame) -> DataFrame:
    """(file, key, value) of the OPTIONS lines: the last word is the value, those before it the upper-cased key; the last line wins."""
    words = lines.where("section = 'OPTIONS'").withColumn("w", F.split("line", r"\s+")).where(F.size("w") >= 2)
    kv = words.select("file", "pos", F.upper(F.array_join(F.slice("w", 1, F.size("w") - 1), " ")).alias("key"), F.element_at("w", -1).alias("value"))
    return kv.groupBy("file", "key").agg(F.max_by("value", "pos").alias("value"))


def section_inventory(lines: DataFrame) -> DataFrame:
    """(file, sections, counts of six kinds, units, headloss) of each file, by path."""
    counts = [F.count_if(F.col("section") == s).alias(s.lower()) for s in COUNTED]
    base = lines.groupBy("file").agg(F.sort_array(F.collect_set("section")).alias("sections"), *counts)
    o = section_options(lines).groupBy("file").agg(F.max(F.when(F.col("key") == "UNITS", F.col("value"))).alias("units"), F.max(F.when(F.col("key") == "HEADLOSS", F.col("value"))).alias("headloss"))
    return base.join(o, "file", "left").orderBy("file")


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def discover_files(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """(path): distinct files below root that match a pattern, sorted."""
    out = None
    for pattern in patterns:
        one = _files(spark, root, pattern).select("path")
        out = one if out is None else out.union(one)
    return out.distinct().orderBy("path")


def file_provenance(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, sha256, size, mtime) of every file below root."""
    return _files(spark, root, pattern).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def extract_paths(df: DataFrame, text: str, existing: DataFrame | None = None) -> DataFrame:
    """(path), distinct and sorted: words of the text that end in .inp in any case, without quotes around them; with an
    inventory (`existing`, column path) only those that are in it."""
    found = df.select(F.explode(F.regexp_extract_all(text, F.lit(r"""(?i)[^\s"';,]+\.inp"""), F.lit(0))).alias("path")).distinct()
    return (found if existing is None else found.join(existing.select("path"), "path", "left_semi")).orderBy("path")
