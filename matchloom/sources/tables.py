"""Scans, sinks and materialised stages."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import json_text


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """Any file format Spark reads; CSV with a header by default and never with an inferred schema."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        options = {"header": "true"} | options
    if schema:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """A stage output; complete iff Spark's success marker is there."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a completed stage output lies at the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def materialize(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Reads the table at the path, or makes and writes it first."""
    if not exists(spark, path):
        write_table(make(), path)
    return spark.read.parquet(path)


class Stages:
    """Outputs of a run's iterations: ``<base>/<stage>/<iteration>``; a run resumes behind the last complete one."""

    def __init__(self, spark: SparkSession, base: str, parts: tuple[str, ...] = ("preds", "edges", "metrics")):
        self.spark, self.base, self.parts = spark, base.rstrip("/"), parts

    def path(self, part: str, iteration: int) -> str:
        return f"{self.base}/{part}/{iteration}"

    def done(self, iteration: int) -> bool:
        """An iteration is done iff all its parts are complete."""
        return all(exists(self.spark, self.path(p, iteration)) for p in self.parts)

    def next_iteration(self, last: int) -> int:
        """The first iteration up to ``last`` + 1 that is not done."""
        return next((i for i in range(last + 1) if not self.done(i)), last + 1)


def records_from_json(spark: SparkSession, path: str, title_key: str = "<page title>") -> DataFrame:
    """``(spec_id, page_title, text)`` of a folder ``<site>/<n>.json`` with one object per file."""
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    title, text = json_text(F.col("value"), title_key)
    spec = F.concat(F.regexp_extract("file", r"([^/]+)/([^/]+)\.json$", 1), F.lit("//"), F.regexp_extract("file", r"([^/]+)/([^/]+)\.json$", 2))
    return raw.select(spec.alias("spec_id"), title.alias("page_title"), text.alias("text"))


def pair_ids(pairs: DataFrame) -> DataFrame:
    """Distinct ids on either side of a pair table; null ends are left out."""
    return pairs.select(F.explode(F.array("lid", "rid")).alias("id")).where("id is not null").distinct()


def records_in_pairs(records: DataFrame, pairs: DataFrame, only: Column | None = None) -> DataFrame:
    """Records that occur in a pair (of those fulfilling ``only``); each once per its own row."""
    return records.join(pair_ids(pairs if only is None else pairs.where(only)), "id", "left_semi")


def union_tables(a: DataFrame, b: DataFrame | None, seed: int | None = None, key: str = "id") -> DataFrame:
    """One or two tables together; with a seed, sorted by a hash of the key instead of a shuffle by chance."""
    u = a if b is None else a.unionByName(b, allowMissingColumns=True)
    return u if seed is None else u.orderBy(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed)))), key)


def adjacency(pairs: DataFrame) -> DataFrame:
    """``(lid, rids)``: partners of every left id, sorted, each once."""
    return pairs.where("lid is not null and rid is not null").groupBy("lid").agg(F.array_sort(F.collect_set("rid")).alias("rids"))


def run_path(base: str) -> str:
    """A fresh folder of one run below the base."""
    return f"{base.rstrip('/')}/{uuid.uuid4().hex[:12]}"
