"""Sinks: keep-last upserts, split and byte-order-marked CSV, guarded write-back, reports and manifests."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fs(spark, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark, path: str) -> bool:
    fs, P = _fs(spark, path)
    return fs.exists(P(path))


def upsert_parquet(new: DataFrame, path: str, key: str, order: list[Column] | None = None) -> None:
    """Merge into a Parquet table, new rows winning; the old version stays until the new one is complete.

    order: which of several new rows with one key wins; all new ones beat the old.
    """
    spark = new.sparkSession
    tagged = new.withColumn("new_", F.lit(1))
    if exists(spark, path):
        tagged = spark.read.parquet(path).withColumn("new_", F.lit(0)).unionByName(tagged, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("new_").desc(), *(order or []))
    staging = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    tagged.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_", "new_").write.parquet(staging)
    fs, P = _fs(spark, path)
    old = f"{staging}-old"
    if fs.exists(P(path)):
        fs.rename(P(path), P(old))
    fs.rename(P(staging), P(path))
    fs.delete(P(old), True)


def as_csv_columns(d: DataFrame, columns: list[str], separator: str = " | ") -> DataFrame:
    """Fixed order; lists joined, booleans spelled, nulls empty; unknown columns after the known ones."""
    kinds = dict(d.dtypes)
    order = columns + [c for c in d.columns if c not in columns]

    def said(c: str) -> Column:
        if c not in kinds:
            return F.lit("")
        if kinds[c].startswith("array"):
            return F.array_join(F.col(c).cast("array<string>"), separator)
        if kinds[c] == "boolean":
            return F.when(F.col(c), "True").otherwise("False")
        return F.col(c).cast("string")

    return d.select(*[F.coalesce(said(c), F.lit("")).alias(c) for c in order])


def write_csv_bom(d: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files whose header starts with a byte-order mark, so that spreadsheets read them as UTF-8."""
    told = as_csv_columns(d, columns)
    first, *rest = told.columns
    told.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_split(d: DataFrame, path: str, by: str) -> None:
    """One folder per value of a column; the whole is their union."""
    d.write.mode("overwrite").partitionBy(by).parquet(path)


def write_back(original: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """original with some columns replaced by key; an error if the two have not the same number of rows."""
    a, b = original.count(), changes.count()
    if a != b:
        raise ValueError(f"{a} rows, but {b} changes")
    renamed = reduce(lambda x, c: x.withColumnRenamed(c, f"{c}_new"), columns, changes.select(*keys, *columns))
    out = original.join(renamed, keys, "left")
    return out.select(*[F.col(f"{c}_new").alias(c) if c in columns else F.col(c) for c in original.columns])


def write_json_lines(d: DataFrame, path: str) -> None:
    d.write.mode("append").json(path)


def markdown_table(d: DataFrame, title: str, limit: int = 200) -> str:
    """A small result as a Markdown table; a report, so it is cut at limit rows."""
    rows = d.limit(limit).collect()
    said = lambda v: "" if v is None else str(v)
    return "\n".join([f"## {title}", "", "| " + " | ".join(d.columns) + " |", "|" + "---|" * len(d.columns), *("| " + " | ".join(map(said, r)) + " |" for r in rows), ""])


def manifest(spark, name: str, counts: dict[str, int]) -> DataFrame:
    """One row: a run's name, id and counts as JSON."""
    return spark.createDataFrame([(name, uuid.uuid4().hex, json.dumps(counts, sort_keys=True))], "name string, run string, counts string")


def merge_section(document: str | None, section: str, metrics: dict) -> str:
    """A metrics document with one section replaced, the others kept."""
    told = json.loads(document) if document else {}
    told[section] = metrics
    return json.dumps(told, sort_keys=True, ensure_ascii=False)
