"""Sealed datasets: Parquet shards with a manifest of rows and digests, written once and checked on reading."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import files

VERSION = 1


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete or not there: a temporary name, then a rename over the old one."""
    jvm = spark.sparkContext._jvm
    p, fs = files.hadoop_path(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def seal(rows: DataFrame, spark: SparkSession, path: str, group: str | None = None, shards: int | None = None) -> dict:
    """Writes rows as zstd Parquet with a manifest; refuses a path that is there.

    All is written to a private folder that is renamed at the end. group: rows of one value stay in one shard.
    The driver gets a row for each shard.
    """
    jvm = spark.sparkContext._jvm
    target, fs = files.hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path}.{uuid.uuid4().hex}.tmp"
    if group:
        rows = rows.repartitionByRange(shards, group) if shards else rows.repartitionByRange(group)
        rows = rows.sortWithinPartitions(group)
    rows.write.option("compression", "zstd").parquet(f"{stage}/data")
    counts = {r.f.rsplit("/", 1)[-1]: r.n for r in spark.read.parquet(f"{stage}/data").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    parts = [{"path": "data/" + r.path.rsplit("/", 1)[-1], "sha256": r.sha256} for r in files.digests(spark, f"{stage}/data").collect() if r.path.endswith(".parquet")]
    for p in parts:
        p["rows"] = counts.get(p["path"].rsplit("/", 1)[-1], 0)
    manifest = {"version": VERSION, "schema": rows.schema.simpleString(), "shards": sorted(parts, key=lambda p: p["path"]), "rows": sum(p["rows"] for p in parts)}
    write_text(spark, f"{stage}/manifest.json", canonical(manifest))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(stage), target):
        raise OSError(f"cannot rename to {path}")
    return manifest


def unseal(spark: SparkSession, path: str) -> DataFrame:
    """The rows, if version, schema, shards, digests and total are as the manifest says."""
    m = json.loads(read_text(spark, f"{path}/manifest.json"))
    got = {"data/" + r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.digests(spark, f"{path}/data").collect() if r.path.endswith(".parquet")}
    want = {p["path"]: p["sha256"] for p in m["shards"]}
    if m.get("version") != VERSION or got != want or sum(p["rows"] for p in m["shards"]) != m["rows"]:
        raise ValueError("the shards are not those of the manifest")
    rows = spark.read.parquet(f"{path}/data")
    if rows.schema.simpleString() != m["schema"] or rows.count() != m["rows"]:
        raise ValueError("the rows are not those of the manifest")
    return rows


def write_canonical_lines(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in one order, keys sorted at every level (as Spark's Variant writes them)."""
    line = F.to_json(F.parse_json(F.to_json(F.struct(*rows.columns))))
    rows.orderBy(*order).select(line.alias("value")).write.text(path)


def write_tagged(rows: DataFrame, path: str, tag: str, wanted: list[str]) -> list[str]:
    """One pass over rows, a folder for each tag; gives the wanted tags that had rows."""
    rows.where(F.col(tag).isin(wanted)).write.partitionBy(tag).parquet(path)
    return sorted(r[0] for r in rows.sparkSession.read.parquet(path).select(tag).distinct().collect())
