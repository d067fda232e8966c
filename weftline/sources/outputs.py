"""Writing what runs leave behind: scored shards, dumps of rollouts and training rows, metrics, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import files, sealed


def score_shards(spark: SparkSession, source: str, target: str, score: Callable[[DataFrame], DataFrame]) -> list[str]:
    """Scores the Parquet files of a folder into a folder of target each; gives the names of those that were to be done.

    Files whose folder is there with Spark's mark of success are done. The others are one job, written beside and then
    moved, so a run that ends early leaves whole shards alone.
    """
    names = [f.rsplit("/", 1)[-1] for f in files.listing(spark, source, (".parquet",))]
    jvm = spark.sparkContext._jvm
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    todo = [n for n in names if not fs.exists(path(f"{target}/shard={n}"))]
    if not todo:
        return []
    rows = spark.read.parquet(*[f"{source}/{n}" for n in todo]).withColumn("shard", F.col("_metadata.file_name"))
    stage = f"{target}.tmp"
    score(rows).write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(stage)
    fs.mkdirs(path(target))
    for n in todo:
        if fs.exists(path(f"{stage}/shard={n}")):  # a file may have no rows
            fs.rename(path(f"{stage}/shard={n}"), path(f"{target}/shard={n}"))
        else:
            fs.mkdirs(path(f"{target}/shard={n}"))
    fs.delete(path(stage), True)
    return todo


def dump(rows: DataFrame, path: str, *by: str) -> None:
    """Rows by rollout, or by rollout and rank, as folders; a rollout that is dumped again replaces its folder."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_metrics(spark: SparkSession, path: str, step_key: str, step: int, metrics: dict[str, float]) -> None:
    """Scalars of one step, appended as rows (step_key, step, name, value)."""
    rows = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(float(v)).alias("value")) for k, v in sorted(metrics.items())])).alias("m"))
    rows.select(F.lit(step_key).alias("step_key"), F.lit(step).cast("long").alias("step"), "m.name", "m.value").write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row for each step and name; of several the last written does not count more, so they must not differ."""
    return spark.read.parquet(path).distinct()


def cell(value) -> str:
    if isinstance(value, float):
        return f"{value:.4f}".rstrip("0").rstrip(".")
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(names: list[str], rows: list[tuple]) -> str:
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def markdown(title: str, sections: list[tuple[str, DataFrame | str]], most: int = 1000) -> str:
    """A report: a heading for each section, a paragraph or a table of at most `most` rows, which a report bounds anyway."""
    out = [f"# {title}"]
    for name, body in sections:
        if isinstance(body, DataFrame):
            rows = body.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows")
            body = markdown_table(body.columns, [tuple(r) for r in rows])
        out.append(f"## {name}\n\n{body}")
    return "\n\n".join(out) + "\n"


def write_report(spark: SparkSession, path: str, title: str, sections: list[tuple[str, DataFrame | str]]) -> None:
    sealed.write_text(spark, path, markdown(title, sections))


def repeated_manifest(spark: SparkSession, path: str, total: int) -> DataFrame:
    """(cycle, place, path, sha256, rows): a sealed data set's shards again and again until they hold `total` rows.

    Cycles name the same files, whose bytes are there once.
    """
    import json

    shards = json.loads(sealed.read_text(spark, f"{path}/manifest.json"))["shards"]
    once, out, have, cycle = sum(s["rows"] for s in shards), [], 0, 0
    if not once:
        raise ValueError("the shards have no rows")
    while have < total:
        for place, s in enumerate(shards):
            if have >= total:
                break
            out.append((cycle, place, s["path"], s["sha256"], s["rows"]))
            have += s["rows"]
        cycle += 1
    return spark.createDataFrame(out, "cycle long, place long, path string, sha256 string, rows long")
