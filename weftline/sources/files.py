"""Reading row files by path: one file or a folder of them, JSON lines or Parquet, whole or a slice of rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators import select

SLICE = re.compile(r"^(?P<path>.*)@\[(?P<start>-?\d*):(?P<end>-?\d*)\]$")


def split_path(path: str) -> tuple[str, int | None, int | None]:
    """path@[start:end] to its parts; without a slice both bounds are None."""
    m = SLICE.match(path)
    if not m:
        return path, None, None
    number = lambda s: int(s) if s else None
    return m["path"], number(m["start"]), number(m["end"])


def hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listing(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The path itself, or all files below it with one of the suffixes, sorted by full path.

    A folder that has a suffix itself is the output of a Spark job, and all its part files count."""
    p, fs = hadoop_path(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    if fs.getFileStatus(p).isFile():
        return [path]
    found, it, output = [], fs.listFiles(p, True), path.endswith(suffixes)
    while it.hasNext():
        name = it.next().getPath().toString()
        if (output or name.endswith(suffixes)) and not re.search(r"/[._][^/]*$", name):
            found.append(name)
    return sorted(found)


def read_rows(spark: SparkSession, path: str, schema: StructType | str | None = None, ordered: bool = False) -> DataFrame:
    """Rows of .parquet or .jsonl files, with a schema if given; another suffix is an error.

    ordered, and any slice, adds the rows' places (`ord`) by file path and place in the file; a slice is of all
    files' rows together. Spark gives no place in a file, so `_metadata.row_index` serves for Parquet and, for
    JSON lines, which have none, the text is read whole and its lines are numbered.
    """
    path, start, end = split_path(path)
    files = listing(spark, path, (".parquet", ".jsonl"))
    kinds = {path.rsplit(".", 1)[-1]} if path.endswith((".parquet", ".jsonl")) else {f.rsplit(".", 1)[-1] for f in files}
    if kinds - {"parquet", "jsonl"} or len(kinds) > 1 or not files:
        raise ValueError(f"one kind of .parquet or .jsonl files is needed, found {sorted(kinds)}")
    kind, placed = kinds.pop(), ordered or start is not None or end is not None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "parquet":
        rows = reader.parquet(*files)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i")) if placed else rows
    elif not placed:
        return reader.json(files)
    else:
        lines = spark.read.text(files, wholetext=True).select(F.input_file_name().alias("_f"), F.posexplode(F.split("value", "\n", -1)).alias("_i", "line")).where("trim(line) <> ''")
        if schema is None:
            schema = spark.read.json(files).schema
        rows = lines.select(F.from_json("line", schema).alias("r"), "_f", F.col("_i").cast("long").alias("_i")).select("r.*", "_f", "_i")
    if not placed:
        return rows
    rows = select.ordinals(rows, ["_f", "_i"]).drop("_f", "_i")
    if start is None and end is None:
        return rows
    a, b = select.bounds(start, end, rows.count())
    return rows.where((F.col("ord") >= a) & (F.col("ord") < b))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): JSON lines, or else the elements of one JSON array, per file; a file that is neither gives no rows."""
    whole = spark.read.text(listing(spark, path, (".json", ".jsonl")), wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.filter(F.split("value", "\n", -1), lambda x: F.trim(x) != "")
    parsed = F.transform(lines, F.try_parse_json)
    array = F.from_json("value", "array<variant>")
    values = F.when(F.forall(parsed, lambda v: v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")), parsed).otherwise(array)
    return whole.select("file", F.explode(values).alias("value"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below a path; the bytes are read by the executors, a file to a row."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return b.select("path", "length", F.sha2("content", 256).alias("sha256"))


def read_locked(spark: SparkSession, path: str, lock: dict[str, str], id_col: str, ids: list, keep) -> DataFrame:
    """Rows where `keep` holds, sorted by id, if every file has its locked digest and the ids are the locked ones."""
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in digests(spark, path).collect()}
    wrong = sorted(n for n, h in lock.items() if got.get(n) != h)
    if wrong:
        raise ValueError(f"digests differ: {wrong}")
    rows = read_rows(spark, path).where(keep).orderBy(id_col)
    if [r[0] for r in rows.select(id_col).collect()] != list(ids):
        raise ValueError("the ids are not the locked ones")
    return rows
