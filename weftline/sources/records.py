"""Reading what has a shape of its own: checked sources, benchmark folders, trial records, evaluation settings."""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import tools
from weftline.operators import select
from weftline.sources import files, sealed


def batched(rows: DataFrame, size: int) -> DataFrame:
    """rows with _batch, numbered within a task: `size` rows to each but a task's last, whatever Arrow batches come."""
    schema = rows.withColumn("_batch", F.lit(0).cast("long")).schema

    def get(batches: Iterable[pa.RecordBatch]):
        seen = 0
        for b in batches:
            number = pa.array([(seen + i) // size for i in range(b.num_rows)], pa.int64())
            seen += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, number], names=[*b.schema.names, "_batch"])

    return rows.mapInArrow(get, schema)


def content_hash(rows: DataFrame, order: list[str], chunk: int = 1000) -> str:
    """One digest of all rows in order: of each row as JSON, then of `chunk` digests at a time, up to one."""
    level = select.ordinals(rows.select(*order, F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256).alias("_h")), [*order, "_h"], "_ord").select("_ord", "_h")
    n = level.count()
    if not n:
        return level.sparkSession.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_h"))), lambda x: x["_h"]), "")
        level = level.groupBy(F.floor(F.col("_ord") / chunk).alias("_ord")).agg(F.sha2(joined, 256).alias("_h"))
        n = -(-n // chunk)
        if n == 1:
            return level.first()["_h"]


def checked(rows: DataFrame, order: list[str], expected: int, limit: int | None = None) -> tuple[DataFrame, dict]:
    """A source's rows if it has as many as expected, with its digest; a limit counts only after the check."""
    n = rows.count()
    if n != expected:
        raise ValueError(f"{expected} rows expected, {n} found")
    found = {"rows": n, "content_hash": content_hash(rows, order)}
    return (rows if limit is None else rows.orderBy(*order).limit(limit)), found


def manifest_prefix(spark: SparkSession, path: str, rows: int, chunk: int) -> DataFrame:
    """The first rows of a sealed data set in the order of its manifest, with ord and the chunk that each belongs to."""
    manifest = json.loads(sealed.read_text(spark, f"{path}/manifest.json"))
    before, starts = 0, []
    for shard in manifest["shards"]:
        if before >= rows:
            break
        starts.append((shard["path"].rsplit("/", 1)[-1], before))
        before += shard["rows"]
    if not starts:
        return spark.read.parquet(f"{path}/data").limit(0).withColumns({"ord": F.lit(0).cast("long"), "chunk": F.lit(0).cast("long")})
    start = F.element_at(F.create_map(*[F.lit(x) for s in starts for x in s]), F.col("_metadata.file_name"))
    read = spark.read.parquet(*[f"{path}/data/{n}" for n, _ in starts])
    out = read.select("*", (start + F.col("_metadata.row_index")).alias("ord")).where(F.col("ord") < rows)
    return out.withColumn("chunk", F.floor(F.col("ord") / chunk))


def benchmark_entries(name: str, text: str, docs: dict[str, list[dict]]) -> tuple[list[dict], str | None]:
    """A file's entries, or why it is skipped.

    An entry's functions are its own, or those of its classes without the ones it leaves out; with a class that `docs`
    does not have they are not known, and the signature is null.
    """
    try:
        rows = json.loads(text)
        rows = rows if isinstance(rows, list) else [rows]
    except ValueError:
        try:
            rows = [json.loads(x) for x in text.splitlines() if x.strip()]
        except ValueError:
            rows = None
    if rows is None or not all(isinstance(r, dict) and "question" in r for r in rows):
        lists = bool(rows) and all(isinstance(r, dict) and all(isinstance(v, list) for v in r.values()) for r in rows)
        return [], "no question entries" if lists else "unrecognized entry format"
    out = []
    for r in rows:
        functions = r.get("function")
        classes = r.get("involved_classes")
        if functions is None and classes and all(c in docs for c in classes):
            functions = [f for c in classes for f in docs[c] if f.get("name") not in r.get("excluded_function", [])]
        known = isinstance(functions, list)
        functions = [f for f in functions or [] if isinstance(f, dict)]
        turns = [m for turn in r["question"] for m in (turn if isinstance(turn, list) else [turn])]
        asked = [str(m.get("content", "")) for m in turns if isinstance(m, dict) and m.get("role") == "user" and str(m.get("content", "")).strip()]
        out.append({"id": str(r.get("id")), "file": name, "category": name.rsplit(".", 1)[0].split("_", 2)[-1], "user_messages": asked, "signature": tools.signature(functions) if known else None, "tool_names": sorted({str(f.get("name")) for f in functions})})
    return out, None


ENTRY = "id string, file string, category string, user_messages array<string>, signature string, tool_names array<string>, skipped string"


def benchmark_folder(spark: SparkSession, path: str, prefix: str, docs: dict[str, list[dict]]) -> DataFrame:
    """The entries of all files <prefix>*.json of a folder; a file without any gives one row that says why.

    A file is read whole by one task, as benchmark files are small; docs are sent to every task.
    """
    whole = spark.read.option("pathGlobFilter", f"{prefix}*.json").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")

    def get(batches):
        for b in batches:
            rows = []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, why = benchmark_entries(name, text, docs)
                rows += [{**r, "skipped": None} for r in found] or [{"id": None, "file": name, "category": None, "user_messages": None, "signature": None, "tool_names": None, "skipped": why or "no entries"}]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("id", pa.string()), ("file", pa.string()), ("category", pa.string()), ("user_messages", pa.list_(pa.string())), ("signature", pa.string()), ("tool_names", pa.list_(pa.string())), ("skipped", pa.string())]))

    return whole.mapInArrow(get, ENTRY)


def trial_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of trial<k>/<task>.json below a folder, with trial and trials (one more than the largest) and no result."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    rows = rows.withColumn("_p", F.col("_metadata.file_path")).withColumn("trial", F.regexp_extract("_p", r"/trial(\d+)/[^/]+$", 1))
    rows = rows.where("trial <> ''").withColumn("trial", F.col("trial").cast("int")).drop("_p", "result")
    return rows.crossJoin(F.broadcast(rows.agg((F.max("trial") + 1).alias("trials"))))  # one row


def evaluation_sets(config, defaults: dict, args: dict, fields: dict[str, tuple[str, ...]]) -> list[dict]:
    """One row for each data set of a list, or of a mapping by name; fields come from the set, the defaults or the arguments.

    fields: for each field the names under which it may be given, the first one found counts; a value of null is a value.
    A set without a name is an error, and so is anything but a list or a mapping.
    """
    if config is None:
        return []
    if isinstance(config, dict):
        sets = [{"name": n, **(c or {})} for n, c in config.items()]
    elif isinstance(config, list | tuple):
        sets = [dict(c or {}) for c in config]
        if any("name" not in c for c in sets):
            raise ValueError("a data set has no name")
    else:
        raise TypeError("data sets are a list or a mapping")

    def pick(c: dict, names: tuple[str, ...]):
        return next((source[n] for source in (c, defaults) for n in names if n in source), next((args[n] for n in names if n in args), None))

    return [{**c, **{f: pick(c, names) for f, names in fields.items()}} for c in sets]


def dated_problems(rows: DataFrame, start: str, tokens: Callable) -> DataFrame:
    """(id, tokens) of problems from a date on: of title, content and starter code, one under the other."""
    first = datetime.datetime.fromisoformat(start)
    text = F.concat_ws("\n", F.coalesce("question_title", F.lit("")), "question_content", F.coalesce("starter_code", F.lit("")))
    return rows.where(F.col("contest_date").cast("timestamp_ntz") >= F.lit(first).cast("timestamp_ntz")).select("id", tokens(text).alias("tokens"))


def release_files(release: str) -> list[str]:
    """The files that a release is made of; each release adds one."""
    n = {"release_v5": 5, "release_v6": 6}.get(release)
    if n is None:
        raise ValueError("no such release")
    return ["test.jsonl", *(f"test{i}.jsonl" for i in range(2, n + 1))]


def fixed_benchmark(rows: DataFrame, order: list[str], expected: int, template: str, problem: str, answer: str, most: int | None = None) -> DataFrame:
    """(problem_index, prompt, answer) of a benchmark with a fixed number of rows, or of the first ones after the check."""
    if (n := rows.count()) != expected:
        raise ValueError(f"{expected} problems expected, {n} found")
    placed = select.ordinals(rows, order, "problem_index")
    before, _, after = template.partition("{problem}")
    out = placed.select("problem_index", F.concat(F.lit(before), F.trim(problem), F.lit(after)).alias("prompt"), F.col(answer).cast("string").alias("answer"))
    return out if most is None else out.where(F.col("problem_index") < most)
