"""Sources and sinks, each written below the shared folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import select
from weftline.plans.common import shared_folder, table
from weftline.sources import files, outputs, records, sealed


def customers(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def one_row(s, ddl, *values):
    return s.createDataFrame([values], ddl)


def folder(s, d):
    """Files of nested folders, in order of their paths."""
    path = shared_folder(s, "nested")
    c = customers(s, d)
    c.where("c_custkey % 2 = 0").repartition(2).write.parquet(f"{path}/b/even")
    c.where("c_custkey % 2 = 1").repartition(2).write.parquet(f"{path}/a/odd")
    rows = files.read_rows(s, path, ordered=True)
    firsts = rows.groupBy((F.col("c_custkey") % 2).alias("odd")).agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.sum("c_custkey").alias("ids"))
    return firsts.select("odd", "n", (F.col("lo") == 0).alias("first"), "ids")


def shards(s, d):
    """Shards by name, as many as there are."""
    path = shared_folder(s, "shards")
    orders(s, d).repartition(3, "o_orderkey").write.parquet(path)
    names = files.listing(s, path, (".parquet",))
    return s.read.parquet(*names).agg(F.lit(len(names) <= 3).alias("few"), F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def projected(s, d):
    """Two columns of the file are read, no others."""
    rows = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    read = rows._jdf.queryExecution().executedPlan().toString()
    return rows.withColumn("only", F.lit("ReadSchema: struct<c_custkey" in read and "c_acctbal" not in read))


def batched(s, d):
    """Batches of 100 rows within a task; the last of a task may be shorter."""
    b = records.batched(orders(s, d).select("o_orderkey"), 100).withColumn("task", F.spark_partition_id())
    sizes = b.groupBy("task", "_batch").agg(F.count("*").alias("n"))
    last = sizes.groupBy("task").agg(F.max("_batch").alias("last"))
    whole = sizes.join(last, "task").where("_batch < last").agg(F.coalesce(F.bool_and(F.col("n") == 100), F.lit(True)).alias("whole"))
    return sizes.agg(F.sum("n").alias("n"), F.max("n").cast("long").alias("most")).crossJoin(F.broadcast(whole)).select("n", (F.col("most") <= 100).alias("bounded"), "whole")  # a row each


def checked(s, d):
    """A source with the right number of rows, its digest, and a limit after the check; another number is refused."""
    c = customers(s, d).select("c_custkey", "c_name")
    n = c.count()
    rows, found = records.checked(c, ["c_custkey"], n, 50)
    try:
        records.checked(c, ["c_custkey"], n + 1)
        refused = False
    except ValueError:
        refused = True
    return rows.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids")).select("n", "ids", F.lit(found["content_hash"]).alias("digest"), F.lit(refused).alias("refused"))


def json_documents(s, d):
    """JSON lines, one JSON array, and a file that is neither."""
    path = shared_folder(s, "documents")
    few = [r.asDict() for r in customers(s, d).where("c_custkey <= 20").orderBy("c_custkey").collect()]  # a fixed number
    sealed.write_text(s, f"{path}/lines.jsonl", "\n".join(json.dumps(r) for r in few))
    sealed.write_text(s, f"{path}/array.json", json.dumps(few[:7]))
    sealed.write_text(s, f"{path}/other.json", "no json")
    v = files.read_json_documents(s, path)
    return v.groupBy(F.element_at(F.split("file", "/"), -1).alias("file")).agg(F.count("*").alias("n"), F.sum(F.variant_get("value", "$.c_custkey", "bigint")).alias("ids"))


DOCS = {"Files": [{"name": "ls"}, {"name": "rm"}], "Mail": [{"name": "send"}]}


def benchmark(s, d):
    """Files with questions, and two that are skipped; functions of their own, of classes, or not known."""
    path = shared_folder(s, "benchmark")
    ask = lambda i, **more: {"id": i, "question": [[{"role": "user", "content": f"do {i}"}, {"role": "system", "content": "x"}], {"role": "user", "content": " "}], **more}
    rows = [ask("a", function=[{"name": "f"}]), ask("b", involved_classes=["Files", "Mail"], excluded_function=["rm"]), ask("c", involved_classes=["Else"]), ask("d", function=[])]
    sealed.write_text(s, f"{path}/BENCH_v1_multi_turn.json", "\n".join(map(json.dumps, rows)))
    sealed.write_text(s, f"{path}/BENCH_v1_simple.json", json.dumps(rows[:1]))
    sealed.write_text(s, f"{path}/BENCH_v1_index.json", json.dumps({"simple": ["a"]}))
    sealed.write_text(s, f"{path}/BENCH_v1_odd.json", "[1, 2]")
    sealed.write_text(s, f"{path}/other.json", "[]")
    e = records.benchmark_folder(s, path, "BENCH_", DOCS)
    return e.select("file", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce(F.array_join("user_messages", "|"), F.lit("")).alias("asked"), F.col("signature").isNotNull().alias("known"), F.coalesce(F.array_join("tool_names", ","), F.lit("")).alias("tools"), F.coalesce("skipped", F.lit("")).alias("skipped"))


BENCH = """SELECT * FROM (VALUES
('BENCH_v1_multi_turn.json', 'a', 'multi_turn', 'do a', true, 'f', ''), ('BENCH_v1_multi_turn.json', 'b', 'multi_turn', 'do b', true, 'ls,send', ''), ('BENCH_v1_multi_turn.json', 'c', 'multi_turn', 'do c', false, '', ''), ('BENCH_v1_multi_turn.json', 'd', 'multi_turn', 'do d', true, '', ''),
('BENCH_v1_simple.json', 'a', 'simple', 'do a', true, 'f', ''), ('BENCH_v1_index.json', '', '', '', false, '', 'no question entries'), ('BENCH_v1_odd.json', '', '', '', false, '', 'unrecognized entry format')) t(file, id, category, asked, known, tools, skipped)"""


def trials(s, d):
    """Records of two tasks and three trials, one of them missing, in folders by trial."""
    path = shared_folder(s, "trials")
    for t, name in ((0, "x"), (0, "y"), (2, "x")):
        sealed.write_text(s, f"{path}/lane/trial{t}/{name}.json", json.dumps({"task_id": name, "reward": t / 2, "result": {"long": "x" * 50}}, indent=1))
    sealed.write_text(s, f"{path}/lane/failures.json", "[]")
    return records.trial_records(s, path, "task_id string, reward double, result string").select("task_id", "reward", F.col("trial").cast("long").alias("trial"), F.col("trials").cast("long").alias("trials"))


def evaluation_sets(s, d):
    """Settings from a set, the defaults or the arguments; by list or by mapping."""
    fields = {"n": ("n", "n_samples"), "t": ("temperature",), "k": ("top_k",)}
    config = {"aime": {"n_samples": 4}, "math": None}
    a = records.evaluation_sets(config, {"temperature": 0.5}, {"top_k": 7, "n": 1}, fields)
    b = records.evaluation_sets([{"name": "code", "top_k": 9}], {}, {"n": 2}, fields)
    return s.createDataFrame([(r["name"], r["n"], r["t"], r["k"]) for r in a + b], "name string, n long, t double, k long")


def dated(s, d):
    """Orders as problems with a date, those from 1998 on."""
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("contest_date"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("Title A")).alias("question_title"), F.col("o_orderstatus").alias("question_content"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("def f(x):")).alias("starter_code"))
    return records.dated_problems(rows, "1998-01-01T00:00:00", T.norm_tokens).select("id", F.array_join("tokens", " ").alias("tokens"))


def releases(s, d):
    return s.createDataFrame([(r, i, f) for r in ("release_v5", "release_v6") for i, f in enumerate(records.release_files(r))], "release string, place long, file string")


def fixed(s, d):
    """A benchmark of 25 rows, its first 10 as prompts."""
    n = table(s, d, "nation").select("n_nationkey", F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("problem"), F.col("n_regionkey").alias("answer"))
    return records.fixed_benchmark(n, ["n_nationkey"], 25, "Solve: {problem}\nAnswer:", "problem", "answer", 10)


def generated(s, d):
    """What a model made, as a table that is there already."""
    path = shared_folder(s, "generated")
    customers(s, d).select("c_custkey", F.concat(F.lit("re: "), "c_name").alias("response")).write.parquet(path)
    return files.read_rows(s, path)


def prefix(s, d):
    """The first 250 rows of a sealed data set in chunks of 100."""
    path = shared_folder(s, "prefix")
    sealed.seal(orders(s, d), s, path, group="o_orderkey", shards=4)
    p = records.manifest_prefix(s, path, 250, 100)
    return p.groupBy("chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def atomic(s, d):
    """A file that is written over has the new text whole, and nothing is left beside it."""
    path = shared_folder(s, "atomic")
    sealed.write_text(s, f"{path}/a.txt", "old")
    sealed.write_text(s, f"{path}/a.txt", "new text")
    return one_row(s, "text string, files long", sealed.read_text(s, f"{path}/a.txt"), len(files.listing(s, path, ("",))))


def staged(s, d):
    """A folder that is there is refused; the private one is gone."""
    path = shared_folder(s, "staged")
    sealed.seal(customers(s, d), s, path + "/out")
    try:
        sealed.seal(customers(s, d), s, path + "/out")
        refused = False
    except FileExistsError:
        refused = True
    left = sum(".tmp" in f for f in files.listing(s, path, ("",)))
    return sealed.unseal(s, path + "/out").agg(F.count("*").alias("n")).select("n", F.lit(refused).alias("refused"), F.lit(left).cast("long").alias("left_over"))


def parquet(s, d):
    """Parquet with zstd."""
    path = shared_folder(s, "zstd")
    sealed.seal(orders(s, d), s, path)
    names = files.listing(s, f"{path}/data", (".parquet",))
    return s.read.parquet(f"{path}/data").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids")).withColumn("zstd", F.lit(all(".zstd." in n for n in names)))


def canonical_lines(s, d):
    """Lines with sorted keys in one order; digests of a hundred lines at a time."""
    path = shared_folder(s, "lines")
    sealed.write_canonical_lines(customers(s, d).select("c_name", "c_custkey"), path, ["c_custkey"])
    lines = s.read.text(path).withColumn("k", F.get_json_object("value", "$.c_custkey").cast("long"))
    return lines.groupBy(F.floor(F.col("k") / 100).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "\n"), 256).alias("digest"))


def grouped(s, d):
    """No customer's orders lie in two shards."""
    path = shared_folder(s, "grouped")
    m = sealed.seal(orders(s, d), s, path, group="o_custkey", shards=5)
    spread = s.read.parquet(f"{path}/data").groupBy("o_custkey").agg(F.countDistinct("_metadata.file_name").alias("k"))
    return spread.agg(F.max("k").alias("most"), F.count("*").alias("groups")).withColumn("n", F.lit(m["rows"]).cast("long"))


def scored_shards(s, d):
    """Shards are scored once; a second run has those to do that aren't there."""
    path = shared_folder(s, "scored")
    orders(s, d).repartitionByRange(4, "o_orderkey").write.parquet(f"{path}/in")
    score = lambda rows: rows.withColumn("score", F.col("o_totalprice") * 2)
    first = outputs.score_shards(s, f"{path}/in", f"{path}/out", score)
    again = outputs.score_shards(s, f"{path}/in", f"{path}/out", score)
    jvm = s._jvm.org.apache.hadoop.fs.Path(f"{path}/out/shard={first[0]}")
    jvm.getFileSystem(s._jsc.hadoopConfiguration()).delete(jvm, True)
    third = outputs.score_shards(s, f"{path}/in", f"{path}/out", score)
    rows = s.read.parquet(f"{path}/out")
    return rows.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"), F.round(F.sum("score"), 2).alias("score")).select("*", F.lit(len(again)).cast("long").alias("again"), F.lit(third == first[:1]).alias("redone"))


def locked(s, d):
    """A file with its locked digest is read; with another one it is refused."""
    path = shared_folder(s, "locked")
    nation = table(s, d, "nation").select("n_nationkey", "n_name").coalesce(1)
    nation.write.parquet(path)
    lock = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in files.digests(s, path).collect() if r.path.endswith(".parquet")}
    ids = [k for k in range(25) if k % 2 == 0]
    rows = files.read_locked(s, path, lock, "n_nationkey", ids, F.col("n_nationkey") % 2 == 0)
    try:
        files.read_locked(s, path, {k: "0" for k in lock}, "n_nationkey", ids, F.col("n_nationkey") % 2 == 0)
        refused = False
    except ValueError:
        refused = True
    return rows.select("n_nationkey", "n_name", F.lit(refused).alias("refused"))


def repeated(s, d):
    """Shards again and again until they hold twice the rows and seven."""
    path = shared_folder(s, "repeated")
    m = sealed.seal(orders(s, d), s, path, group="o_orderkey", shards=3)
    r = outputs.repeated_manifest(s, path, 2 * m["rows"] + 7)
    return r.groupBy("cycle").agg(F.sum("rows").alias("rows"), F.countDistinct("sha256").alias("files")).select("cycle", F.when(F.col("cycle") < 2, F.col("rows")).otherwise(0).alias("rows"), (F.col("files") <= 3).alias("few"))


def side_outputs(s, d):
    path = shared_folder(s, "tagged")
    tags = sealed.write_tagged(customers(s, d), path, "c_mktsegment", ["BUILDING", "MACHINERY", "NONE"])
    return s.read.parquet(path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids")).withColumn("found", F.lit(",".join(tags)))


def report(s, d):
    """A report with a paragraph and a table."""
    path = shared_folder(s, "report") + "/report.md"
    n = table(s, d, "region").groupBy().agg(F.count("*").alias("regions"), F.lit(None).cast("string").alias("note"), F.lit(0.5).alias("share"))
    outputs.write_report(s, path, "Run", [("Words", "All went well."), ("Table", n)])
    return one_row(s, "text string", sealed.read_text(s, path))


def dumped(s, d):
    """Samples by rollout; the second dump of one replaces it."""
    path = shared_folder(s, "dump")
    rows = customers(s, d).select("c_custkey", (F.col("c_custkey") % 3).alias("rollout_id"))
    outputs.dump(rows, path, "rollout_id")
    outputs.dump(rows.where("rollout_id = 1 and c_custkey <= 100"), path, "rollout_id")
    return s.read.parquet(path).groupBy(F.col("rollout_id").cast("long").alias("rollout_id")).agg(F.count("*").alias("n"))


def train_dump(s, d):
    path = shared_folder(s, "train")
    rows = customers(s, d).select("c_custkey", F.lit(4).alias("rollout_id"), (F.col("c_custkey") % 2).alias("rank"))
    outputs.dump(rows, path, "rollout_id", "rank")
    return s.read.parquet(path).groupBy(F.col("rollout_id").cast("long").alias("rollout_id"), F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))


def metrics(s, d):
    path = shared_folder(s, "metrics")
    n = customers(s, d).count()
    for step in range(3):
        outputs.append_metrics(s, path, "rollout/step", step, {"loss": 1 / (step + 1), "rows": n})
    return outputs.read_metrics(s, path).select("step_key", "step", "name", F.round("value", 6).alias("value"))


def manifest(s, d):
    """A sealed data set is read; with a shard changed or a row count wrong it is refused."""
    path = shared_folder(s, "manifest")
    sealed.seal(customers(s, d), s, path)
    n, refused = sealed.unseal(s, path).count(), 0
    text = sealed.read_text(s, f"{path}/manifest.json")
    for wrong in (text.replace(f'"rows":{n}', f'"rows":{n + 1}'), text.replace('"version":1', '"version":9'), text.replace('"sha256":"', '"sha256":"0')):
        sealed.write_text(s, f"{path}/manifest.json", wrong)
        try:
            sealed.unseal(s, path)
        except ValueError:
            refused += 1
    return one_row(s, "n long, refused long", n, refused)


def file_digest(s, d):
    path = shared_folder(s, "digest")
    sealed.write_text(s, f"{path}/a.txt", "abc")
    return files.digests(s, path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


def positions(s, d):
    """Two tables by shard and place; a shard with another number of rows is an error."""
    o = select.ordinals(orders(s, d), ["o_orderkey"]).withColumn("shard", F.col("ord") % 4).withColumn("i", F.floor(F.col("ord") / 4))
    joined = select.join_positions(o.select("shard", "i", "o_orderkey"), o.select("shard", "i", F.col("o_totalprice").alias("price")), "shard", "i")
    try:
        select.join_positions(o.select("shard", "i", "o_orderkey"), o.where("ord > 0").select("shard", "i", "o_totalprice"), "shard", "i")
        refused = False
    except ValueError:
        refused = True
    return joined.groupBy("shard").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("price")).withColumn("refused", F.lit(refused))


QUERIES = {
    "scan_dir_recursive": folder, "scan_parquet_shards": shards, "scan_projected": projected, "scan_batched": batched, "scan_source_checked": checked, "scan_json_or_jsonl": json_documents, "scan_benchmark_dir": benchmark, "scan_eval_records": trials,
    "scan_eval_config": evaluation_sets, "scan_lcb_tokens": dated, "scan_release_files": releases, "scan_aime_rows": fixed, "scan_generated": generated, "scan_manifest_prefix": prefix, "sink_atomic_file": atomic, "sink_staged_dir": staged, "sink_parquet": parquet,
    "sink_jsonl_canonical": canonical_lines, "sink_shard_grouped": grouped, "sink_scored_shard": scored_shards, "sink_lock": locked, "sink_hardlink_repeat": repeated, "sink_side_outputs": side_outputs, "sink_markdown": report, "sink_debug_dump": dumped, "sink_train_dump": train_dump,
    "sink_metrics": metrics, "pred_manifest": manifest, "fn_file_digest": file_digest, "join_positional_shards": positions,
}
LINE = """'{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}'"""
SQL = {
    "scan_dir_recursive": "SELECT c_custkey % 2 AS odd, count(*) AS n, c_custkey % 2 = 1 AS first, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1, 3",
    "scan_parquet_shards": "SELECT true AS few, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders",
    "scan_projected": "SELECT c_custkey, c_mktsegment, true AS only FROM customer",
    "scan_batched": "SELECT count(*) AS n, true AS bounded, true AS whole FROM orders",
    "scan_source_checked": f"WITH r AS (SELECT sha256({LINE}) AS h, row_number() OVER (ORDER BY c_custkey) - 1 AS o, c_custkey FROM customer), c AS (SELECT o // 1000 AS k, sha256(string_agg(h, '' ORDER BY o)) AS h FROM r GROUP BY 1) SELECT count(*) AS n, sum(c_custkey)::BIGINT AS ids, (SELECT CASE WHEN count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY k)) END FROM c) AS digest, true AS refused FROM r WHERE o < 50",
    "scan_json_or_jsonl": "SELECT 'lines.jsonl' AS file, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_custkey <= 20 UNION ALL SELECT 'array.json', count(*), sum(c_custkey)::BIGINT FROM (SELECT c_custkey FROM customer ORDER BY 1 LIMIT 7)",
    "scan_benchmark_dir": BENCH,
    "scan_eval_records": "SELECT * FROM (VALUES ('x', 0.0::DOUBLE, 0::BIGINT, 3::BIGINT), ('y', 0.0, 0, 3), ('x', 1.0, 2, 3)) t(task_id, reward, trial, trials)",
    "scan_eval_config": "SELECT * FROM (VALUES ('aime', 4::BIGINT, 0.5::DOUBLE, 7::BIGINT), ('math', 1, 0.5, 7), ('code', 2, NULL, 9)) t(name, n, t, k)",
    "scan_lcb_tokens": "SELECT o_orderkey AS id, concat_ws(' ', CASE WHEN o_orderkey % 3 = 0 THEN 'title a' END, lower(o_orderstatus), CASE WHEN o_orderkey % 2 = 0 THEN 'def f x' END) AS tokens FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'",
    "scan_release_files": "SELECT 'release_v' || v AS release, i AS place, CASE WHEN i = 0 THEN 'test.jsonl' ELSE 'test' || (i + 1) || '.jsonl' END AS file FROM (SELECT unnest([5, 6]) AS v), (SELECT unnest(range(6)) AS i) WHERE i < v",
    "scan_aime_rows": "SELECT n_nationkey::BIGINT AS problem_index, 'Solve: ' || trim(n_name) || chr(10) || 'Answer:' AS prompt, n_regionkey::VARCHAR AS answer FROM nation WHERE n_nationkey < 10",
    "scan_generated": "SELECT c_custkey, 're: ' || c_name AS response FROM customer",
    "scan_manifest_prefix": "SELECT o // 100 AS chunk, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders) WHERE o < 250 GROUP BY 1",
    "sink_atomic_file": "SELECT 'new text' AS text, 1::BIGINT AS files",
    "sink_staged_dir": "SELECT count(*) AS n, true AS refused, 0::BIGINT AS left_over FROM customer",
    "sink_parquet": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS ids, true AS zstd FROM orders",
    "sink_jsonl_canonical": f"SELECT c_custkey // 100 AS part, sha256(string_agg({LINE}, chr(10) ORDER BY c_custkey)) AS digest FROM customer GROUP BY 1",
    "sink_shard_grouped": "SELECT 1::BIGINT AS most, count(DISTINCT o_custkey) AS groups, count(*) AS n FROM orders",
    "sink_scored_shard": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS ids, round(sum(o_totalprice * 2), 2) AS score, 0::BIGINT AS again, true AS redone FROM orders",
    "sink_lock": "SELECT n_nationkey, n_name, true AS refused FROM nation WHERE n_nationkey % 2 = 0",
    "sink_hardlink_repeat": "SELECT c AS cycle, CASE WHEN c < 2 THEN (SELECT count(*) FROM orders) ELSE 0 END AS rows, true AS few FROM (SELECT unnest(range(3)) AS c)",
    "sink_side_outputs": "SELECT c_mktsegment, count(*) AS n, sum(c_custkey)::BIGINT AS ids, 'BUILDING,MACHINERY' AS found FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1",
    "sink_markdown": "SELECT '# Run' || repeat(chr(10), 2) || '## Words' || repeat(chr(10), 2) || 'All went well.' || repeat(chr(10), 2) || '## Table' || repeat(chr(10), 2) || '| regions | note | share |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || (SELECT count(*) FROM region) || ' |  | 0.5 |' || chr(10) AS text",
    "sink_debug_dump": "SELECT c_custkey % 3 AS rollout_id, count(*) AS n FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey <= 100 GROUP BY 1",
    "sink_train_dump": "SELECT 4::BIGINT AS rollout_id, c_custkey % 2 AS rank, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 2",
    "sink_metrics": "SELECT 'rollout/step' AS step_key, i AS step, 'loss' AS name, round(1.0::DOUBLE / (i + 1), 6) AS value FROM (SELECT unnest(range(3)) AS i) UNION ALL SELECT 'rollout/step', i, 'rows', (SELECT count(*) FROM customer)::DOUBLE FROM (SELECT unnest(range(3)) AS i)",
    "pred_manifest": "SELECT count(*) AS n, 3::BIGINT AS refused FROM customer",
    "fn_file_digest": "SELECT 'a.txt' AS file, 3::BIGINT AS length, sha256('abc') AS sha256",
    "join_positional_shards": "SELECT o % 4 AS shard, count(*) AS n, round(sum(o_totalprice), 2) AS price, true AS refused FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS o FROM orders) GROUP BY 1",
}
