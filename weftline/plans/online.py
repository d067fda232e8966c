"""Online state, event-time windows, sealed shards and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import structure, text
from weftline.sources import files, sealed
from weftline.streaming import rollout
from weftline.plans.common import shared_folder, table


def stream(s, d):
    """`events` as a file stream; a folder of one file is its source."""
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _named(rows):
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_tumbling(s, d):
    return _named(rollout.run_once(s, rollout.windows(stream(s, d), "6 hours"), shared_folder(s, "stream")))


def sliding(s, d):
    return _named(rollout.windows(table(s, d, "events"), "12 hours", "6 hours"))


def session(s, d):
    w = rollout.sessions(table(s, d, "events"), "8 hours")
    return w.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"), F.max("n").alias("longest"))


def cursor(s, d):
    """Prompts served by an epoch cursor, saved and restored half way."""
    n = table(s, d, "customer").count()
    c = rollout.EpochCursor(n, seed=7)
    got = [c.take(n // 3) for _ in range(4)]
    c = rollout.EpochCursor.load(c.save())
    got += [c.take(n // 3) for _ in range(2)]
    return s.createDataFrame([(i, len(g), len(set(g))) for i, g in enumerate(got)], "step long, n long, distinct_n long")


def buffer(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("at"))
    return rollout.serve(o.where("at % 10 = 0"), o.where("at % 10 <> 0 and grp % 10 <> 0"), 40, "at", "grp").groupBy("grp").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def prefixes(s, d):
    docs = table(s, d, "documents")
    keys = docs.where("doc_id % 5 = 0").select(F.left("text", F.lit(24)).alias("key")).unionByName(docs.where("doc_id % 7 = 0").select(F.left("text", F.lit(9)).alias("key")))
    return rollout.longest_prefix(docs, keys, "doc_id", "text")


def stale(s, d):
    docs = table(s, d, "documents")
    cache = docs.select(F.left("text", F.lit(12)).alias("key"), (F.col("doc_id") % 9).alias("version")).unionByName(docs.select(F.left("text", F.lit(30)).alias("key"), F.lit(8).cast("long").alias("version"))).distinct()
    return rollout.drop_stale(cache, 8, 6, 10).groupBy("version").agg(F.count("*").alias("n"))


def seal(s, d):
    """Orders sealed by customer and read back through the manifest's checks."""
    path = shared_folder(s, "sealed")
    sealed.seal(table(s, d, "orders"), s, path, group="o_custkey", shards=4)
    rows = sealed.unseal(s, path)
    whole = rows.select("o_custkey", F.col("_metadata.file_path").alias("f")).groupBy("o_custkey").agg(F.countDistinct("f").alias("k")).agg(F.max("k").cast("long").alias("shards_of_one"))
    return rows.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids")).crossJoin(F.broadcast(whole))


def scanned(s, d):
    """A slice of a Parquet file by path."""
    return files.read_rows(s, f"{d}/customer.parquet@[10:-5]", ordered=True).select("c_custkey", "c_mktsegment")


def lines(s, d):
    path = shared_folder(s, "lines") + ".jsonl"
    table(s, d, "customer").select("c_custkey", "c_name").write.json(path)
    return files.read_rows(s, path, "c_custkey long, c_name string").groupBy(F.length("c_name").cast("long").alias("len")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))


def validated(s, d):
    schema = '{"type":"object","properties":{"k":{"type":"integer","minimum":10}},"required":["k"]}'
    return table(s, d, "events").groupBy(F.coalesce(structure.py_first_error("props", F.lit(schema)), F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def canonical(s, d):
    return table(s, d, "events").select("event_id", structure.py_canonical("props").alias("canonical"))


def repetitive(s, d):
    return table(s, d, "documents").agg(F.count_if(text.py_is_repetitive("text")).alias("n"))


def compressed(s, d):
    return table(s, d, "documents").select("doc_id", F.round(text.compression_ratio("zlib")("text"), 4).alias("ratio"))


def folded(s, d):
    return table(s, d, "documents").select("doc_id", F.length(text.py_nfkc_fold("text")).cast("long").alias("n"))


QUERIES = {
    "st_window_tumbling": stream_tumbling, "st_window_sliding": sliding, "st_window_session": session, "st_epoch_cursor": cursor, "st_buffer": buffer, "st_longest_prefix": prefixes,
    "st_staleness_gc": stale, "sink_manifest": seal, "scan_generalized": scanned, "scan_jsonl_label_str": lines, "fn_argument_errors": validated,
    "fn_canonical_json": canonical, "fn_repetition": repetitive, "fn_compression_ratio": compressed, "fn_words": folded,
}
SQL = {
    "st_window_tumbling": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "st_window_sliding": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - o * INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2",
    "st_window_session": "WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 8 HOUR, true)::INT AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), h AS (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM h GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS n, max(n) AS longest FROM c GROUP BY 1",
    "st_buffer": "WITH b AS (SELECT o_custkey AS grp, o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE 1 END AS p FROM orders WHERE o_orderkey % 10 = 0 OR o_custkey % 10 <> 0), f AS (SELECT grp FROM (SELECT grp, min({'p': p, 'k': k}) AS o FROM b GROUP BY 1) ORDER BY o, grp LIMIT 40) SELECT grp, count(*) AS n, min(k) AS first FROM b WHERE grp IN (SELECT grp FROM f) GROUP BY 1",
    "st_longest_prefix": "WITH k AS (SELECT DISTINCT key FROM (SELECT left(text, 24) AS key FROM documents WHERE doc_id % 5 = 0 UNION SELECT left(text, 9) FROM documents WHERE doc_id % 7 = 0)) SELECT doc_id, arg_max(key, length(key)) AS key FROM documents LEFT JOIN k ON starts_with(text, key) GROUP BY 1",
    "st_staleness_gc": "WITH c AS (SELECT left(text, 12) AS key, doc_id % 9 AS version FROM documents UNION SELECT left(text, 30), 8 FROM documents), x AS (SELECT key FROM c WHERE version <= 2) SELECT version, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM x WHERE starts_with(c.key, x.key)) GROUP BY 1",
    "sink_manifest": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS ids, 1::BIGINT AS shards_of_one FROM orders",
    "scan_generalized": "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS o, count(*) OVER () AS c FROM customer) WHERE o >= 10 AND o < c - 5",
    "scan_jsonl_label_str": "SELECT length(c_name)::BIGINT AS len, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer GROUP BY 1",
    "fn_argument_errors": "SELECT CASE WHEN (props->>'k')::INT < 10 THEN '$.k: bounds' ELSE '' END AS error, count(*) AS n FROM events GROUP BY 1",
    "fn_canonical_json": "SELECT event_id, replace(props, ' ', '') AS canonical FROM events",
    "st_epoch_cursor": "SELECT unnest(range(6)) AS step, (SELECT count(*) // 3 FROM customer) AS n, (SELECT count(*) // 3 FROM customer) AS distinct_n",
}
