"""The rest: server metrics, roll-ups, projections between vocabularies, message building, whole-batch rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.operators import audit, select
from weftline.plans.common import table


def events(s, d):
    return table(s, d, "events")


def docs(s, d):
    return table(s, d, "documents")


def server_metrics(s, d):
    """Lines of a metrics text, parsed; sums over servers, means for usage."""
    text = F.concat(F.lit("# HELP x\n"), F.lit('tokens_total{server="'), F.col("user_id").cast("string"), F.lit('"} '), F.floor("value").cast("string"), F.lit("\ncache_usage "), F.round(F.col("value") / 100, 4).cast("string"))
    lines = events(s, d).select(F.explode(F.split(text, "\n", -1)).alias("line")).where("line not like '#%'")
    parsed = lines.select(F.regexp_extract("line", r"^([a-z_]+)", 1).alias("name"), F.regexp_extract("line", r" ([0-9.eE+-]+)$", 1).cast("double").alias("v"))
    return parsed.groupBy("name").agg(F.round(F.when(F.col("name").endswith("usage"), F.avg("v")).otherwise(F.sum("v")), 4).alias("value"))


def bucket_means(s, d):
    """Accuracy of categories, then unweighted means of buckets; partial if a category is missing."""
    c = events(s, d).groupBy("event_type").agg(F.avg((F.col("value") > 50).cast("double")).alias("a"))
    b = c.withColumn("bucket", F.when(F.col("event_type").isin("click", "view"), "reach").otherwise("act"))
    return b.groupBy("bucket").agg(F.round(F.avg("a"), 6).alias("mean"), (F.count("*") < F.when(F.col("bucket") == "reach", 2).otherwise(4)).alias("partial"))


def projection(s, d):
    """Candidates of one vocabulary in another; what has no single partner is masked."""
    ids = docs(s, d).select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("c"))
    m = F.create_map(*[F.lit(x) for n in range(1, 9) for x in (n, n * 10)])
    got = F.transform("c", lambda x: F.element_at(m, x))
    return ids.select("doc_id", F.size(F.filter(got, lambda x: x.isNull())).cast("long").alias("masked"), A.total(F.filter(got, lambda x: x.isNotNull())).alias("total"))


def built(s, d):
    """Content cut at placeholders; each takes the next asset."""
    text = F.concat(F.left("text", F.lit(10)), F.lit("<image>"), F.substring(F.col("text"), 11, 10), F.lit("<image>"))
    parts = F.split(text, "<image>", -1)
    made = F.flatten(F.transform(parts, lambda p, i: F.array(F.struct(F.lit("text").alias("type"), p.alias("value")), F.struct(F.lit("image").alias("type"), F.concat(F.lit("asset"), i.cast("string")).alias("value")))))
    kept = F.filter(F.slice(made, F.lit(1), F.size(made) - 1), lambda x: x["value"] != "")
    return docs(s, d).select("doc_id", F.size(kept).cast("long").alias("n"), F.array_join(F.transform(F.filter(kept, lambda x: x["type"] == "image"), lambda x: x["value"]), ",").alias("assets"))


def whole_batch(s, d):
    """Groups by position, or the whole batch as one group if the count isn't groups times size."""
    rows = events(s, d).select("event_id", "value")
    if rows.count() % 8 == 0:
        o = select.ordinals(rows, ["event_id"])
        mean = F.avg("value").over(Window.partitionBy(F.floor(F.col("ord") / 8)))
    else:
        o = rows.crossJoin(F.broadcast(rows.agg(F.avg("value").alias("m"))))  # one row
        mean = F.col("m")
    return o.select("event_id", F.round(F.col("value") - mean, 6).alias("advantage"))


def running_shards(s, d):
    r = table(s, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    return audit.running(r, "k", "o_orderstatus", "n").select("o_orderstatus", F.col("before").cast("long").alias("before"))


def train_rows(s, d):
    """Masks default to ones, are zeros for removed samples, and flags say what was cut short."""
    e = events(s, d).withColumn("len", (F.col("event_id") % 5 + 1).cast("int"))
    mask = F.when(F.col("event_type") == "error", F.array_repeat(F.lit(0), F.col("len"))).otherwise(F.coalesce(F.when(F.col("event_id") % 3 == 0, F.transform(F.sequence(F.lit(1), F.col("len")), lambda i: (i % 2).cast("int"))), F.array_repeat(F.lit(1), F.col("len"))))
    return e.select("event_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("effective"), (F.col("value") > 95).cast("int").alias("truncated"))


def shifted(s, d):
    """Loss masks shifted to the prompt: zeros for all but its last token, the mask, and a zero."""
    m = F.concat(F.array_repeat(F.lit(0), 3), F.transform("embedding", lambda x: (x > 0).cast("int")), F.array(F.lit(0)))
    return table(s, d, "embeddings").select("vec_id", F.size(m).cast("long").alias("n"), F.coalesce(F.array_position(m, 1), F.lit(0)).cast("long").alias("first"))


def served(s, d):
    """A reported name as verified, alias or other."""
    return events(s, d).groupBy(F.when(F.col("event_type") == "view", "verified").when(F.col("event_type").startswith("c"), "alias").otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


def protocol(s, d):
    """A short digest of what defines a run, without what only launches it."""
    p = F.to_json(F.struct(F.col("c_mktsegment").alias("model"), (F.col("c_nationkey") % 3).alias("seed")))
    return table(s, d, "customer").groupBy(F.left(F.sha2(p, 256), F.lit(12)).alias("protocol")).agg(F.count("*").alias("n"))


QUERIES = {
    "agg_server_metrics": server_metrics, "agg_bucket_means": bucket_means, "fn_context_projection": projection, "proj_build_messages": built, "win_group_norm_whole_batch": whole_batch,
    "win_running_shards": running_shards, "fn_batch_pad": shifted, "fn_served_model": served, "fn_protocol_hash": protocol,
}
SQL = {
    "agg_server_metrics": "SELECT 'tokens_total' AS name, round(sum(floor(value)), 4) AS value FROM events UNION ALL SELECT 'cache_usage', round(avg(round(value / 100, 4)), 4) FROM events",
    "agg_bucket_means": "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'reach' ELSE 'act' END AS bucket, round(avg(a), 6) AS mean, count(*) < CASE WHEN bool_or(event_type IN ('click', 'view')) THEN 2 ELSE 4 END AS partial FROM (SELECT event_type, avg((value > 50)::INT) AS a FROM events GROUP BY 1) GROUP BY 1",
    "fn_context_projection": "SELECT doc_id, len(list_filter(c, lambda x: x NOT BETWEEN 1 AND 8))::BIGINT AS masked, (10 * coalesce(list_sum(list_filter(c, lambda x: x BETWEEN 1 AND 8)), 0))::DOUBLE AS total FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS c FROM documents)",
    "proj_build_messages": "SELECT doc_id, (2 + (left(text, 10) <> '')::INT + (substr(text, 11, 10) <> '')::INT)::BIGINT AS n, 'asset0,asset1' AS assets FROM documents",
    "win_group_norm_whole_batch": "SELECT event_id, round(value - avg(value) OVER (PARTITION BY CASE WHEN c % 8 = 0 THEN o // 8 ELSE 0 END), 6) AS advantage FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS o, count(*) OVER () AS c FROM events)",
    "win_running_shards": "SELECT o_orderstatus, (sum(count(*)) OVER (ORDER BY o_orderstatus) - count(*))::BIGINT AS before FROM orders GROUP BY 1",
    "fn_batch_pad": "SELECT vec_id, 68::BIGINT AS n, coalesce(list_position(list_transform(embedding, lambda x: x > 0), true) + 3, 0)::BIGINT AS first FROM embeddings",
    "fn_served_model": "SELECT CASE WHEN event_type = 'view' THEN 'verified' WHEN event_type LIKE 'c%' THEN 'alias' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "fn_protocol_hash": "SELECT left(sha256('{\"model\":\"' || c_mktsegment || '\",\"seed\":' || (c_nationkey % 3) || '}'), 12) AS protocol, count(*) AS n FROM customer GROUP BY 1",
}
