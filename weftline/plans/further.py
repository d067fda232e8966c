"""Audits, packed sequences, rewards and further measures."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.operators import audit, batches, metrics, select
from weftline.plans.common import table
from weftline.streaming import rollout


def docs(s, d):
    return table(s, d, "documents")


def events(s, d):
    return table(s, d, "events")


def benchmark_audit(s, d):
    return audit.benchmark_audit(docs(s, d), table(s, d, "benchmark"), "doc_id", "item_id", "text", 5, 0.05, 0.5).select("doc_id", "item_id", "exact", F.round("jaccard", 6).alias("jaccard"), "action")


AUDIT = r"""
WITH s AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[a-z0-9]+') FROM benchmark),
g AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM s),
n AS (SELECT side, id, count(*) AS n FROM g GROUP BY 1, 2),
p AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.side = 0 AND b.side = 1 GROUP BY 1, 2),
e AS (SELECT a.id AS doc_id, b.id AS item_id FROM s a JOIN s b ON a.side = 0 AND b.side = 1 AND array_to_string(a.t, ' ') = array_to_string(b.t, ' ') AND len(a.t) > 0),
u AS (SELECT doc_id, item_id, false AS exact, c / (x.n + y.n - c) AS jaccard FROM p JOIN n x ON x.side = 0 AND x.id = doc_id JOIN n y ON y.side = 1 AND y.id = item_id WHERE c / (x.n + y.n - c) >= 0.05 UNION ALL SELECT doc_id, item_id, true, 1.0 FROM e)
SELECT doc_id, item_id, bool_or(exact) AS exact, round(max(jaccard), 6) AS jaccard, CASE WHEN bool_or(exact) OR max(jaccard) >= 0.5 THEN 'removed' ELSE 'audit_only' END AS action FROM u GROUP BY 1, 2
"""


def packs(s, d, most=4096):
    """Word lengths of whole texts in balanced packs: of each step of 50 ids, ceil(tokens / most), but not more than rows."""
    rows = docs(s, d).select("doc_id", F.floor(F.col("doc_id") / 50).cast("long").alias("step"), F.transform(F.split("text", " "), F.length).alias("t"))
    rule = lambda x: batches.largest_differencing(x, min(len(x), max(1, -(-sum(x) // most))))
    part = batches.deal(rows.withColumn("size", F.size("t")), "step", "doc_id", "size", rule).select("doc_id", (F.col("step") * 50 + F.col("part")).alias("pack"))
    return audit.pack_tokens(rows.join(part, "doc_id"), "pack", "doc_id", "t")


def packed(s, d):
    return packs(s, d).select("pack", F.size("tokens").cast("long").alias("n"), F.size("offsets").cast("long").alias("offsets"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max("positions").cast("long").alias("furthest"))


def unpacked(s, d):
    u = audit.unpack_tokens(packs(s, d), "pack")
    return u.select("pack", F.col("i").cast("long").alias("i"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def dp_split(s, d):
    o = select.ordinals(docs(s, d).select("doc_id", "n_chars"), ["doc_id"])
    return o.groupBy((F.col("ord") % 4).alias("rank")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("load"))


def mt_shuffle(s, d):
    rows = select.shuffled(docs(s, d).select("doc_id"), s, ["doc_id"], 42)
    return rows.where("place < 50")


def epoch_shuffle(s, d):
    n = docs(s, d).count()
    out = None
    for epoch in range(2):
        places = list(range(n))
        random.Random(7 + epoch).shuffle(places)
        one = s.createDataFrame([(epoch, i, p) for i, p in enumerate(places[:20])], "epoch int, place int, ord int")
        out = one if out is None else out.unionByName(one)
    return out


def percentile_floor(s, d):
    return metrics.exact_rank(docs(s, d), "lang", "n_chars", 0.9, "p90")


def top_names(s, d):
    words = docs(s, d).select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "word")).withColumn("at", F.struct("doc_id", "i"))
    return metrics.top_names(words, "word", "at", 30).select("word", "n")


def dispositions(s, d):
    lab = table(s, d, "labels")
    r = docs(s, d).join(lab, "doc_id", "left").select(F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "rejected").when(F.col("toxic") == 1, "held").otherwise("kept").alias("disposition"))
    return r.groupBy("disposition").agg(F.count("*").alias("n"))


def card(s, d):
    n = docs(s, d).agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") == "de").alias("b"), F.count_if(~F.col("lang").isin("en", "de")).alias("c"))
    return n.selectExpr("stack(3, 'en', a, 'de', b, 'other', c) as (category, n)")


def main_pcts(s, d):
    return docs(s, d).groupBy().pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1)))


def statistics(s, d):
    return events(s, d).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("median"))


def reward_metrics(s, d):
    return events(s, d).agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("longest"), F.round(F.avg((F.col("value") > 95).cast("double")), 6).alias("truncated"))


def spec_metrics(s, d):
    return events(s, d).groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 0, F.floor("value") / F.ceil("value")).otherwise(0.0)), 6).alias("accept"))


def perf(s, d):
    span = F.max(F.col("ts").cast("timestamp").cast("double")) - F.min(F.col("ts").cast("timestamp").cast("double"))
    return events(s, d).groupBy("event_type").agg(F.round(F.sum("value") / span * 1000, 6).alias("rate"), F.max("value").alias("longest"))


def objective(s, d):
    m = (F.col("event_type") != "error").cast("double")
    t = lambda c: F.sum(c * m) / F.greatest(F.sum(m), F.lit(1.0))
    return events(s, d).agg(F.round(t(F.col("value")), 6).alias("direct"), F.round(t(F.col("value") * F.col("value")), 4).alias("kl"), F.round(t(F.col("value")) + 0.1 * t(F.col("value") * F.col("value")), 4).alias("total"))


def drop_reasons(s, d):
    r = F.when(F.col("value") < 5, "low").when(F.col("value") > 95, "high")
    return events(s, d).groupBy(F.coalesce(r, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def over_sampling(s, d):
    """The first groups that pass, in order of completion; counts of the rest by reason are a second table."""
    g = events(s, d).groupBy("user_id").agg(F.max("ts").alias("at"), F.avg("value").alias("m")).withColumn("keep", F.col("m") > 50).withColumn("reason", F.lit("low"))
    return rollout.keep_until(g, "keep", "at", 20)[0].select("user_id")


def carry(s, d):
    x = events(s, d).select("event_id", F.when(F.col("event_type") == "error", "aborted").otherwise("completed").alias("status"), F.lit(None).cast("int").alias("start_rollout_id"), F.array_repeat(F.lit(1), 3).alias("loss_mask"))
    return rollout.carry_over(x, 7).agg(F.count("*").alias("n"), F.max("start_rollout_id").alias("stamp"), F.sum(F.aggregate("loss_mask", F.lit(0), lambda a, m: a + m)).alias("ones"))


def resume(s, d):
    done = events(s, d).where("event_type = 'purchase'").select("user_id").distinct()
    return audit.resume(table(s, d, "customer").select(F.col("c_custkey").alias("user_id")), done, ["user_id"]).agg(F.count("*").alias("n"))


def retries(s, d):
    kind = F.when(F.col("event_type") == "error", "infrastructure").when(F.col("event_type") == "view", "agent").otherwise("ok")
    return events(s, d).groupBy("user_id", kind.alias("kind")).agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


def flops(s, d):
    n = F.col("n_chars")
    return docs(s, d).select("doc_id", (n * 24 * 8 * 64 * 64 + n * n * 4 * 8 * 64).alias("flops"))


def teacher_map(s, d):
    """Symbols of one vocabulary mapped to another, one to one; what has no partner is marked."""
    a = docs(s, d).where("lang = 'en'").select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).distinct()
    b = docs(s, d).where("lang = 'de'").select(F.explode(F.array_distinct(F.split("text", " "))).alias("w")).distinct()
    return a.join(b.withColumn("there", F.lit(True)), "w", "left").agg(F.count("*").alias("n"), F.count("there").alias("mapped"))


def excess(s, d):
    """Share of a limit's rows, medians above it and their part of all characters."""
    return docs(s, d).groupBy("lang").agg(F.count_if(F.col("n_chars") > 2000).alias("above"), F.round(F.sum(F.when(F.col("n_chars") > 2000, F.col("n_chars")).otherwise(0)) / F.sum("n_chars"), 6).alias("share"))


def context_rank(s, d):
    o = select.ordinals(docs(s, d).select("doc_id"), ["doc_id"])
    n = docs(s, d).count()
    return o.groupBy(batches.contiguous(F.col("ord"), F.lit(n), 3).alias("rank")).agg(F.count("*").alias("n"))


def dense(s, d):
    """Rows whose arrays have one width; others would be an error."""
    return table(s, d, "embeddings").agg(F.bool_and(F.size("embedding") == 64).alias("dense"), F.count("*").alias("n"))


def mean_masks(s, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(s, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(A.masked_mean(F.col("v"), F.transform("v", lambda x: (x > 0).cast("int"))), 6).alias("mean"))


QUERIES = {
    "join_benchmark_audit": benchmark_audit, "pk_sequences": packed, "pk_unpack": unpacked, "pk_dp_split": dp_split, "sample_mt_shuffle": mt_shuffle, "sample_epoch_shuffle": epoch_shuffle,
    "agg_percentile_floor": percentile_floor, "agg_topn_names": top_names, "agg_dispositions": dispositions, "agg_main_pcts": main_pcts, "agg_statistics": statistics,
    "agg_reward_metrics": reward_metrics, "agg_rollout_perf": perf, "agg_drop_reasons": drop_reasons, 
    "st_partial_rollout": carry, "st_resume": resume, "st_retry_classify": retries, "fn_flops": flops, "fn_teacher_tokens": teacher_map, "agg_length_excess": excess, "filter_rank_slice": context_rank,
    
}
SQL = {
    "join_benchmark_audit": AUDIT,
    "pk_dp_split": "SELECT o % 4 AS rank, count(*) AS n, sum(n_chars)::BIGINT AS load FROM (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) GROUP BY 1",
    "agg_percentile_floor": "SELECT lang, list_sort(list(n_chars))[least(count(*), floor(count(*) * 0.9::DOUBLE)::BIGINT + 1)] AS p90 FROM documents GROUP BY 1",
    "agg_topn_names": "WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) AS i, unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w GROUP BY 1 ORDER BY n DESC, min(doc_id::HUGEINT * 1000000000 + i) LIMIT 30",
    "agg_dispositions": "SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'rejected' WHEN toxic = 1 THEN 'held' ELSE 'kept' END AS disposition, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "agg_main_pcts": "SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents",
    "agg_statistics": "SELECT event_type, round(avg(value), 6) AS mean, median(value) AS median FROM events GROUP BY 1",
    "agg_reward_metrics": "SELECT round(avg(value), 6) AS mean, max(value) AS longest, round(avg((value > 95)::INT), 6) AS truncated FROM events",
    "agg_rollout_perf": "SELECT event_type, round(sum(value) / (max(epoch_us(ts)) / 1e6 - min(epoch_us(ts)) / 1e6) * 1000, 6) AS rate, max(value) AS longest FROM events GROUP BY 1",
    "agg_drop_reasons": "SELECT CASE WHEN value < 5 THEN 'low' WHEN value > 95 THEN 'high' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "st_partial_rollout": "SELECT count(*) AS n, 7 AS stamp, 0::BIGINT AS ones FROM events WHERE event_type = 'error'",
    "st_resume": "SELECT count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')",
    "st_retry_classify": "SELECT kind, sum(n)::BIGINT AS n, max(n) AS most FROM (SELECT user_id, CASE event_type WHEN 'error' THEN 'infrastructure' WHEN 'view' THEN 'agent' ELSE 'ok' END AS kind, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "fn_flops": "SELECT doc_id, n_chars * 24 * 8 * 64 * 64 + n_chars * n_chars * 4 * 8 * 64 AS flops FROM documents",
    "fn_teacher_tokens": "WITH a AS (SELECT DISTINCT lang, unnest(string_split(text, ' ')) AS w FROM documents WHERE lang IN ('en', 'de')) SELECT count(*) AS n, count(b.w) AS mapped FROM (SELECT w FROM a WHERE lang = 'en') x LEFT JOIN (SELECT w FROM a WHERE lang = 'de') b ON x.w = b.w",
    "agg_length_excess": "SELECT lang, count(*) FILTER (n_chars > 2000) AS above, round(coalesce(sum(n_chars) FILTER (n_chars > 2000), 0) / sum(n_chars), 6) AS share FROM documents GROUP BY 1",
    "filter_rank_slice": "SELECT (o // ceil(c / 3)::BIGINT)::BIGINT AS rank, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS c FROM documents) GROUP BY 1",
}
