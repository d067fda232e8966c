"""Joins by position and key, repeats, set operations and batches, on orders, lineitem, customer and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import batches, select
from weftline.plans.common import table


def orders(s, d):
    return table(s, d, "orders")


def lines(s, d):
    return table(s, d, "lineitem")


def positional(s, d):
    """Three streams by shard and ordinal; rows without a partner in all are left out, as the shortest stream ends."""
    o = select.ordinals(orders(s, d).select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    a = o.select("ord", "o_orderkey")
    b = o.where("ord % 7 <> 3").select("ord", F.col("o_totalprice").alias("pre"))
    c = o.where("ord % 11 <> 5").select("ord", (F.col("o_totalprice") * 2).alias("post"))
    return a.join(b, "ord").join(c, "ord").select("o_orderkey", F.round(F.col("post") - F.col("pre"), 2).alias("delta"))


def interleave(s, d):
    o = select.ordinals(orders(s, d).select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    return select.interleave(o.select("ord", F.lit("left").alias("side"), "o_orderkey"), o.select("ord", F.lit("right").alias("side"), (-F.col("o_orderkey")).alias("o_orderkey")), "ord", 4)


def repeat_until(s, d):
    shards = orders(s, d).groupBy(F.col("o_orderstatus").alias("shard")).agg(F.count("*").alias("n"))
    total = 2 * orders(s, d).count() + 7
    return select.repeat_until(shards, "shard", "n", total)


def repeat(s, d):
    return orders(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n")).crossJoin(F.broadcast(s.range(3).withColumnRenamed("id", "cycle")))


def samples(s, d):
    """Each prompt n times, with running ids."""
    o = select.ordinals(table(s, d, "customer").select("c_custkey"), ["c_custkey"])
    return o.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("c_custkey", F.col("ord").alias("group_index"), (F.col("ord") * 4 + F.col("k")).alias("index"))


def trim(s, d):
    o = select.ordinals(orders(s, d).select("o_orderkey"), ["o_orderkey"])
    return select.trim_multiple(o, "ord", 128).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def subsample(s, d):
    n = orders(s, d).count()
    o = select.ordinals(orders(s, d).select("o_orderkey"), ["o_orderkey"])
    return select.debug_subsample(o, "ord", n, 0.13).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


def holdout(s, d):
    c = table(s, d, "customer")
    n = c.count()
    return select.ordinals(c.select("c_custkey"), ["c_custkey"]).groupBy((F.col("ord") >= n - 40).alias("eval")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


def date_filter(s, d):
    return orders(s, d).where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def locked(s, d):
    """Filtered, sorted ids and their digest."""
    o = orders(s, d).where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("o_orderkey", F.floor(F.col("o_orderkey") / 500).alias("part"))
    return o.groupBy("part").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ","), 256).alias("digest"))


def answers(s, d):
    """Entries with their answers; those without are left out."""
    a = lines(s, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return orders(s, d).join(a, F.col("o_orderkey") == F.col("l_orderkey"), "left").where(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0).select("o_orderkey", F.array_join("flags", ",").alias("flags"))


def names(s, d):
    """Names in both and in one list only."""
    f = lines(s, d).groupBy("l_suppkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag"))).alias("b"))
    return f.select("l_suppkey", F.array_join(F.array_sort(F.array_intersect("a", "b")), ",").alias("shared"), F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("unknown"))


def calls(s, d):
    """Pairs of suppliers with equal multisets of calls."""
    f = lines(s, d).where("l_quantity > 48").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_returnflag")), "").alias("calls"))
    return f.groupBy("calls").agg(F.count("*").alias("n"))


def concat(s, d):
    return orders(s, d).select(F.col("o_orderkey").alias("k")).unionByName(lines(s, d).select(F.col("l_orderkey").alias("k"))).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def mixture(s, d):
    """Shares of a mixture's components, and whether they sum to one and hold whole groups of four."""
    m = lines(s, d).groupBy("l_returnflag").agg(F.count("*").alias("n"))
    total = m.agg(F.sum("n").alias("t"))
    return m.crossJoin(F.broadcast(total)).select("l_returnflag", F.round(F.col("n") / F.col("t"), 6).alias("weight"), (F.col("n") % 4 == 0).alias("whole"))


def micro(s, d):
    o = select.ordinals(lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"])
    return o.groupBy(batches.micro_batch(F.col("ord"), 1000).alias("batch")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def dealt(rule):
    def q(s, d):
        rows = table(s, d, "documents").withColumn("step", F.floor(F.col("doc_id") / 50).cast("long"))
        return batches.deal(rows, "step", "doc_id", "n_chars", rule).groupBy("step", "part").agg(F.count("*").alias("n"), F.sum("n_chars").alias("load"))

    return q


def template(s, d):
    """Trimmed prompts between fixed texts, with the digest as label."""
    t = F.trim("text")
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("Solve:\n"), t, F.lit("\nAnswer:")).alias("prompt"), F.concat(F.lit("sha256:"), F.sha2(t, 256)).alias("label"))


def inject(s, d):
    m = F.map_concat(F.create_map(F.lit("lang"), F.col("lang")), F.create_map(F.lit("rm_type"), F.lit("math")))
    return table(s, d, "documents").select("doc_id", F.element_at(m, "lang").alias("lang"), F.element_at(m, "rm_type").alias("rm_type"), F.array_join(F.array_sort(F.map_keys(F.transform_keys(m, lambda k, v: F.concat(F.lit("eval/"), k)))), ",").alias("keys"))


QUERIES = {
    "join_positional_streams": positional, "union_interleave": interleave, "cross_repeat_until": repeat_until, "cross_repeat": repeat, "cross_n_samples": samples,
    "filter_trim_multiple": trim, "filter_debug_subsample": subsample, "filter_holdout_tail": holdout, "filter_date_from": date_filter, "scan_locked": locked,
    "join_answers_by_id": answers, "intersect_names": names, "multiset_calls": calls, "union_concat": concat, "pk_micro_batches": micro,
    "pk_karmarkar_karp": dealt(lambda x: batches.largest_differencing(x, min(8, len(x)))), "pk_greedy": dealt(lambda x: batches.least_loaded(x, 8)), "pk_first_fit": dealt(lambda x: batches.first_fit(x, 20_000)),
    "pk_size_chunks": dealt(lambda x: batches.size_chunks(x, 10_000)), "proj_template_math": template, "proj_inject_metadata": inject,
}
O = "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS ord FROM orders)"
SQL = {
    "join_positional_streams": O + " SELECT o_orderkey, round(o_totalprice, 2) AS delta FROM o WHERE ord % 7 <> 3 AND ord % 11 <> 5",
    "union_interleave": O + " SELECT ord, CASE WHEN ord // 4 % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN ord // 4 % 2 = 0 THEN o_orderkey ELSE -o_orderkey END AS o_orderkey FROM o",
    "cross_repeat_until": "WITH s AS (SELECT o_orderstatus AS shard, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT cycle, shard, n, sum(n) OVER (ORDER BY cycle, shard) - n AS b FROM s, (SELECT unnest([0, 1, 2])::BIGINT AS cycle)) SELECT cycle, shard, n FROM c WHERE b < 2 * (SELECT count(*) FROM orders) + 7",
    "cross_repeat": "SELECT o_orderstatus, count(*) AS n, cycle FROM orders, (SELECT unnest([0, 1, 2])::BIGINT AS cycle) GROUP BY 1, 3",
    "cross_n_samples": "SELECT c_custkey, o AS group_index, o * 4 + k AS index FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o FROM customer), (SELECT unnest([0, 1, 2, 3]) AS k)",
    "filter_trim_multiple": O + " SELECT count(*) AS n, max(o_orderkey) AS last FROM o WHERE ord < (SELECT count(*) // 128 * 128 FROM orders)",
    "filter_debug_subsample": O + ", c AS (SELECT count(*) AS c, floor(count(*) * 0.13::DOUBLE)::BIGINT AS n FROM orders) SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM o, c WHERE ord < c.n // 2 OR ord >= c - (c.n - c.n // 2)",
    "filter_holdout_tail": "SELECT o >= c - 40 AS eval, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS o, count(*) OVER () AS c FROM customer) GROUP BY 1",
    "filter_date_from": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1",
    "scan_locked": "SELECT o_orderkey // 500 AS part, count(*) AS n, sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS digest FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1",
    "join_answers_by_id": "SELECT o_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "intersect_names": "WITH f AS (SELECT l_suppkey, list(DISTINCT l_returnflag) AS a, coalesce(list(DISTINCT l_returnflag) FILTER (l_linestatus = 'F'), []) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS unknown FROM f",
    "multiset_calls": "SELECT calls, count(*) AS n FROM (SELECT string_agg(l_returnflag, '' ORDER BY l_returnflag) AS calls FROM lineitem WHERE l_quantity > 48 GROUP BY l_orderkey) GROUP BY 1",
    "union_concat": "SELECT count(*) AS n, sum(k)::BIGINT AS total FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT l_orderkey FROM lineitem)",
    "pk_micro_batches": "SELECT (o // 1000)::BIGINT AS batch, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM (SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS o FROM lineitem) GROUP BY 1",
    "proj_template_math": "SELECT doc_id, 'Solve:' || chr(10) || trim(text) || chr(10) || 'Answer:' AS prompt, 'sha256:' || sha256(trim(text)) AS label FROM documents",
    "proj_inject_metadata": "SELECT doc_id, lang, 'math' AS rm_type, 'eval/lang,eval/rm_type' AS keys FROM documents",
}
