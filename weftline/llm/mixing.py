"""Mixing sources to target weights by systematic sampling.

A source's target over its size is the copies that each of its documents is expected to give. Documents of
a source stand in order of size; the running sum of expected copies starts at one random offset; a document
is emitted once for each integer that the sum crosses. In that order the crossings are spread over all
sizes, so the words taken stay close to the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import shared

MOST = 3  # copies


WEIGHTS = (1, 2, 3)


def n_words(text: str = "text"):
    """Words of a text (null: 0), each made one letter and counted, so that no array of them is held."""
    marks = F.translate(F.regexp_replace(F.col(text), shared.WORD, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def in_order(rows: DataFrame, order: list, spark: SparkSession, what: str) -> DataFrame:
    """rows in a written table, sorted by ranges of the order, with _task and the place in it, _at."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return shared.written(sorted_rows, spark, what).withColumn("_task", F.shiftright("_at", 33))


def targets(sizes: DataFrame, spark: SparkSession, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size: whole numbers, a row for each source) with target.

    Weights go round the sources in order of code points, null last; a target is its weight's share, at most `most`
    times the size, the excess shared anew. Sources may be very many: they are ranked by ranges, and each round of
    sharing is one aggregate, of which the driver gets one row. The comparisons are of whole numbers.
    """
    ranked = in_order(sizes, [F.col("source").isNull(), "source"], spark, "mix-sources")
    firsts = ranked.groupBy("_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.join(firsts.select("_task", "_first", before.alias("_before")), "_task")
    place = F.pmod(F.col("_at") - F.col("_first") + F.col("_before"), F.lit(len(weights))).cast("int")
    ranked = ranked.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), place).cast("long").alias("_w"))
    total, all_weight = ranked.agg(F.sum(F.col("source_size").cast("decimal(24,0)")), F.sum("_w")).first()
    total, all_weight = int(total or 0), int(all_weight or 0)
    left, weight, n_over, over = total, all_weight, 0, F.lit(False)
    while weight:
        room = (most * F.col("source_size")).cast("decimal(20,0)") * F.lit(weight).cast("decimal(16,0)")
        over = F.lit(left).cast("decimal(24,0)") * F.col("_w").cast("decimal(4,0)") > room
        n, held, held_weight = ranked.where(over).agg(F.count("*"), F.sum(F.col("source_size").cast("decimal(24,0)")), F.sum("_w")).first()
        if n == n_over:
            break
        n_over, left, weight = n, total - most * int(held), all_weight - held_weight
    share = left / weight if weight else 0.0
    return ranked.select("source", "source_size", F.when(over, (most * F.col("source_size")).cast("double")).otherwise(F.col("_w") * F.lit(share)).alias("target"))


def copies(rows: DataFrame, spark: SparkSession, seed: str = "mix") -> DataFrame:
    """rows (source, size, further columns that tell rows apart) with source_size, target and copies.

    Every row is ranked in its source by size and the further columns; equal rows take consecutive ranks.
    A source's rows lie in as many tasks as they need: a task numbers its own, and one number for each task
    and source, the rows before, is added. rows is read twice, so it had better be a written table.
    """
    others = [c for c in rows.columns if c not in ("source", "size")]
    ranked = in_order(rows, ["source", "size", *others], spark, "mix-order")
    part = ranked.groupBy("source", "_task").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), F.sum("size").alias("_words"))
    small = shared.written(targets(part.groupBy("source").agg(F.sum("_words").alias("source_size")), spark), spark, "mix-targets")
    before = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    part = part.join(small, part["source"].eqNullSafe(small["source"])).select(part["source"].alias("_source"), part["_task"].alias("_part"), "_first", "_before", "source_size", "target")
    joined = ranked.join(part, (ranked["_task"] == part["_part"]) & ranked["source"].eqNullSafe(part["_source"]))
    rank = F.col("_at") - F.col("_first") + F.col("_before")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "\0"), F.coalesce("source", F.lit("\0")))), 1, 6), 16, 10).cast("double") / 16777216
    # whole copies apart, so that no rounding adds one
    crossed = F.floor(offset + (rank + 1) * (rate - F.floor(rate))) - F.floor(offset + rank * (rate - F.floor(rate)))
    return joined.select(*rows.columns, "source_size", "target", (F.floor(rate) + crossed).cast("long").alias("copies"))


def sizes_of(docs: DataFrame, spark: SparkSession, *more: str) -> DataFrame:
    """source, size, doc_id and a hash of the text, from one pass over the texts, in a written table."""
    return shared.written(shared.spread(docs).select("source", n_words().alias("size"), "doc_id", F.md5("text").alias("tie"), *more), spark, "mix-sizes")


def mix(docs: DataFrame, spark: SparkSession) -> DataFrame:
    """docs (doc_id, text, source, other columns) with each row repeated as often as the mix takes it.

    Null texts have no words; a null source is a source, the last; an empty table stays empty. The rows are
    numbered once in a written table, so equal rows are told apart.
    """
    numbered = shared.written(docs.withColumn("_row", F.monotonically_increasing_id()), spark, "mix-rows")
    taken = copies(sizes_of(numbered, spark, "_row"), spark)
    keep = taken.where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return numbered.join(keep, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)


def op7_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row of `documents`: doc_id, size, source_size, target, taken."""
    docs = shared.table(spark, sf_dir, "documents")
    return copies(sizes_of(docs, spark), spark).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


#: The same in SQL: the sources that reach their limit are a prefix in order of limit over weight.
SQL_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(text) AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
p AS (
  SELECT *, row_number() OVER o AS j, sum(w) OVER o AS wj, sum(3 * n) OVER o AS cj, sum(w) OVER () AS wt, sum(n) OVER () AS t
  FROM w WINDOW o AS (ORDER BY 3.0 * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT coalesce(max(j), 0) AS k FROM p WHERE (t - (cj - 3 * n)) * w > 3 * n * (wt - (wj - w))),
g AS (
  SELECT source, n, CASE WHEN j <= k THEN (3 * n)::DOUBLE
    ELSE w * ((SELECT max(t) - coalesce(sum(3 * n) FILTER (j <= k), 0) FROM p, c)::DOUBLE
            / (SELECT max(wt) - coalesce(sum(w) FILTER (j <= k), 0) FROM p, c)::DOUBLE) END AS target
  FROM p, c),
r AS (
  SELECT d.doc_id, d.size, g.n AS source_size, g.target,
    CASE WHEN g.n > 0 THEN g.target / g.n ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST, d.tie NULLS FIRST) - 1 AS i,
    ('0x' || substr(md5('mix' || chr(0) || coalesce(d.source, chr(0))), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  ((floor(rate) + floor(u + (i + 1) * (rate - floor(rate))) - floor(u + i * (rate - floor(rate)))) * size)::BIGINT AS taken
FROM r
"""
