"""Repeated runs of lines, by a suffix array over line ids that distributed prefix doubling builds.

Lines with a word are the symbols. A round of doubling names every suffix by its first 2^k lines: pairs of
names are counted, sorted, and numbered in that order, so names are ranks in the suffix array. A suffix whose
name nobody shares is settled and leaves; the rounds after the first see repeated lines alone. Suffixes that
agree on m lines are an interval of the suffix array with a longest common prefix of m or more; two
overlapping names of 2^k <= m lines identify it. A repeated run counts if it has `min_words` words, which is
so as soon as one of the shortest windows of that many words in it, from a line forward or back from a line,
repeats; all lines of a run lie in such windows, so their union is the union of the maximal repeated runs.
No window has more than min_words lines, so log2(min_words) rounds settle all that matters. Of each interval
the first copy stays: the least doc_id, row and line. Lines that a later copy covers are deleted.

Only DataFrame functions are used. A line's id is 128 bits, two hashes of its text with different seeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import shared


def lines(docs: DataFrame) -> DataFrame:
    """A row for each line with a word: _row, doc_id, i (its number among these), pos (among all), words, a, b."""
    cut = F.transform(F.split("text", "\n", -1), lambda x, p: F.struct(p.alias("pos"), F.regexp_count(x, F.lit(shared.WORD)).alias("words"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit("line"), x).alias("b")))
    full = docs.select("_row", "doc_id", F.filter(cut, lambda x: x["words"] > 0).alias("l"))
    return full.select("_row", "doc_id", F.posexplode("l").alias("i", "l")).select("_row", "doc_id", "i", "l.pos", "l.words", "l.a", "l.b")


def ranks(named: DataFrame, spark: SparkSession, one: str, two: str) -> DataFrame:
    """(one, two) that two rows or more share, with r: ascending in that order over all partitions."""
    twice = named.groupBy(one, two).count().where("count > 1").select(one, two)
    return shared.written(twice.repartitionByRange(one, two).sortWithinPartitions(one, two).withColumn("r", F.monotonically_increasing_id()), spark, "ranks")


def candidates(repeated: DataFrame, min_words: int) -> DataFrame:
    """Stretches of adjacent repeated lines with min_words words, each line with its shortest windows.

    ahead and back: lines of the shortest window of min_words words that begins and ends here, null if none. Counts
    over ranges of the running sums of words give them: a line has a word at least, so no two sums are equal.
    """
    doc = Window.partitionBy("_row").orderBy("i")
    run = Window.partitionBy("_row", "run")
    rows = repeated.withColumn("run", F.col("i") - F.row_number().over(doc))
    rows = rows.withColumn("total", F.sum("words").over(run)).where(F.col("total") >= min_words)
    rows = rows.withColumn("c", F.sum("words").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    ahead = F.count("*").over(run.orderBy(F.col("c") - F.col("words")).rangeBetween(0, min_words - 1))
    back = F.count("*").over(run.orderBy("c").rangeBetween(1 - min_words, 0))
    rows = rows.withColumn("ahead", ahead).withColumn("back", back)
    there = F.col("total") - F.col("c") + F.col("words") >= min_words
    return rows.select("_row", "doc_id", "i", "pos", "r", F.when(there, F.col("ahead").cast("int")).alias("ahead"), F.when(F.col("c") >= min_words, F.col("back").cast("int")).alias("back"))


def double(names: DataFrame, spark: SparkSession, size: int) -> DataFrame:
    """Names (_row, i, r) of `size` lines to names of twice as many, of suffixes that share theirs."""
    after = names.select("_row", (F.col("i") - size).alias("i"), F.col("r").alias("r2"))
    pairs = shared.written(names.withColumnRenamed("r", "r1").join(after, ["_row", "i"]), spark, "pairs")
    return shared.written(pairs.join(ranks(pairs, spark, "r1", "r2"), ["r1", "r2"]).select("_row", "i", "r"), spark, "names")


def later_copies(docs: DataFrame, spark: SparkSession, min_words: int = 50) -> DataFrame:
    """(_row, ranges): the lines, from and to, that later copies of repeated runs cover."""
    all_lines = shared.written(lines(docs), spark, "lines")
    once = ranks(all_lines, spark, "a", "b")
    repeated = shared.written(all_lines.join(once, ["a", "b"]).select("_row", "doc_id", "i", "pos", "words", "r"), spark, "repeated")
    rows = shared.written(candidates(repeated, min_words), spark, "candidates")
    ahead = rows.select("_row", "doc_id", F.col("i").alias("s"), F.col("ahead").alias("m"))
    back = rows.select("_row", "doc_id", (F.col("i") - F.col("back") + 1).alias("s"), F.col("back").alias("m"))
    windows = shared.written(ahead.unionByName(back).where("m is not null").distinct(), spark, "windows")
    longest = windows.agg(F.max("m")).first()[0] or 0
    names, size, found = rows.select("_row", "i", "r"), 1, []
    while size <= longest:
        here = windows.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        head = names.select("_row", F.col("i").alias("s"), F.col("r").alias("head"))
        tail = names.select("_row", F.col("i").alias("e"), F.col("r").alias("tail"))
        found.append(here.withColumn("e", F.col("s") + F.col("m") - size).join(head, ["_row", "s"]).join(tail, ["_row", "e"]).select("_row", "doc_id", "s", "m", "head", "tail"))
        if 2 * size <= longest:
            names = double(names, spark, size)
        size *= 2
    if not found:
        return spark.createDataFrame([], "_row long, ranges array<struct<from int, to int>>")
    one = found[0]
    for x in found[1:]:
        one = one.unionByName(x)
    one = shared.written(one.withColumn("at", F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "_row", "s")), spark, "intervals")
    first = one.groupBy("m", "head", "tail").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = shared.written(one.join(shared.written(first, spark, "firsts"), ["m", "head", "tail"]).where("at <> first").select("_row", "s", "m"), spark, "later")
    # a running sum over each document's starts, ends and lines tells which lines are covered
    starts = later.select("_row", F.col("s").alias("i"), F.lit(None).cast("int").alias("pos"), F.lit(1).alias("d"))
    ends = later.select("_row", (F.col("s") + F.col("m")).alias("i"), F.lit(None).cast("int").alias("pos"), F.lit(-1).alias("d"))
    own = rows.select("_row", "i", "pos", F.lit(0).alias("d")).join(later.select("_row").distinct(), "_row", "left_semi")
    marks = starts.unionByName(ends).unionByName(own)
    here = Window.partitionBy("_row").orderBy("i", F.col("pos").isNotNull()).rangeBetween(Window.unboundedPreceding, 0)
    gone = marks.withColumn("open", F.sum("d").over(here)).where("pos is not null and open > 0")
    gone = gone.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("_row").orderBy("i")))
    spans = gone.groupBy("_row", "run").agg(F.min("pos").alias("from"), F.max("pos").alias("to"))
    return spans.groupBy("_row").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def dedup_lines(docs: DataFrame, spark: SparkSession, min_words: int = 50) -> DataFrame:
    """docs (doc_id, text, other columns) without the later copies of repeated runs of lines; with n_lines, n_removed.

    A run is of adjacent lines that have a word, blank lines between them aside; it may be one line. A null
    text stays null and has no lines; a document may lose all its lines and then has an empty text. Runs
    repeat across documents and inside one. Equal rows are copies of each other like any other rows. n_chars,
    if there is such a column, is the new text's length.
    """
    docs = docs.drop("n_lines", "n_removed")
    rows = shared.written(docs.withColumn("_row", F.monotonically_increasing_id()), spark, "rows")
    gone = shared.written(later_copies(rows.select("_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), spark, min_words), spark, "ranges")
    joined = rows.join(gone, "_row", "left")
    cut = F.split("text", "\n", -1)
    kept = F.filter(cut, lambda x, p: ~F.exists("ranges", lambda r: p.between(r["from"], r["to"])))
    lost = F.coalesce(F.aggregate("ranges", F.lit(0), lambda n, r: n + r["to"] - r["from"] + 1), F.lit(0))
    out = joined.withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(cut)), F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", lost.cast("long")).withColumn("text", F.when(F.col("ranges").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns, "n_lines", "n_removed")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` after line dedup: doc_id, text, n_lines, n_removed."""
    return dedup_lines(shared.table(spark, sf_dir, "documents"), spark).select("doc_id", "text", "n_lines", "n_removed")


#: The same by comparing the windows' texts.
SQL_OP9 = r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id, text) AS rw FROM documents),
raw AS (SELECT rw, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
l AS (
  SELECT *, row_number() OVER (PARTITION BY rw ORDER BY pos) AS i, sum(words) OVER (PARTITION BY rw ORDER BY pos) AS c
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM raw) WHERE words > 0),
few AS (SELECT line FROM l GROUP BY line HAVING count(*) > 1),
ends AS (
  SELECT x.rw, x.i AS s, min(y.i) AS e FROM l x JOIN l y ON x.rw = y.rw AND y.i BETWEEN x.i AND x.i + 49 AND y.c - x.c + x.words >= 50 GROUP BY ALL
  UNION
  SELECT y.rw, max(x.i) AS s, y.i AS e FROM l x JOIN l y ON x.rw = y.rw AND y.i BETWEEN x.i AND x.i + 49 AND y.c - x.c + x.words >= 50 GROUP BY y.rw, y.i),
w AS (
  SELECT e.rw, e.s, e.e, any_value(l.doc_id) AS doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS block
  FROM ends e JOIN l ON l.rw = e.rw AND l.i BETWEEN e.s AND e.e GROUP BY e.rw, e.s, e.e
  HAVING bool_and(l.line IN (SELECT line FROM few))),
late AS (SELECT rw, s, e FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY doc_id NULLS LAST, rw, s) AS k FROM w) WHERE k > 1),
hit AS (SELECT DISTINCT l.rw, l.i, l.pos FROM late JOIN l ON l.rw = late.rw AND l.i BETWEEN late.s AND late.e),
spans AS (SELECT rw, min(pos) AS a, max(pos) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY rw ORDER BY i) AS g FROM hit) GROUP BY rw, g),
gone AS (SELECT DISTINCT raw.rw, raw.pos FROM raw JOIN spans ON raw.rw = spans.rw AND raw.pos BETWEEN a AND b),
left_ AS (SELECT rw, string_agg(line, chr(10) ORDER BY pos) AS text FROM raw ANTI JOIN gone USING (rw, pos) GROUP BY rw)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(left_.text, '') END AS text,
  coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce((SELECT count(*) FROM gone g WHERE g.rw = d.rw), 0)::BIGINT AS n_removed
FROM d LEFT JOIN left_ USING (rw)
"""
