"""Curation of documents: tokens, shingles, duplicates, contamination, samples, limits, distributions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import dedup, metrics, select
from weftline.plans.common import keeper, table

LIMITS = [500, 1000, 2000, 4000, 8000]
TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def docs(s, d):
    return table(s, d, "documents")


def prompt_tokens(s, d):
    """Tokens of texts, every second one with the words around it that prompts have."""
    x = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit(" Solve the following  coding problem using the programming language Python:\n"), "text", F.lit("\nNow solve the problem and return the code. "))).otherwise(F.col("text"))
    return docs(s, d).select("doc_id", T.prompt_tokens(x).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


def shingle_count(short, k=5):
    return lambda s, d: docs(s, d).select("doc_id", F.size(T.shingles(T.norm_tokens(F.col("text")), k, short)).cast("long").alias("n_shingles"))


def shingle_sql(short):
    few = "CASE WHEN len(t) > 0 THEN 1 ELSE 0 END" if short == "whole" else "0"
    return f"SELECT doc_id, (CASE WHEN len(t) >= 5 THEN len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))) ELSE {few} END)::BIGINT AS n_shingles FROM (SELECT doc_id, {TOK} AS t FROM documents)"


def decontam(s, d):
    return dedup.contaminated_pairs(docs(s, d), table(s, d, "benchmark"), "doc_id", "item_id", "text", 5, 0.5, 0.8).select("doc_id", "item_id", F.col("shared").cast("long").alias("shared"), F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


def decontam_clean(s, d):
    bad = dedup.contaminated_pairs(docs(s, d), table(s, d, "benchmark"), "doc_id", "item_id", "text", 5, 0.5, 0.8)
    return docs(s, d).join(bad, "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


PAIRS = f"""
WITH a AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM (SELECT doc_id, {TOK} AS t FROM documents)),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM (SELECT item_id, {TOK} AS t FROM benchmark)),
na AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
p AS (SELECT doc_id, item_id, count(*) AS shared FROM a JOIN b USING (g) GROUP BY 1, 2),
q AS (SELECT doc_id, item_id, shared, shared / (na.n + nb.n - shared) AS jaccard, shared / least(na.n, nb.n) AS overlap FROM p JOIN na USING (doc_id) JOIN nb USING (item_id)),
hit AS (SELECT * FROM q WHERE jaccard >= 0.5 OR overlap >= 0.8)
"""


def exact_benchmark(s, d):
    key = F.array_join(T.norm_tokens(F.col("text")), " ").alias("k")
    b = table(s, d, "benchmark").select(key).distinct()
    return docs(s, d).select("doc_id", key).join(b, "k", "left_anti").agg(F.count("*").alias("n"))


def exact_dedup(s, d):
    rows = docs(s, d).select("doc_id", F.sha2("text", 256).alias("h"), "lang")
    return dedup.first_per_key(rows, ["h"], ["doc_id"]).select("doc_id", "h", "lang")


def exact_audit(s, d):
    return dedup.exact_dedup_audit(docs(s, d).select("doc_id", F.sha2("text", 256).alias("h")), "h", "doc_id").select("removed", "representative")


def norm_dedup(s, d):
    both = T.bind(F.array_join(T.norm_tokens(F.col("text")), " "), lambda k: F.struct(F.sha2(k, 256).alias("h"), F.length(k).cast("long").alias("key_len")))
    rows = docs(s, d).select("doc_id", both.alias("k")).select("doc_id", "k.h", "k.key_len")
    return dedup.first_per_key(rows, ["h"], ["doc_id"]).select("doc_id", "key_len")


def conflicts(s, d):
    rows = docs(s, d).select("doc_id", F.sha2(F.array_join(T.norm_tokens(F.col("text")), " "), 256).alias("h"), "lang").join(table(s, d, "labels"), "doc_id")
    return dedup.conflict_groups(rows, "h", "quality", "lang")


def near_pairs(s, d):
    return dedup.near_pairs(docs(s, d), "doc_id", "text", "lang", 5, 0.8).select("a", "b", F.round("jaccard", 6).alias("jaccard"), "same")


NEAR = f"""
WITH s AS (SELECT doc_id, lang, list_sort(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')))) AS g FROM (SELECT doc_id, lang, {TOK} AS t FROM documents) WHERE len(t) >= 5),
c AS (SELECT doc_id, lang, g, min(doc_id) OVER (PARTITION BY lang, g) AS rep FROM s),
a AS (SELECT doc_id, lang, unnest(g) AS g FROM c WHERE doc_id = rep),
n AS (SELECT doc_id, count(*) AS n FROM a GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM a x JOIN a y ON x.g = y.g AND x.lang IS NOT DISTINCT FROM y.lang AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, round(c / (m.n + k.n - c), 6) AS jaccard, false AS same FROM p JOIN n m ON m.doc_id = a JOIN n k ON k.doc_id = b WHERE c / (m.n + k.n - c) >= 0.8
UNION ALL SELECT rep, doc_id, 1.0::DOUBLE, true FROM c WHERE doc_id <> rep
"""


def near_greedy(s, d):
    return dedup.greedy_representatives(dedup.near_pairs(docs(s, d), "doc_id", "text", "lang", 5, 0.8), s, keeper(s, "near"))


def minhash(s, d):
    sh = T.shingles(T.norm_tokens(F.col("text")), 5, "none")
    return docs(s, d).select("doc_id", F.coalesce(F.array_join(T.minhash(sh, 16), ","), F.lit("")).alias("signature"))


def hash_sample(s, d):
    return select.hash_sample(docs(s, d).select("doc_id", "lang"), "doc_id", 100, 42)


def prefix(s, d):
    rows = select.ordinals(docs(s, d).where(F.length("text") <= 2000).select("doc_id"), ["doc_id"])
    return rows.where("ord < 150")


def sliced(s, d):
    return select.row_slice(docs(s, d).select("doc_id", "lang"), ["doc_id"], -120, -20)


def ranked(rule):
    def q(s, d):
        rows = docs(s, d).select("doc_id")
        n = rows.count()
        o = select.ordinals(rows, ["doc_id"])
        rank = F.floor(F.col("ord") / -(-n // 8)) if rule == "contiguous" else F.col("ord") % 8
        return o.groupBy(rank.cast("long").alias("rank")).agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))

    return q


def length_stats(s, d):
    return docs(s, d).groupBy("lang").agg(*metrics.length_stats("n_chars", [2000, 4000]))


def length_sets(s, d):
    rows = docs(s, d).select("lang", "n_chars", F.least(F.floor(F.col("n_chars") / 1000), F.lit(9)).cast("long").alias("bucket"))
    return s.sql("SELECT lang, bucket, count(*) AS n, percentile_disc(0.95) WITHIN GROUP (ORDER BY n_chars) AS p95, max(n_chars) AS longest FROM {rows} GROUP BY GROUPING SETS ((), (lang), (bucket))", rows=rows)


def retention(s, d):
    return metrics.retention(docs(s, d), "n_chars", "lang", LIMITS)


RETENTION = "WITH l AS (SELECT unnest([500, 1000, 2000, 4000, 8000])::INT AS max_len), g AS (SELECT max_len, lang, count(*) AS n, count(*) FILTER (n_chars <= max_len) AS kept FROM documents, l GROUP BY 1, 2)"


def limit_select(s, d):
    rows = metrics.retention(docs(s, d), "n_chars", "lang", LIMITS)
    ok = rows.groupBy("max_len").agg((F.sum("kept") / F.sum("n")).alias("all"), F.min("share").alias("least"), F.max(F.abs("shift_pp")).alias("shift"))
    ok = ok.withColumn("ok", (F.col("all") >= 0.9) & (F.col("least") >= 0.8) & (F.col("shift") <= 2))
    return ok.agg(F.coalesce(F.min(F.when(F.col("ok"), F.col("max_len"))), F.max("max_len")).alias("chosen"))


def pp_changes(s, d):
    kinds = docs(s, d).select("lang", F.explode(F.array(F.lit(0), F.when(F.col("n_chars") > 200, 1), F.when((F.col("n_chars") > 200) & (F.col("n_chars") <= 4000), 2))).alias("stage")).where("stage is not null")
    share = kinds.groupBy("stage", "lang").agg(F.count("*").alias("n")).withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("stage")))
    w = Window.partitionBy("lang").orderBy("stage")
    step, cum = F.col("pct") - F.lag("pct").over(w), F.col("pct") - F.first("pct").over(w)
    return share.select("stage", "lang", "n", F.round(F.coalesce(step, F.lit(0.0)), 6).alias("step_pp"), F.round(cum, 6).alias("total_pp"), (F.abs(F.coalesce(step, F.lit(0.0))) > 0.5).alias("warn"))


def buckets(s, d):
    b = F.when(F.col("n_chars") < 500, "0-499").when(F.col("n_chars") < 2000, "500-1999").when(F.col("n_chars") < 8000, "2000-7999").otherwise("8000+")
    return docs(s, d).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def crosstab(s, d):
    return docs(s, d).join(table(s, d, "labels"), "doc_id").groupBy(F.concat_ws("|", "lang", F.col("quality").cast("string")).alias("pair")).agg(F.count("*").alias("n"))


def distribution(s, d):
    kinds = s.createDataFrame([("en",), ("de",), ("fr",), ("es",), ("it",)], "lang string")
    return metrics.distribution(docs(s, d), "lang", kinds)


def markers(s, d):
    marks = {"n_semi": ";", "n_pipe": "|", "n_bang": "!!", "n_license": "License"}
    return docs(s, d).agg(*[F.sum(F.regexp_count("text", F.lit("\\Q" + m + "\\E"))).cast("long").alias(n) for n, m in marks.items()])


def event_summary(s, d):
    codes = F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("text").contains("!!"), "shout"), F.when(F.col("text").contains("###"), "marks"), F.when(F.col("text").contains("License"), "license"))
    rows = docs(s, d).select("doc_id", F.explode(F.filter(codes, lambda x: x.isNotNull())).alias("code"))
    return metrics.summary(rows, "code", "doc_id")


def structural(s, d):
    problems = F.filter(F.array(F.when(F.col("text") == "", "empty"), F.when(F.col("n_chars") != F.length("text"), "length"), F.when(F.col("text").contains("\t"), "tab"), F.when(F.length("text") > 20000, "long")), lambda x: x.isNotNull())
    return docs(s, d).select("doc_id", F.array_join(F.array_sort(F.array_distinct(problems)), ",").alias("problems")).where("problems <> ''")


def content_hash(s, d):
    h = docs(s, d).select("doc_id", F.sha2("text", 256).alias("h"))
    return h.groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def semi_valid(s, d):
    return docs(s, d).join(table(s, d, "labels").where("quality = 1"), "doc_id", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


def anti_missing(s, d):
    return docs(s, d).join(table(s, d, "labels"), "doc_id", "left_anti").groupBy("lang").agg(F.count("*").alias("n"))


def vocab_compare(s, d):
    words = lambda lang: docs(s, d).where(F.col("lang") == lang).select(F.explode_outer(T.bind(T.norm_tokens(F.col("text")), F.array_distinct)).alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("n"))
    both = words("en").withColumnRenamed("n", "a").join(words("de").withColumnRenamed("n", "b"), "w", "full_outer")
    return both.agg(F.count("*").alias("symbols"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a").isNull()).alias("only_right"))


def pipeline_funnel(s, d):
    """Rows left after each stage of a curation chain."""
    rows = docs(s, d).where("n_chars > 200")
    unique = dedup.first_per_key(rows.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"])
    bad = dedup.contaminated_pairs(rows, table(s, d, "benchmark"), "doc_id", "item_id", "text", 5, 0.5, 0.8).select("doc_id").distinct()
    clean = unique.join(bad, "doc_id", "left_anti")
    fit = clean.join(docs(s, d).where("n_chars <= 4000").select("doc_id"), "doc_id", "left_semi")
    stages = [("raw", docs(s, d)), ("structural", rows), ("unique", unique), ("clean", clean), ("fit", fit)]
    out = None
    for k, (name, df) in enumerate(stages):
        one = df.agg(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def text_forms(s, d):
    x = F.col("text")
    return docs(s, d).select("doc_id", F.sha2(T.newlines(x), 256).alias("lf"), F.length(T.squeeze(x)).cast("long").alias("squeezed"), F.sha2(T.alnum_words(x), 256).alias("alnum"), T.preview(x, 20, 20).alias("preview"), F.sha2(T.mask_volatile(x), 256).alias("masked"))


def f1(s, d):
    """F1 of each text's words and the next one's as multisets; yes, no and noanswer match only themselves.

    Words are counted by an equi-join, since comparing all words of two long texts takes the square of their length.
    """
    lone = ["yes", "no", "noanswer"]
    a = docs(s, d).select("doc_id", T.answer_words(F.coalesce("text", F.lit(""))).alias("t"))
    a = a.select("doc_id", F.filter(F.split("t", " "), lambda w: w != "").alias("w"), F.when(F.col("t").isin(lone), F.col("t")).otherwise("").alias("lone"))
    words = a.select("doc_id", F.explode("w").alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    after = words.select((F.col("doc_id") - 1).alias("doc_id"), "w", F.col("n").alias("n_b"))
    same = words.join(after, ["doc_id", "w"]).groupBy("doc_id").agg(F.sum(F.least("n", "n_b")).alias("same"))
    sizes = a.select("doc_id", F.size("w").alias("n_a"), "lone")
    pairs = sizes.join(sizes.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n_a").alias("n_b"), F.col("lone").alias("lone_b")), "doc_id").join(same, "doc_id", "left")
    p, r = F.col("same") / F.col("n_a"), F.col("same") / F.col("n_b")
    return pairs.select("doc_id", F.round(F.when((F.col("lone") == F.col("lone_b")) & (F.col("same") > 0), 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def jaccards(s, d):
    a = docs(s, d).select("doc_id", F.array_distinct(T.norm_tokens(F.col("text"))).alias("a"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return a.join(b, "doc_id").select("doc_id", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(T.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


QUERIES = {
    "fn_norm_tokens": prompt_tokens, "fn_shingles_tuple": shingle_count("whole"), "fn_shingles_join": shingle_count("none"),
    "join_inverted_shingle": decontam, "except_contaminated": decontam_clean, "join_exact_benchmark": exact_benchmark,
    "agg_exact_dedup": exact_dedup, "agg_exact_dedup_audit": exact_audit, "agg_norm_dedup": norm_dedup, "agg_conflict_groups": conflicts,
    "join_lsh_candidates": near_pairs, "near_dedup_greedy": near_greedy, "fn_minhash": minhash,
    "sample_hash_order": hash_sample, "limit_prefix": prefix, "scan_row_slice": sliced, "filter_rank_contiguous": ranked("contiguous"), "filter_rank_strided": ranked("strided"),
    "agg_length_stats": length_stats, "agg_length_report": length_sets, "agg_retention": retention, "limit_select": limit_select, "agg_pp_changes": pp_changes,
    "agg_buckets": buckets, "agg_crosstab": crosstab, "agg_distribution": distribution, "agg_raw_marker_stats": markers, "agg_event_summary": event_summary,
    "filter_structural": structural, "agg_content_hash": content_hash, "join_valid_semi": semi_valid, "filter_conflicts_anti": anti_missing, "fn_vocab_compare": vocab_compare,
    "curation_funnel": pipeline_funnel, "fn_text_forms": text_forms, "rw_f1": f1, "fn_jaccard": jaccards,
}

PLAIN = r"""regexp_replace(lower(coalesce(text, '')), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g')"""
MARKED = rf"regexp_replace({PLAIN}, '([\pL\pN_]+)', chr(1) || '\1' || chr(1), 'g')"  # whole words between marks
ANSWER = rf"trim(regexp_replace(replace(regexp_replace({MARKED}, chr(1) || '(a|an|the)' || chr(1), ' ', 'g'), chr(1), ''), '\s+', ' ', 'g'))"
SQL = {
    "fn_norm_tokens": "SELECT doc_id, len(t)::BIGINT AS n_tokens, sha256(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[a-z0-9]+') AS t FROM documents)",
    "fn_shingles_tuple": shingle_sql("whole"),
    "fn_shingles_join": shingle_sql("none"),
    "join_inverted_shingle": PAIRS + "SELECT doc_id, item_id, shared, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM hit",
    "except_contaminated": PAIRS + "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit) GROUP BY 1",
    "join_exact_benchmark": f"SELECT count(*) AS n FROM (SELECT array_to_string({TOK}, ' ') AS k FROM documents) WHERE k NOT IN (SELECT array_to_string({TOK}, ' ') FROM benchmark)",
    "agg_exact_dedup": "SELECT doc_id, sha256(text) AS h, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "agg_exact_dedup_audit": "SELECT doc_id AS removed, f AS representative FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS f FROM documents) WHERE doc_id <> f",
    "agg_norm_dedup": f"SELECT doc_id, length(k)::BIGINT AS key_len FROM (SELECT doc_id, array_to_string({TOK}, ' ') AS k FROM documents) QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1",
    "agg_conflict_groups": f"SELECT sha256(array_to_string({TOK}, ' ')) AS h, count(*) AS n_rows, count(DISTINCT quality) AS n_targets, string_agg(DISTINCT lang, ',' ORDER BY lang) AS kinds FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) >= 2",
    "join_lsh_candidates": NEAR,
    "fn_minhash": f"WITH g AS (SELECT doc_id, unnest(CASE WHEN len(t) >= 5 THEN list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))) ELSE [] END) AS g FROM (SELECT doc_id, {TOK} AS t FROM documents)), h AS (SELECT doc_id, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM g), m AS (SELECT doc_id, " + " || ',' || ".join(f"min((h * {a} + {b}) % {T.PRIME})" for a, b in T.minhash_factors(16)) + " AS s FROM h GROUP BY 1) SELECT doc_id, coalesce(s, '') AS signature FROM documents LEFT JOIN m USING (doc_id)",
    "sample_hash_order": "SELECT doc_id, lang FROM documents ORDER BY sha256('42' || chr(0) || doc_id::VARCHAR), doc_id LIMIT 100",
    "limit_prefix": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS ord FROM documents WHERE length(text) <= 2000 QUALIFY ord < 150",
    "scan_row_slice": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS c FROM documents) WHERE o >= c - 120 AND o < c - 20",
    "filter_rank_contiguous": "SELECT (o // ceil(c / 8)::BIGINT)::BIGINT AS rank, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o, count(*) OVER () AS c FROM documents) GROUP BY 1",
    "filter_rank_strided": "SELECT (o % 8)::BIGINT AS rank, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) GROUP BY 1",
    "agg_length_stats": "SELECT lang, count(n_chars) AS n, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.75) AS p75, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS max_len, round(avg(n_chars), 2) AS mean_len, count(*) FILTER (n_chars <= 2000) AS le_2000, round(100 * count(*) FILTER (n_chars <= 2000) / count(n_chars), 4) AS le_2000_pct, count(*) FILTER (n_chars <= 4000) AS le_4000, round(100 * count(*) FILTER (n_chars <= 4000) / count(n_chars), 4) AS le_4000_pct FROM documents GROUP BY lang",
    "agg_length_report": "SELECT lang, bucket, count(*) AS n, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS longest FROM (SELECT *, least(n_chars // 1000, 9)::BIGINT AS bucket FROM documents) GROUP BY GROUPING SETS ((), (lang), (bucket))",
    "agg_retention": RETENTION + "SELECT max_len, lang, n, kept, round(kept / n, 6) AS share, round(100 * kept / sum(kept) OVER (PARTITION BY max_len) - 100 * n / sum(n) OVER (PARTITION BY max_len), 6) AS shift_pp FROM g",
    "limit_select": RETENTION + ", r AS (SELECT max_len, kept, n, kept / n AS share, abs(100 * kept / sum(kept) OVER (PARTITION BY max_len) - 100 * n / sum(n) OVER (PARTITION BY max_len)) AS shift FROM g), o AS (SELECT max_len, sum(kept) / sum(n) >= 0.9 AND min(share) >= 0.8 AND max(shift) <= 2 AS ok FROM r GROUP BY 1) SELECT coalesce(min(max_len) FILTER (ok), max(max_len)) AS chosen FROM o",
    "agg_pp_changes": "WITH k AS (SELECT 0 AS stage, lang FROM documents UNION ALL SELECT 1, lang FROM documents WHERE n_chars > 200 UNION ALL SELECT 2, lang FROM documents WHERE n_chars > 200 AND n_chars <= 4000), g AS (SELECT stage, lang, count(*) AS n, 100 * count(*) / sum(count(*)) OVER (PARTITION BY stage) AS pct FROM k GROUP BY 1, 2), h AS (SELECT *, coalesce(pct - lag(pct) OVER (PARTITION BY lang ORDER BY stage), 0) AS s, pct - first(pct) OVER (PARTITION BY lang ORDER BY stage) AS t FROM g) SELECT stage, lang, n, round(s, 6) AS step_pp, round(t, 6) AS total_pp, abs(s) > 0.5 AS warn FROM h",
    "agg_buckets": "SELECT CASE WHEN n_chars < 500 THEN '0-499' WHEN n_chars < 2000 THEN '500-1999' WHEN n_chars < 8000 THEN '2000-7999' ELSE '8000+' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "agg_crosstab": "SELECT lang || '|' || quality AS pair, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "agg_distribution": "SELECT k.lang, count(doc_id) AS n, round(100 * count(doc_id) / (SELECT count(*) FROM documents), 4) AS pct FROM (SELECT unnest(['en', 'de', 'fr', 'es', 'it']) AS lang) k LEFT JOIN documents USING (lang) GROUP BY 1",
    "agg_raw_marker_stats": "SELECT " + ", ".join(f"sum((length(text) - length(replace(text, '{m}', ''))) // {len(m)})::BIGINT AS {n}" for n, m in {"n_semi": ";", "n_pipe": "|", "n_bang": "!!", "n_license": "License"}.items()) + " FROM documents",
    "agg_event_summary": "WITH e AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'shout' END, CASE WHEN contains(text, '###') THEN 'marks' END, CASE WHEN contains(text, 'License') THEN 'license' END], lambda x: x IS NOT NULL)) AS code FROM documents) SELECT code, count(*) AS n_events, count(DISTINCT doc_id) AS n_rows, array_to_string(list_sort(list(DISTINCT doc_id))[1:5], ',') AS samples FROM e GROUP BY 1",
    "filter_structural": "SELECT doc_id, problems FROM (SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN n_chars <> length(text) THEN 'length' END, CASE WHEN contains(text, chr(9)) THEN 'tab' END, CASE WHEN length(text) > 20000 THEN 'long' END], lambda x: x IS NOT NULL)), ',') AS problems FROM documents) WHERE problems <> ''",
    "agg_content_hash": "SELECT doc_id // 100 AS part, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1",
    "join_valid_semi": "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1",
    "filter_conflicts_anti": "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
    "fn_vocab_compare": f"WITH w AS (SELECT DISTINCT lang, unnest({TOK}) AS w FROM documents WHERE lang IN ('en', 'de')), b AS (SELECT x.w AS a, y.w AS b FROM (SELECT w FROM w WHERE lang = 'en') x FULL JOIN (SELECT w FROM w WHERE lang = 'de') y ON x.w = y.w) SELECT count(*) AS symbols, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (a IS NULL) AS only_right FROM b",
    "curation_funnel": PAIRS + ", u AS (SELECT min(doc_id) AS doc_id FROM documents WHERE n_chars > 200 GROUP BY text), c AS (SELECT * FROM u WHERE doc_id NOT IN (SELECT doc_id FROM hit)) SELECT 0 AS step, 'raw' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'structural', count(*) FROM documents WHERE n_chars > 200 UNION ALL SELECT 2, 'unique', count(*) FROM u UNION ALL SELECT 3, 'clean', count(*) FROM c UNION ALL SELECT 4, 'fit', count(*) FROM c JOIN documents USING (doc_id) WHERE n_chars <= 4000",
    "rw_f1": f"WITH t AS (SELECT doc_id, {ANSWER} AS t FROM documents), a AS (SELECT doc_id, list_filter(string_split(t, ' '), lambda w: w <> '') AS a, CASE WHEN t IN ('yes', 'no', 'noanswer') THEN t ELSE '' END AS l FROM t), w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(a) AS w FROM a) GROUP BY 1, 2), m AS (SELECT x.doc_id, sum(least(x.n, y.n)) AS s FROM w x JOIN w y ON y.doc_id = x.doc_id + 1 AND y.w = x.w GROUP BY 1) SELECT x.doc_id, CASE WHEN x.l = y.l AND s > 0 THEN round(2 * (s / len(x.a)) * (s / len(y.a)) / (s / len(x.a) + s / len(y.a)), 6) ELSE 0 END AS f1 FROM a x JOIN a y ON y.doc_id = x.doc_id + 1 LEFT JOIN m ON m.doc_id = x.doc_id",
    "fn_jaccard": f"WITH a AS (SELECT doc_id, list_distinct({TOK}) AS a FROM documents), p AS (SELECT x.doc_id, x.a, y.a AS b FROM a x JOIN a y ON y.doc_id = x.doc_id + 1) SELECT doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS jaccard, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0), 6) AS overlap FROM p",
    "fn_text_forms": r"SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS lf, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::BIGINT AS squeezed, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS alnum, CASE WHEN length(text) > 40 THEN left(text, 20) || ' ... [' || (length(text) - 40) || ' chars] ... ' || right(text, 20) ELSE text END AS preview, sha256(regexp_replace(regexp_replace(lower(text), '^[ \t\n\x0b\x0c\r]+', ''), '[ \t\n\x0b\x0c\r]+$', '')) AS masked FROM documents",
}
