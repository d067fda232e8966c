"""Operators that other queries use inside, each with a query of its own, and measures in full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import text as T
from weftline.operators import batches, dedup, metrics, prompts, select
from weftline.plans.common import table
from weftline.plans.corpus import ANSWER, TOK
from weftline.plans.rollouts import GAE, PASSES, ordered, success
from weftline.plans.scores import H, Z, halves
from weftline.streaming import rollout


def docs(s, d):
    return table(s, d, "documents")


def events(s, d):
    return table(s, d, "events")


def r6(c):
    return F.round(c, 6)


def label_digest(s, d):
    return docs(s, d).select("doc_id", F.concat(F.lit("sha256:"), F.sha2(F.trim("text"), 256)).alias("label"))


def prefix_keys(s, d):
    """Metrics of each kind of event under names with a prefix."""
    m = events(s, d).groupBy("event_type").agg(F.create_map(F.lit("mean"), F.round(F.avg("value"), 4), F.lit("max"), F.max("value")).alias("m"))
    p = F.transform_keys("m", lambda k, v: F.concat(F.lit("rollout/"), k))
    return m.select("event_type", F.explode(p).alias("name", "value"))


def prompt_length(s, d):
    return docs(s, d).where(F.size(T.norm_tokens(F.col("text"))) <= 300).select("doc_id")


def nearest(s, d):
    return docs(s, d).groupBy("lang").agg(metrics.nearest_rank("n_chars", 0.5).alias("p50"), metrics.nearest_rank("n_chars", 0.9).alias("p90"), metrics.nearest_rank("n_chars", 0.99).alias("p99"))


def pass_hat(s, d):
    return metrics.pass_table(success(s, d), "user_id", F.col("ok") == 1, [1, 2, 4, 8]).select("k", "pass_hat_k", "tasks")


def pass_rate(s, d):
    """Raw rewards in groups of 8, as they stand in a batch: pass@k for powers of two."""
    rows = success(s, d).withColumn("g", F.floor(F.col("event_id") / 8))
    return metrics.pass_table(rows, "g", F.col("ok") == 1, [1, 2, 4, 8]).select("k", "pass_at_k", "tasks")


def row_number(s, d):
    return select.ordinals(events(s, d).select("user_id", "event_id"), ["user_id", "event_id"], "place")


def gae_chunked(s, d):
    both = ordered(s, d).withColumn("w", F.transform("v", lambda x: x / 10))
    adv, ret = A.gae(F.col("v"), F.col("w"), 0.99, 0.95, chunk=16)
    return both.select("user_id", adv.alias("a"), ret.alias("r")).select("user_id", F.posexplode(F.arrays_zip("a", "r")).alias("i", "x")).select("user_id", F.col("i").cast("long").alias("i"), F.round("x.a", 4).alias("advantage"), F.round("x.r", 4).alias("ret"))


def first_per_key(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dedup.first_per_key(o, ["o_custkey"], ["o_orderkey"])


def sample_buffer(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("at"))
    return rollout.serve(o.where("grp % 9 = 0"), o.where("grp % 9 <> 0"), 25, "at", "grp").groupBy("grp").agg(F.count("*").alias("n"))


def removed(s, d):
    """Documents without those whose prompts have several qualities, in whole groups."""
    rows = docs(s, d).select("doc_id", "lang", F.left("text", F.lit(3)).alias("h")).join(table(s, d, "labels"), "doc_id")
    bad = dedup.conflict_groups(rows, "h", "quality", "lang").select("h")
    return rows.join(bad, "h", "left_anti").select("doc_id")


def except_removed(s, d):
    gone = table(s, d, "labels").where("quality = 0 or toxic = 1").select("doc_id")
    return docs(s, d).select("doc_id", "lang").join(gone, "doc_id", "left_anti")


def except_names(s, d):
    """Names that only the first of two lists has."""
    f = table(s, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_linestatus").alias("a"), F.collect_set(F.when(F.col("l_quantity") > 49, F.col("l_linestatus"))).alias("b"))
    return f.select("l_suppkey", F.array_join(F.array_sort(F.array_except("a", "b")), ",").alias("unknown"))


def multiset(s, d):
    """Words that a text shares with the next one, as multisets."""
    w = docs(s, d).select("doc_id", F.explode(T.norm_tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    after = w.select((F.col("doc_id") - 1).alias("doc_id"), "w", F.col("n").alias("m"))
    return w.join(after, ["doc_id", "w"]).groupBy("doc_id").agg(F.sum(F.least("n", "m")).alias("shared"))


def overlap(s, d):
    a = table(s, d, "benchmark").select("item_id", F.array_distinct(T.norm_tokens(F.col("text"))).alias("a"))
    b = a.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return a.join(b, "item_id").select("item_id", r6(T.overlap(F.col("a"), F.col("b"))).alias("overlap"))


def answer_form(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.answer_words(F.coalesce("text", F.lit(""))), 256).alias("digest"))


def nearest_bucket(s, d):
    b = F.when(F.col("n_chars") < 500, "0-499").when(F.col("n_chars") < 2000, "500-1999").when(F.col("n_chars") < 8000, "2000-7999").otherwise("8000+")
    return docs(s, d).select("doc_id", b.alias("bucket"))


def off_policy(s, d):
    """Tokens that were made before this rollout are not trained on; the new ones are."""
    n = (F.col("event_id") % 5).cast("int")
    old = F.array_repeat(F.lit(1), n)
    mask = F.concat(F.transform(old, lambda m: F.lit(0)), F.array_repeat(F.lit(1), F.lit(3)))
    return events(s, d).select("event_id", F.array_join(mask.cast("array<string>"), "").alias("mask"))


def effective(s, d):
    """The sum of a mask, or the response's length without one."""
    n = (F.col("event_id") % 6).cast("int")
    mask = F.when(F.col("event_type") != "view", F.transform(F.array_repeat(F.lit(1), n), lambda x, i: (i % 2).cast("int")))
    return events(s, d).select("event_id", F.coalesce(F.aggregate(mask, F.lit(0), lambda a, x: a + x), n).cast("long").alias("n"))


def preview(s, d):
    return docs(s, d).select("doc_id", T.preview(F.col("text"), 30, 10).alias("preview"))


def newlines(s, d):
    x = F.regexp_replace(F.concat("text", F.lit("\r")), "\n", "\r\n")
    return docs(s, d).select("doc_id", F.sha2(T.newlines(x), 256).alias("digest"))


def normal_text(s, d):
    """NFC, line feeds, no white space at the ends, of texts that are taken apart first."""
    x = F.concat(F.lit(" \r\n"), F.regexp_replace(F.regexp_replace("text", "é", "é"), "\n", "\r\n"), F.lit("\t "))
    return docs(s, d).select("doc_id", F.sha2(T.py_nfc_strip(x), 256).alias("digest"))


def strip_thought(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.strip_thought(F.concat(F.lit("<think>a</think>b</think>"), "text")), 256).alias("digest"))


def alnum(s, d):
    return docs(s, d).select("doc_id", F.sha2(T.alnum_words(F.col("text")), 256).alias("digest"))


def volatile(s, d):
    x = F.concat(F.lit("  ID 123E4567-e89b-12d3-a456-426614174000 at 2020-01-02T03:04:05.6 or 2020-01-02 03:04:05 in /tmp/Abc/d "), F.coalesce("text", F.lit("")))
    return table(s, d, "conversations").select("conv_id", "turn", F.sha2(T.mask_volatile(x), 256).alias("digest"))


def low_var(s, d):
    return halves(s, d).select("vec_id", r6(A.total(F.zip_with("pre", "post", lambda a, b: A.low_var_kl_clamped(a * 9, b * 9)))).alias("kl"))


def icepop(s, d):
    return halves(s, d).select("vec_id", r6(A.total(F.zip_with("pre", "post", lambda a, b: A.band_weight(a * 3, b * 3, 0.7, 1.5)))).alias("weight"))


def support(s, d):
    """The six largest of a position's logits as log probabilities, with the normaliser of all of them."""
    t = A.top_k(F.col("pre"), F.sequence(F.lit(0), F.lit(31)), 6)
    z = A.log_sum_exp(F.col("pre"))
    return halves(s, d).select("vec_id", F.array_join(F.transform(t, lambda x: x["id"].cast("string")), ",").alias("ids"), r6(A.total(F.transform(t, lambda x: x["score"])) - 6 * z).alias("log_probs"), r6(z).alias("normaliser"))


def candidate_logs(s, d):
    """Log probabilities of candidates at a temperature; an id beyond the vocabulary is an error."""
    ids = F.array(*[F.pmod(F.col("vec_id") * k, F.lit(32)).cast("int") for k in (1, 5, 11)])
    return halves(s, d).select("vec_id", r6(A.total(A.candidate_log_probs(F.col("pre"), ids, 0.7))).alias("total"), r6(F.element_at(A.candidate_log_probs(F.col("pre"), ids, 0.7), 1)).alias("first"))


def fsdp(s, d):
    """Micro-batches of a step: as many as first fit needs for its tokens, filled evenly; a row longer than that is alone."""
    rows = docs(s, d).select("doc_id", F.floor(F.col("doc_id") / 40).alias("step"), F.size(F.split("text", " ", -1)).alias("n"))
    rule = lambda x: batches.largest_differencing(x, len(batches.first_fit(x, 4096)))
    return batches.deal(rows, "step", "doc_id", "n", rule).groupBy("step", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("load"))


def reasons(s, d):
    """Rejections by stage and reason, with the first ids of each."""
    code = F.when(F.col("n_chars") < 300, "length/short").when(F.col("text").contains("###"), "marks/hash").when(F.col("text").contains("!!"), "marks/shout")
    return metrics.summary(docs(s, d).select("doc_id", code.alias("code")).where("code is not null"), "code", "doc_id")


def token_lengths(s, d):
    return docs(s, d).select("doc_id", F.size(T.norm_tokens(F.col("text"))).cast("long").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n"))


def vocab_size(s, d):
    """The width that scores are normalised over: of a role's own, if a projection tells it, else the common or the model's."""
    k = F.col("c_custkey")
    mode, role = F.when(k % 2 == 0, "projection").otherwise("same"), F.when(k % 3 == 0, "pre").otherwise("post")
    sizes = F.create_map(F.lit("pre"), F.lit(1000))
    width = F.when(mode == "projection", F.coalesce(F.try_element_at(sizes, role), F.lit(5000))).otherwise(F.coalesce(F.when(k % 5 == 0, F.lit(3000)), F.lit(4000)))
    return table(s, d, "customer").select("c_custkey", width.cast("long").alias("width"))


def legacy_scale(s, d):
    """A scale that an old setting gives as a factor of its own formula, 1 + 0.1 ln(factor)."""
    return s.range(1, 9).select(F.col("id").alias("factor"), r6((1 + 0.1 * F.log(F.col("id").cast("double"))) * 0.8).alias("scale"))


def prefix_ratio(s, d):
    """How many optimizer steps a rollout makes, for batches of several sizes."""
    rows = [(b, *prompts.budget(b, 16, rollouts=10)) for b in (16, 32, 64, 128)]
    return s.createDataFrame(rows, "batch long, rollouts long, steps long").withColumn("ratio", F.col("steps") / F.col("rollouts"))


def messages(s, d):
    """Conversations with calls: an assistant's turn of even length calls a function."""
    t = table(s, d, "conversations").withColumn("call", F.when((F.col("role") == "assistant") & (F.length("text") % 2 == 0), F.concat(F.lit("f"), (F.col("turn") % 3).cast("string"))))
    return t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "call"))).alias("m"))


def stratum(s, d):
    """All of a row's structure: tools, policy, roles, calls, kind of target, its number of calls and their names."""
    names = F.transform(F.filter("m", lambda x: x["call"].isNotNull()), lambda x: x["call"])
    history = F.slice(names, F.lit(1), F.greatest(F.size(names) - 2, F.lit(0)))
    target = F.array_sort(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), F.lit(2)))
    kind = F.when(F.size(target) == 0, "none").when(F.size(target) == 1, "single").otherwise("parallel")
    first = F.element_at("m", 1)
    key = F.concat_ws("|", F.sha2((F.col("conv_id") % 2).cast("string"), 256), F.sha2(F.when(first["role"] == "system", first["text"]).otherwise(""), 256), F.array_join(F.transform("m", lambda x: F.left(x["role"], F.lit(1))), ""), F.array_join(history, ","), kind, F.size(target).cast("string"), F.array_join(target, ","))
    return messages(s, d).groupBy(F.sha2(key, 256).alias("stratum")).agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))


def target_kind(s, d):
    """By the number of calls of the last assistant's turn."""
    n = F.when(F.col("role") == "assistant", F.length("text") % 3)
    last = table(s, d, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "assistant", F.struct("turn", n.alias("n")))).alias("l"))
    k = F.coalesce("l.n", F.lit(0))
    return last.select("conv_id", F.when(k == 0, "text").when(k == 1, "single_call").otherwise("parallel_calls").alias("kind"))


def conversation_kind(s, d):
    """One user's message and no calls in the history is a single turn."""
    users = F.size(F.filter("m", lambda x: x["role"] == "user"))
    return messages(s, d).select("conv_id", F.when((users == 1) & ~F.exists("m", lambda x: x["call"].isNotNull()), "single_turn").otherwise("multi_turn").alias("kind"))


def row_contract(s, d):
    """Problems of a conversation, with those of calls: an unknown name, and a call that nothing answers."""
    m = F.col("m")
    n = F.size(m)
    after = F.zip_with(m, F.concat(F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("struct<turn:bigint,role:string,text:string,call:string>"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    codes = F.array(
        F.when(F.exists(m, lambda x: ~x["role"].isin("system", "user", "assistant", "tool")), "role"), F.when(F.element_at(m, 1)["role"] == "assistant", "start"), F.when(F.element_at(m, -1)["role"] != "assistant", "open"),
        F.when(F.exists(F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: x["role"] == "system"), "late_system"), F.when(F.exists(m, lambda x: F.trim(x["text"]) == ""), "empty"), F.when(F.exists(m, lambda x: x["text"].contains("<|")), "framing"),
        F.when(F.exists(m, lambda x: x["call"] == "f2"), "unknown_call"), F.when(F.exists(after, lambda p: p["a"]["call"].isNotNull() & (F.coalesce(p["b"]["role"], F.lit("")) == "assistant")), "unanswered_call"),
    )
    return messages(s, d).select("conv_id", F.array_join(F.array_sort(F.filter(codes, lambda x: x.isNotNull())), ",").alias("problems"))


def lane(s, d):
    """All measures of a lane: completeness, success, per-task means, ends, tokens, cut turns, cost and time."""
    e = events(s, d).withColumns({"ok": F.col("value") > 50, "tokens": F.floor(F.col("value") * 10).cast("long"), "cut": F.col("value") > 95})
    task = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("c"), F.avg(F.col("ok").cast("double")).alias("m"))
    two = F.when(F.col("n") >= 2, A.pass_hat_k(F.col("n"), F.col("c"), F.lit(2).cast("long")))
    tasks = task.groupBy("event_type").agg(F.count("*").alias("tasks"), F.count_if(F.col("n") >= 3).alias("complete"), r6(F.avg("m")).alias("task_mean"), r6(F.avg(two)).alias("pass_hat_2"))
    p = lambda q: metrics.exact_rank(e, "event_type", "tokens", q, f"t{int(q * 100)}")
    rows = e.groupBy("event_type").agg(
        F.count("*").alias("records"), r6(F.avg(F.col("ok").cast("double"))).alias("success"), F.count_if("cut").alias("cut_turns"), F.round(F.sum("value") / 100, 4).alias("cost"), F.round(F.avg("value"), 6).alias("seconds"),
        F.max("tokens").alias("t_max"), F.countDistinct(F.to_date("ts")).alias("days"), F.count_if(F.col("value") < 5).alias("ended_early"),
    )
    return rows.join(tasks, "event_type").join(p(0.5), "event_type").join(p(0.95), "event_type")


def objective(s, d):
    """Means over masked tokens of two terms, each averaged over its candidates first, and their weighted sum."""
    grid = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice(c, t * 4 + 1, 4))
    x = halves(s, d).withColumns({"direct": F.transform(grid("post"), lambda r: A.total(r) / 4), "kl": F.transform(F.zip_with(grid("pre"), grid("post"), lambda a, b: F.zip_with(a, b, lambda p, q: (p - q) * (p - q))), lambda r: A.total(r) / 4), "mask": F.transform(F.slice("pre", 1, 8), lambda v: (v > 0).cast("int"))})
    sums = x.agg(*[F.sum(A.dot(F.col(c), F.col("mask").cast("array<double>"))).alias(c) for c in ("direct", "kl")], F.sum(A.total(F.col("mask").cast("array<double>"))).alias("n"))
    of = lambda c: F.col(c) / F.greatest("n", F.lit(1.0))
    return sums.select(F.col("n").cast("long").alias("tokens"), r6(of("direct")).alias("direct"), r6(of("kl")).alias("kl"), r6(of("direct") + 0.3 * of("kl")).alias("total"))


def speculation(s, d):
    """Means of accepted per drafted token and of tokens per verification; samples without any count as zero."""
    e = events(s, d).withColumns({"a": F.floor("value") % 7, "b": F.floor("value") % 9, "v": F.col("event_id") % 4})
    rate, length = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0), F.when(F.col("v") > 0, F.col("value") / F.col("v")).otherwise(0.0)
    return e.groupBy("event_type").agg(r6(F.avg(rate)).alias("accept_rate"), r6(F.avg(length)).alias("accept_length"))


def mixture(s, d):
    """A mixture's manifest: problems of weights that don't sum to one, names that repeat, and parts of unequal or broken groups."""
    parts = table(s, d, "lineitem").groupBy((F.col("l_orderkey") % 7).alias("mix"), F.col("l_returnflag").alias("name")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("mix")
    parts = parts.withColumn("weight", F.when(F.col("mix") == 3, F.col("n") / F.sum("n").over(w) / 2).otherwise(F.col("n") / F.sum("n").over(w)))
    parts = parts.unionByName(parts.where("mix = 5 and name = 'A'").withColumn("weight", F.lit(0.0)))
    return metrics.mixture_problems(parts, "mix", "name", "weight", "n", 4)


def train_data(s, d):
    """Training columns: masks of ones by default and of zeros for removed samples, raw rewards, and a column that all rows have."""
    n = (F.col("event_id") % 5 + 1).cast("int")
    given = F.when(F.col("event_id") % 3 == 0, F.transform(F.sequence(F.lit(1), n), lambda i: (i % 2).cast("int")))
    e = events(s, d).withColumns({"removed": F.col("event_type") == "error", "mask": F.coalesce(given, F.array_repeat(F.lit(1), n))})
    mask = F.when(F.col("removed"), F.transform("mask", lambda m: F.lit(0))).otherwise(F.col("mask"))
    every = e.agg(F.bool_and(F.get_json_object("props", "$.k").isNotNull()).alias("all_have_k"))
    x = e.select("event_id", F.array_join(mask.cast("array<string>"), "").alias("mask"), (F.col("value") > 95).cast("int").alias("truncated"), F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.col("value")).alias("raw_reward"))
    return x.crossJoin(F.broadcast(every))  # one row


def rendered_dedup(s, d):
    """Rows whose rendered prompts are equal, by the first of them, among prompts that are short enough."""
    one = F.transform("m", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n")))
    rows = messages(s, d).select("conv_id", F.array_join(one, "").alias("prompt")).where(F.length("prompt") <= 4000)
    return dedup.first_per_key(rows.select("conv_id", F.sha2("prompt", 256).alias("h")), ["h"], ["conv_id"])


def all_other(s, d):
    h = halves(s, d).withColumn("p", A.topk_other(F.transform("pre", lambda x: x - 5)))
    return h.select("vec_id", r6(F.element_at("p", -1)).alias("rest"), r6(F.element_at("p", 1)).alias("first"), F.size("p").cast("long").alias("n"))


def columns(s, d):
    """Means of a rollout's columns: of numbers plain, of scores over masked tokens, of flags their share."""
    x = halves(s, d).withColumn("m", F.transform("pre", lambda v: (v > 0).cast("int")))
    return x.agg(r6(F.avg("label")).alias("label"), r6(F.avg(A.masked_mean(F.col("post"), F.col("m")))).alias("post"), r6(F.avg((F.col("label") > 4).cast("double"))).alias("high"), F.count("*").alias("rows"))


def dense(s, d):
    """Rows as a matrix: all of one width, or an error; sums of its columns."""
    v = A.same_width(F.col("embedding"), 64)
    return table(s, d, "embeddings").select(F.posexplode(v).alias("i", "x")).groupBy(F.col("i").cast("long").alias("i")).agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


def over_sampling(s, d):
    """The first groups that pass, in order of completion, and how many of the others there are by reason; what passes
    beyond the target is left over."""
    g = events(s, d).groupBy("user_id").agg(F.max("event_id").alias("at"), F.avg("value").alias("m"), F.count("*").alias("n"))
    g = g.withColumn("reason", F.when(F.col("m") <= 50, "low").when(F.col("n") < 3, "few")).withColumn("keep", F.col("reason").isNull())
    kept, dropped = rollout.keep_until(g, "keep", "at", 12)
    return kept.select(F.lit("kept").alias("what"), F.col("user_id").cast("string").alias("name"), F.lit(1).cast("long").alias("n")).unionByName(dropped.select(F.lit("dropped").alias("what"), F.col("reason").alias("name"), F.col("count").alias("n")))


def card(s, d):
    """A crosstab of two columns as three kinds, with its shares."""
    x = docs(s, d).join(table(s, d, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))
    kind = F.when((F.col("lang") == "en") & (F.col("quality") == 1), "english").when(F.col("quality") == 1, "other_language").otherwise("rejected")
    by = x.groupBy(kind.alias("category")).agg(F.sum("n").alias("n"))
    return by.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


QUERIES = {
    "proj_label_digest": label_digest, "proj_prefix_keys": prefix_keys, "filter_prompt_length": prompt_length, "agg_percentile_nearest": nearest, "agg_pass_hat_k": pass_hat, "agg_passrate_log": pass_rate, "win_row_number": row_number, "win_gae_chunked": gae_chunked,
    "win_first_per_key": first_per_key, "union_sample_buffer": sample_buffer, "filter_conflicts": removed, "except_removed": except_removed, "except_names": except_names, "multiset_overlap": multiset, "fn_overlap": overlap, "fn_norm_answer_f1": answer_form, "fn_nearest_bucket": nearest_bucket,
    "st_mask_offpolicy": off_policy, "fn_effective_len": effective, "proj_log_preview": preview, "fn_newlines": newlines, "fn_normalize_text": normal_text, "fn_strip_cot": strip_thought, "fn_norm_alnum": alnum, "fn_norm_volatile": volatile, "fn_low_var_kl": low_var, "fn_icepop": icepop,
    "topk_support": support, "fn_candidate_logprob": candidate_logs, "pk_fsdp": fsdp, "agg_reason_summary": reasons, "agg_token_lengths": token_lengths, "fn_norm_vocab_size": vocab_size, "fn_legacy_scale": legacy_scale, "fn_prefix_ratio": prefix_ratio, "fn_stratum": stratum, "fn_target_kind": target_kind,
    "fn_conversation_kind": conversation_kind, "pred_row_contract": row_contract, "agg_lane_summary": lane, "agg_objective": objective, "agg_spec_metrics": speculation, "pred_mixture_manifest": mixture, "proj_train_data": train_data, "agg_rendered_dedup": rendered_dedup, "fn_topk_other": all_other,
    "agg_rollout_columns": columns, "proj_dense_tensor": dense, "st_over_sampling": over_sampling, "agg_card_compare": card,
}
HAT = PASSES.replace("round(avg(p), 6) AS pass_at_k, ", "")
RATE = PASSES.replace("user_id, count(*) AS n", "event_id // 8 AS user_id, count(*) AS n").replace(", round(avg(h), 6) AS pass_hat_k", "")
CALLS = "WITH c AS (SELECT *, CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN 'f' || (turn % 3) END AS call FROM conversations)"
SQL = {
    "proj_label_digest": "SELECT doc_id, 'sha256:' || sha256(trim(text)) AS label FROM documents",
    "proj_prefix_keys": "SELECT event_type, 'rollout/mean' AS name, round(avg(value), 4) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'rollout/max', max(value) FROM events GROUP BY 1",
    "filter_prompt_length": f"SELECT doc_id FROM documents WHERE len({TOK}) <= 300",
    "agg_percentile_nearest": "SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99 FROM documents GROUP BY 1",
    "agg_pass_hat_k": HAT,
    "agg_passrate_log": RATE,
    "win_row_number": "SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, event_id) - 1 AS place FROM events",
    "win_gae_chunked": GAE,
    "win_first_per_key": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "union_sample_buffer": "WITH g AS (SELECT o_custkey AS grp, min(o_orderkey) AS f, count(*) AS n FROM orders GROUP BY 1) SELECT grp, n FROM g ORDER BY CASE WHEN grp % 9 = 0 THEN 0 ELSE 1 END, f LIMIT 25",
    "filter_conflicts": "WITH r AS (SELECT doc_id, left(text, 3) AS h, quality FROM documents JOIN labels USING (doc_id)) SELECT doc_id FROM r WHERE h NOT IN (SELECT h FROM r GROUP BY 1 HAVING count(DISTINCT quality) >= 2)",
    "except_removed": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)",
    "except_names": "WITH f AS (SELECT l_suppkey, list(DISTINCT l_linestatus) AS a, coalesce(list(DISTINCT l_linestatus) FILTER (l_quantity > 49), []) AS b FROM lineitem GROUP BY 1) SELECT l_suppkey, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS unknown FROM f",
    "multiset_overlap": f"WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({TOK}) AS w FROM documents) GROUP BY 1, 2) SELECT a.doc_id, sum(least(a.n, b.n))::BIGINT AS shared FROM w a JOIN w b ON b.doc_id = a.doc_id + 1 AND a.w = b.w GROUP BY 1",
    "fn_overlap": f"WITH a AS (SELECT item_id, list_distinct({TOK}) AS a FROM benchmark) SELECT x.item_id, round(coalesce(len(list_intersect(x.a, y.a)) / nullif(least(len(x.a), len(y.a)), 0), 0), 6) AS overlap FROM a x JOIN a y ON y.item_id = x.item_id + 1",
    "fn_norm_answer_f1": f"SELECT doc_id, sha256({ANSWER}) AS digest FROM documents",
    "fn_nearest_bucket": "SELECT doc_id, CASE WHEN n_chars < 500 THEN '0-499' WHEN n_chars < 2000 THEN '500-1999' WHEN n_chars < 8000 THEN '2000-7999' ELSE '8000+' END AS bucket FROM documents",
    "st_mask_offpolicy": "SELECT event_id, repeat('0', (event_id % 5)::INT) || '111' AS mask FROM events",
    "fn_effective_len": "SELECT event_id, CASE WHEN event_type = 'view' THEN event_id % 6 ELSE event_id % 6 // 2 END AS n FROM events",
    "proj_log_preview": "SELECT doc_id, CASE WHEN length(text) > 40 THEN left(text, 30) || ' ... [' || (length(text) - 40) || ' chars] ... ' || right(text, 10) ELSE text END AS preview FROM documents",
    "fn_newlines": "SELECT doc_id, sha256(text || chr(10)) AS digest FROM documents",
    "fn_normalize_text": r"SELECT doc_id, sha256(regexp_replace(regexp_replace(nfc_normalize(text), '^\s+', ''), '\s+$', '')) AS digest FROM documents",
    "fn_strip_cot": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "fn_norm_alnum": "SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents",
    "fn_norm_volatile": r"SELECT conv_id, turn, sha256(regexp_replace('id <uuid> at <timestamp>.6 or <timestamp> in /tmp/<tmp>/d ' || lower(coalesce(text, '')), '\s+$', '')) AS digest FROM conversations",
    "fn_low_var_kl": H + f" SELECT vec_id, round({Z('least(greatest(exp(9 * B - 9 * A) - 1 - (9 * B - 9 * A), -10), 10)')}, 6) AS kl FROM h",
    "fn_icepop": H + f" SELECT vec_id, round({Z('CASE WHEN exp(3 * A - 3 * B) BETWEEN 0.7 AND 1.5 THEN exp(3 * A - 3 * B) ELSE 0 END')}, 6) AS weight FROM h",
    "topk_support": H + ", x AS (SELECT vec_id, unnest(i) - 1 AS id, unnest(pre) AS v FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) AS k, ln(sum(exp(v)) OVER (PARTITION BY vec_id)) AS z FROM x) SELECT vec_id, string_agg(id::VARCHAR, ',' ORDER BY k) AS ids, round(sum(v - z), 6) AS log_probs, round(min(z), 6) AS normaliser FROM r WHERE k <= 6 GROUP BY 1",
    "fn_candidate_logprob": H + ", z AS (SELECT vec_id, pre, ln(list_sum(list_transform(pre, lambda x: exp(x / 0.7)))) AS z FROM h), c AS (SELECT vec_id, list_transform([1, 5, 11], lambda k: pre[(vec_id * k) % 32 + 1] / 0.7 - z) AS c FROM z) SELECT vec_id, round(list_sum(c), 6) AS total, round(c[1], 6) AS first FROM c",
    "agg_reason_summary": "WITH c AS (SELECT doc_id, CASE WHEN n_chars < 300 THEN 'length/short' WHEN contains(text, '###') THEN 'marks/hash' WHEN contains(text, '!!') THEN 'marks/shout' END AS code FROM documents) SELECT code, count(*) AS n_events, count(DISTINCT doc_id) AS n_rows, array_to_string(list_sort(list(DISTINCT doc_id))[1:5], ',') AS samples FROM c WHERE code IS NOT NULL GROUP BY 1",
    "agg_token_lengths": f"SELECT len({TOK})::BIGINT AS n_tokens, count(*) AS n FROM documents GROUP BY 1",
    "fn_norm_vocab_size": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 1000 ELSE 5000 END WHEN c_custkey % 5 = 0 THEN 3000 ELSE 4000 END::BIGINT AS width FROM customer",
    "fn_legacy_scale": "SELECT i AS factor, round((1 + 0.1 * ln(i)) * 0.8, 6) AS scale FROM (SELECT unnest(range(1, 9)) AS i)",
    "fn_prefix_ratio": "SELECT b AS batch, 10::BIGINT AS rollouts, 10 * b // 16 AS steps, b / 16 AS ratio FROM (SELECT unnest([16, 32, 64, 128])::BIGINT AS b)",
    "fn_stratum": CALLS + """, g AS (SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS r, CASE WHEN arg_min(role, turn) = 'system' THEN arg_min(text, turn) ELSE '' END AS p, coalesce(list(call ORDER BY turn) FILTER (call IS NOT NULL), []) AS n FROM c GROUP BY 1),
k AS (SELECT conv_id, r, p, n[1:greatest(len(n) - 2, 0)] AS h, list_sort(n[greatest(len(n) - 1, 1):]) AS t FROM g)
SELECT sha256(sha256((conv_id % 2)::VARCHAR) || '|' || sha256(p) || '|' || r || '|' || array_to_string(h, ',') || '|' || CASE len(t) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'parallel' END || '|' || len(t) || '|' || array_to_string(t, ',')) AS stratum, count(*) AS n, min(conv_id) AS first FROM k GROUP BY 1""",
    "fn_target_kind": "WITH l AS (SELECT conv_id, coalesce(arg_max(length(text) % 3, turn) FILTER (role = 'assistant'), 0) AS n FROM conversations GROUP BY 1) SELECT conv_id, CASE n WHEN 0 THEN 'text' WHEN 1 THEN 'single_call' ELSE 'parallel_calls' END AS kind FROM l",
    "fn_conversation_kind": CALLS + " SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') = 1 AND count(call) = 0 THEN 'single_turn' ELSE 'multi_turn' END AS kind FROM c GROUP BY 1",
    "pred_row_contract": CALLS + ", n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM c) SELECT conv_id, array_to_string(list_sort(list_filter([CASE WHEN bool_or(role NOT IN ('system', 'user', 'assistant', 'tool')) THEN 'role' END, CASE WHEN arg_min(role, turn) = 'assistant' THEN 'start' END, CASE WHEN arg_max(role, turn) <> 'assistant' THEN 'open' END, CASE WHEN bool_or(role = 'system' AND o > 1) THEN 'late_system' END, CASE WHEN bool_or(trim(text) = '') THEN 'empty' END, CASE WHEN bool_or(contains(text, '<|')) THEN 'framing' END, CASE WHEN bool_or(call = 'f2') THEN 'unknown_call' END, CASE WHEN bool_or(call IS NOT NULL AND nx = 'assistant') THEN 'unanswered_call' END], lambda x: x IS NOT NULL)), ',') AS problems FROM n GROUP BY 1",
    "agg_lane_summary": """WITH e AS (SELECT *, value > 50 AS ok, floor(value * 10)::BIGINT AS tokens FROM events), t AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (ok) AS c, avg(ok::INT) AS m FROM e GROUP BY 1, 2),
k AS (SELECT event_type, count(*) AS tasks, count(*) FILTER (n >= 3) AS complete, round(avg(m), 6) AS task_mean, round(avg(CASE WHEN n >= 2 THEN greatest(c, 0) / n * greatest(c - 1, 0) / (n - 1) END), 6) AS pass_hat_2 FROM t GROUP BY 1)
SELECT event_type, count(*) AS records, round(avg(ok::INT), 6) AS success, count(*) FILTER (value > 95) AS cut_turns, round(sum(value) / 100, 4) AS cost, round(avg(value), 6) AS seconds, max(tokens) AS t_max, count(DISTINCT ts::DATE) AS days, count(*) FILTER (value < 5) AS ended_early,
  any_value(tasks) AS tasks, any_value(complete) AS complete, any_value(task_mean) AS task_mean, any_value(pass_hat_2) AS pass_hat_2, list_sort(list(tokens))[least(count(*), floor(count(*) * 0.5::DOUBLE)::BIGINT + 1)] AS t50, list_sort(list(tokens))[least(count(*), floor(count(*) * 0.95::DOUBLE)::BIGINT + 1)] AS t95
FROM e JOIN k USING (event_type) GROUP BY 1""",
    "agg_objective": H + ", t AS (SELECT list_sum(post[4 * t + 1:4 * t + 4]) / 4 AS d, list_sum(list_transform(range(1, 5), lambda k: pow(pre[4 * t + k] - post[4 * t + k], 2))) / 4 AS k FROM h, (SELECT unnest(range(8)) AS t) WHERE pre[t + 1] > 0) SELECT count(*) AS tokens, round(avg(d), 6) AS direct, round(avg(k), 6) AS kl, round(avg(d) + 0.3 * avg(k), 6) AS total FROM t",
    "agg_spec_metrics": "SELECT event_type, round(avg(CASE WHEN floor(value)::BIGINT % 9 > 0 THEN (floor(value)::BIGINT % 7) / (floor(value)::BIGINT % 9) ELSE 0 END), 6) AS accept_rate, round(avg(CASE WHEN event_id % 4 > 0 THEN value / (event_id % 4) ELSE 0 END), 6) AS accept_length FROM events GROUP BY 1",
    "pred_mixture_manifest": "WITH p AS (SELECT l_orderkey % 7 AS mix, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 1, 2), g AS (SELECT mix, count(*) FILTER (n % 4 <> 0) AS b, count(DISTINCT n) AS k FROM p GROUP BY 1) SELECT mix, array_to_string(list_sort(list_filter([CASE WHEN mix = 5 THEN 'names' END, CASE WHEN mix = 3 THEN 'weights' END, CASE WHEN b > 0 THEN 'groups' END, CASE WHEN k > 1 THEN 'unequal' END], lambda x: x IS NOT NULL)), ',') AS problems FROM g",
    "proj_train_data": "SELECT event_id, CASE WHEN event_type = 'error' THEN repeat('0', (event_id % 5 + 1)::INT) WHEN event_id % 3 = 0 THEN left('10101', (event_id % 5 + 1)::INT) ELSE repeat('1', (event_id % 5 + 1)::INT) END AS mask, (value > 95)::INT AS truncated, coalesce((props->>'k')::DOUBLE, value) AS raw_reward, (SELECT bool_and(props->>'k' IS NOT NULL) FROM events) AS all_have_k FROM events",
    "agg_rendered_dedup": "WITH p AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS p FROM conversations GROUP BY 1) SELECT min(conv_id) AS conv_id, sha256(p) AS h FROM p WHERE length(p) <= 4000 GROUP BY p",
    "fn_topk_other": H + ", e AS (SELECT vec_id, list_transform(pre, lambda x: exp(x - 5)) AS e FROM h), f AS (SELECT vec_id, e, greatest(1 - list_sum(e), 1e-8) AS r FROM e) SELECT vec_id, round(r / (r + list_sum(e)), 6) AS rest, round(e[1] / (r + list_sum(e)), 6) AS first, 33::BIGINT AS n FROM f",
    "agg_rollout_columns": H + " SELECT round(avg(label), 6) AS label, round(avg(coalesce(list_sum(list_transform(list_filter(i, lambda k: pre[k] > 0), lambda k: post[k])), 0) / greatest(len(list_filter(pre, lambda x: x > 0)), 1)), 6) AS post, round(avg((label > 4)::INT), 6) AS high, count(*) AS rows FROM h",
    "proj_dense_tensor": "SELECT i, round(sum(embedding[i + 1]::DOUBLE), 4) AS total FROM embeddings, (SELECT unnest(range(64)) AS i) GROUP BY 1",
    "st_over_sampling": "WITH g AS (SELECT user_id, max(event_id) AS t, CASE WHEN avg(value) <= 50 THEN 'low' WHEN count(*) < 3 THEN 'few' END AS r FROM events GROUP BY 1) (SELECT 'kept' AS what, user_id::VARCHAR AS name, 1::BIGINT AS n FROM g WHERE r IS NULL ORDER BY t LIMIT 12) UNION ALL SELECT 'dropped', r, count(*) FROM g WHERE r IS NOT NULL GROUP BY 2",
    "agg_card_compare": "WITH x AS (SELECT CASE WHEN quality <> 1 THEN 'rejected' WHEN lang = 'en' THEN 'english' ELSE 'other_language' END AS category FROM documents JOIN labels USING (doc_id)) SELECT category, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM x GROUP BY 1",
}
