"""Dialogues, on `conversations`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import dedup
from weftline.plans.common import table


def turns(s, d):
    return table(s, d, "conversations")


def talks(s, d):
    """(conv_id, messages): a conversation's turns in order."""
    return turns(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def roles(s, d):
    return talks(s, d).select("conv_id", F.array_join(F.transform("messages", lambda m: F.left(m["role"], F.lit(1))), "").alias("roles"))


def kind(s, d):
    users = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    return talks(s, d).groupBy(F.when(users == 1, "single_turn").otherwise("multi_turn").alias("kind")).agg(F.count("*").alias("n"))


def target_kind(s, d):
    n = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    k = F.when(n == 0, "none").when(n == 1, "single").otherwise("parallel")
    return talks(s, d).groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


def same_role(s, d):
    """Adjacent turns that are alike, here by a third of their lengths, as roles take turns in these tables."""
    t = turns(s, d).withColumn("half", F.floor(F.length("text") % 3))
    return dedup.lag_pairs(t, "conv_id", "turn", "half").groupBy("role", "half").agg(F.count("*").alias("n"))


def dialogue(s, d):
    parts = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return talks(s, d).select("conv_id", F.sha2(F.array_join(parts, "\n"), 256).alias("digest"), F.length(F.array_join(parts, "\n")).cast("long").alias("n_chars"))


def last_user(s, d):
    u = F.filter("messages", lambda m: m["role"] == "user")
    return talks(s, d).where(F.size(u) > 0).select("conv_id", F.left(T.squeeze(F.element_at(u, -1)["text"]), F.lit(160)).alias("excerpt"))


def render(s, d):
    """A fixed chat template, with or without the mark that asks for an answer."""
    one = F.transform("messages", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["text"], F.lit("\n")))
    body = F.concat(F.array_join(one, ""), F.when(F.element_at("messages", -1)["role"] == "user", "<|assistant|>\n").otherwise(""))
    return talks(s, d).select("conv_id", F.sha2(body, 256).alias("digest"))


def rendered_dedup(s, d):
    first = F.element_at("messages", 1)["text"]
    rows = talks(s, d).select("conv_id", F.sha2(first, 256).alias("h"))
    return dedup.first_per_key(rows, ["h"], ["conv_id"]).agg(F.count("*").alias("kept"), F.sum("conv_id").alias("ids"))


def loss_mask(s, d):
    """Ones on the words of assistant turns."""
    words = lambda m: F.size(F.split(m["text"], " ", -1))
    mask = F.flatten(F.transform("messages", lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), words(m))))
    return talks(s, d).select("conv_id", F.size(mask).cast("long").alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("ones"))


def unanswered(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(s, d).withColumn("next", F.lead("role").over(w))
    return t.where((F.col("role") == "user") & (F.coalesce(F.col("next"), F.lit("")) != "assistant")).select("conv_id", "turn")


def contract(s, d):
    """Problems of a conversation: codes, sorted and distinct."""
    m = F.col("messages")
    n = F.size(m)
    codes = F.array(
        F.when(F.exists(m, lambda x: ~x["role"].isin("system", "user", "assistant", "tool")), "role"), F.when(F.element_at(m, -1)["role"] != "assistant", "open"),
        F.when(F.exists(F.slice(m, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x: x["role"] == "system"), "late_system"), F.when(F.exists(m, lambda x: F.trim(x["text"]) == ""), "empty"),
        F.when(F.exists(m, lambda x: x["text"].contains("<|")), "framing"), F.when(F.element_at(m, -1)["turn"] != n - 1, "gap"),
    )
    return talks(s, d).select("conv_id", F.array_join(F.array_sort(F.filter(codes, lambda x: x.isNotNull())), ",").alias("problems"))


def expansion(s, d):
    """A row for each user turn that gets an answer, with the words of answers before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = F.when(F.col("role") == "assistant", F.size(F.split("text", " ", -1))).otherwise(0)
    t = turns(s, d).withColumn("start_step", F.coalesce(F.sum(words).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next", F.lead("role").over(w))
    return t.where("role = 'user' and next = 'assistant'").select("conv_id", "turn", F.col("start_step").cast("long").alias("start_step"))


def prefix(s, d):
    """The messages before the last user turn."""
    u = F.array_max(F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: m["turn"]))
    return talks(s, d).withColumn("u", u).where("u is not null").select("conv_id", F.size(F.filter("messages", lambda m: m["turn"] < F.col("u"))).cast("long").alias("n"))


def stratum(s, d):
    first = F.element_at("messages", 1)
    key = F.concat_ws("|", F.array_join(F.transform("messages", lambda m: F.left(m["role"], F.lit(1))), ""), F.sha2(F.when(first["role"] == "system", first["text"]).otherwise(""), 256))
    return talks(s, d).groupBy(F.sha2(key, 256).alias("stratum")).agg(F.count("*").alias("n")).where("n > 1")


def measure(s, d):
    """Words of the system turn, of the history and of the whole prompt."""
    n = lambda m: F.size(F.split(m["text"], " ", -1))
    total = lambda keep: F.aggregate(F.filter("messages", keep), F.lit(0), lambda a, m: a + n(m)).cast("long")
    return talks(s, d).select("conv_id", total(lambda m: m["role"] == "system").alias("system_words"), total(lambda m: m["role"] != "system").alias("history_words"), total(lambda m: F.lit(True)).alias("words"))


def multi_turn(s, d):
    n = F.size(F.split("text", " ", -1))
    by = turns(s, d).groupBy("conv_id").agg(F.sum(n).alias("raw"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("own"), F.count("*").alias("rounds"))
    return by.agg(F.round(F.avg("raw"), 6).alias("raw_mean"), F.max("raw").alias("raw_max"), F.min("raw").alias("raw_min"), F.round(F.avg("own"), 6).alias("own_mean"), F.round(F.avg((F.col("raw") > 1000).cast("double")), 6).alias("clipped"), F.round(F.avg("rounds"), 6).alias("rounds"))


QUERIES = {
    "fn_role_sequence": roles, "win_lag_pairs": same_role, "fn_dialogue_text": dialogue, "proj_excerpt": last_user,
    "proj_chat_render": render, "fn_loss_mask_multi_turn": loss_mask, "filter_unanswered": unanswered, 
    "scan_turn_expansion": expansion, "proj_prefix_messages": prefix, "agg_measure_row": measure, "agg_multi_turn": multi_turn,
}
G = "WITH g AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn) AS m FROM conversations GROUP BY 1)"
SQL = {
    "fn_role_sequence": "SELECT conv_id, string_agg(left(role, 1), '' ORDER BY turn) AS roles FROM conversations GROUP BY 1",
    "win_lag_pairs": "SELECT role, half, count(*) AS n FROM (SELECT role, length(text) % 3 AS half, lag(length(text) % 3) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE half = b GROUP BY 1, 2",
    "fn_dialogue_text": "SELECT conv_id, sha256(t) AS digest, length(t)::BIGINT AS n_chars FROM (SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'system'), '') AS t FROM conversations GROUP BY 1)",
    "proj_excerpt": r"SELECT conv_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160) AS excerpt FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "proj_chat_render": "SELECT conv_id, sha256(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) || CASE WHEN arg_max(role, turn) = 'user' THEN '<|assistant|>' || chr(10) ELSE '' END) AS digest FROM conversations GROUP BY 1",
    "fn_loss_mask_multi_turn": "SELECT conv_id, sum(w)::BIGINT AS n, coalesce(sum(w) FILTER (role = 'assistant'), 0)::BIGINT AS ones FROM (SELECT *, len(string_split(text, ' ')) AS w FROM conversations) GROUP BY 1",
    "filter_unanswered": "SELECT conv_id, turn FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) WHERE role = 'user' AND coalesce(nx, '') <> 'assistant'",
    "scan_turn_expansion": "SELECT conv_id, turn, coalesce(s, 0)::BIGINT AS start_step FROM (SELECT *, lead(role) OVER w AS nx, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nx = 'assistant'",
    "proj_prefix_messages": "SELECT c.conv_id, count(*) FILTER (turn < u)::BIGINT AS n FROM conversations c JOIN (SELECT conv_id, max(turn) AS u FROM conversations WHERE role = 'user' GROUP BY 1) USING (conv_id) GROUP BY 1",
    "agg_measure_row": "SELECT conv_id, coalesce(sum(w) FILTER (role = 'system'), 0)::BIGINT AS system_words, coalesce(sum(w) FILTER (role <> 'system'), 0)::BIGINT AS history_words, sum(w)::BIGINT AS words FROM (SELECT *, len(string_split(text, ' ')) AS w FROM conversations) GROUP BY 1",
    "agg_multi_turn": "WITH b AS (SELECT conv_id, sum(w) AS raw, coalesce(sum(w) FILTER (role = 'assistant'), 0) AS own, count(*) AS rounds FROM (SELECT *, len(string_split(text, ' ')) AS w FROM conversations) GROUP BY 1) SELECT round(avg(raw), 6) AS raw_mean, max(raw)::BIGINT AS raw_max, min(raw)::BIGINT AS raw_min, round(avg(own), 6) AS own_mean, round(avg((raw > 1000)::INT), 6) AS clipped, round(avg(rounds), 6) AS rounds FROM b",
}


def parsed(s, d):
    """Conversations in their serialized form, parsed again: messages, or the reason of a rejection."""
    from weftline.functions import dialogue as D

    block = F.transform("messages", lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["text"], F.lit("<|im_end|>\n")))
    rows = talks(s, d).select("conv_id", F.lit("Be kind.\n\n" + D.HEADER + '{"name": "f", "parameters": {"type": "dict"}}\n' + D.FOOTER).alias("instruction"), F.array_join(block, "").alias("input"), F.lit("yes").alias("output"))
    r = rows.select("conv_id", D.py_parse("instruction", "input", "output").alias("r"))
    return r.select("conv_id", F.coalesce("r.reason", F.lit("")).alias("reason"), F.coalesce(F.size(F.from_json(F.get_json_object("r.row", "$.messages"), "array<string>")), F.lit(0)).cast("long").alias("n"), F.size(F.filter("r.events", lambda e: e["kind"] == "warning")).cast("long").alias("warnings"))


QUERIES["fn_parse_example"] = parsed
SQL["fn_parse_example"] = """
WITH g AS (SELECT conv_id, bool_or(role = 'system') AS s, arg_min(role, turn) AS a, arg_max(role, turn) AS z, count(*) AS n FROM conversations GROUP BY 1),
w AS (SELECT conv_id, count(*) FILTER (role = b) AS w FROM (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) GROUP BY 1)
SELECT conv_id, CASE WHEN s THEN 'unsupported_role' WHEN a <> 'user' THEN 'dialogue_does_not_start_with_user' WHEN z = 'assistant' THEN 'prompt_ends_with_assistant' ELSE '' END AS reason,
  (CASE WHEN NOT s AND a = 'user' AND z <> 'assistant' THEN n + 1 ELSE 0 END)::BIGINT AS n,
  (1 + CASE WHEN NOT s AND a = 'user' AND z <> 'assistant' THEN w ELSE 0 END)::BIGINT AS warnings
FROM g JOIN w USING (conv_id)
"""
