"""Columns of rollout and score rows: completions, scoring prefixes, samples, their records and token-level returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import arrays as A

#: Arrays that become columns of a sample; with those of the last line they leave the metadata.
SAMPLE_FIELDS = ("candidate_ids", "behavior_topk_log_probs", "post_teacher_log_probs", "pre_teacher_log_probs", "student_ref_sampled_log_probs")
PAYLOAD_FIELDS = (*SAMPLE_FIELDS, "prompt_tokens", "response_tokens", "loss_mask", "behavior_sampled_log_probs")
PRECOMPUTED_FLAGS = ("is_precomputed", "is_offline", "is_offline_scored")
STATUSES = ("pending", "completed", "truncated", "aborted", "failed")


def ones(x: Column) -> Column:
    return F.transform(x, lambda _: F.lit(1))


def candidates(entries: Column, k: int) -> tuple[Column, Column]:
    """Ids and log probabilities of each position's k best (token, log_prob), ties to the smaller token."""
    best = F.transform(entries, lambda e: F.slice(F.array_sort(F.transform(e, lambda x: F.struct((-x["log_prob"]).alias("less"), x["token"].alias("token")))), 1, k))
    return F.transform(best, lambda b: F.transform(b, lambda x: x["token"])), F.transform(best, lambda b: F.transform(b, lambda x: -x["less"]))


def sampled(tokens: Column, entries: Column) -> Column:
    """The log probability of each position's own token, null if it isn't listed."""
    return F.zip_with(tokens, entries, lambda t, e: F.get(F.filter(e, lambda x: x["token"] == t), F.lit(0))["log_prob"])


def sample_id(revision: Column, prompt_id: Column, response: Column, config_hash: Column) -> Column:
    """The digest of what defines a sample, as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(config_hash.alias("generation_config_hash"), prompt_id.alias("prompt_id"), response.alias("response_index"), revision.alias("student_revision"))), 256)


def completion(tokens: Column, entries: Column, k: int) -> Column:
    """A completion's fields: its tokens, a mask of ones, the candidates with their scores, and its own tokens' scores."""
    ids, scores = candidates(entries, k)
    return F.struct(
        tokens.alias("response_tokens"), ones(tokens).alias("loss_mask"), F.size(tokens).alias("response_length"), ids.alias("candidate_ids"),
        scores.alias("behavior_topk_log_probs"), sampled(tokens, entries).alias("behavior_sampled_log_probs"),
    )


def scoring_prefix(prompt: Column, response: Column, listed: Column | None = None) -> Column:
    """context (all tokens but the last), the positions whose scores count, and each one's targets: its token, or a list."""
    context = F.concat(prompt, F.slice(response, F.lit(1), F.greatest(F.size(response) - 1, F.lit(0))))
    targets = F.transform(response, lambda t: F.array(t)) if listed is None else listed
    return F.struct(context.alias("context"), F.sequence(F.size(prompt) - 1, F.size(context) - 1).alias("positions"), targets.alias("targets"))


def is_precomputed(meta: Column, flags: tuple[str, ...] = PRECOMPUTED_FLAGS) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | F.coalesce(meta[f], F.lit(False))
    return out


def precomputed(prompt: Column, meta: Column) -> Column:
    """A finished sample from its metadata: all tokens, the mask (ones, if none is given) and scores, if there are any."""
    tokens = F.coalesce(meta["response_tokens"], F.array().cast("array<int>"))
    return F.struct(
        F.concat(prompt, tokens).alias("tokens"), F.coalesce(meta["loss_mask"], ones(tokens)).alias("loss_mask"), F.size(tokens).alias("response_length"),
        F.coalesce(meta["response"], F.lit("")).alias("response"), F.lit("completed").alias("status"), meta["student_log_probs"].alias("rollout_log_probs"),
    )


def attach_fields(rows: DataFrame, meta: str = "metadata") -> DataFrame:
    """rows with the metadata's arrays as columns, the sampled tokens' scores as rollout_log_probs, and the rest as metadata.

    Arrays of scores have a row for each token of the response; anything else is an error.
    """
    n = F.size(F.col(f"{meta}.response_tokens"))
    bad = F.lit(False)
    for f in (*SAMPLE_FIELDS, "loss_mask", "behavior_sampled_log_probs"):
        bad = bad | (F.coalesce(F.size(F.col(f"{meta}.{f}")), F.lit(-1)) != n)
    checked = F.when(bad, F.raise_error(F.lit("lengths differ from the response")).cast(rows.schema[meta].dataType)).otherwise(F.col(meta))
    out = rows.withColumn("_m", checked)
    out = out.withColumns({**{f: F.col(f"_m.{f}") for f in SAMPLE_FIELDS}, "rollout_log_probs": F.col("_m.behavior_sampled_log_probs")})
    return out.withColumn(meta, F.col("_m").dropFields(*PAYLOAD_FIELDS)).drop("_m")


def replace_scores(meta: Column, pre: Column, post: Column, mask: Column, revision: str, projection: Column | None = None) -> Column:
    """A struct with its scores, mask and revisions replaced; the projection's mask only if one is given."""
    new = {"pre_teacher_log_probs": pre, "post_teacher_log_probs": post, "loss_mask": mask, "pre_teacher_revision": F.lit(revision), "post_teacher_revision": F.lit(revision)}
    if projection is not None:
        new["token_projection_valid_mask"] = projection
    for name, value in new.items():
        meta = meta.withField(name, value)
    return meta


def merged_scores(base: DataFrame, scored: DataFrame, key: str, role: str, meta: str = "metadata") -> DataFrame:
    """base with one teacher's scores and revision from the rows of scored with the same key; all else stays as it is."""
    names = [f"{role}_teacher_log_probs", f"{role}_teacher_revision"]
    other = scored.select(F.col(key).alias("_k"), *[F.col(f"{meta}.{n}").alias(f"_{i}") for i, n in enumerate(names)])
    out = base.join(other, F.col(key) == F.col("_k"))
    new = F.col(meta)
    for i, n in enumerate(names):
        new = new.withField(n, F.col(f"_{i}"))
    return out.withColumn(meta, new).select(*base.columns)


def record(status: Column, spec: Column, **fields: Column) -> Column:
    """A sample as JSON: the status by its value, counts of speculation nested."""
    checked = F.when(status.isin(*STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("no such status: "), status)))
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()], spec.alias("spec_info"), checked.alias("status")))


SPEC = "struct<spec_accept_token_num:int,spec_draft_token_num:int,spec_verify_ct:int,spec_accept_rate:double,spec_accept_length:double>"


def from_record(text: Column, fields: str) -> Column:
    """The sample of a record; what is missing of spec_info is zero."""
    r = F.from_json(text, f"struct<{fields},status:string,spec_info:{SPEC}>")
    names = [x.split(":")[0] for x in SPEC[7:-1].split(",")]
    filled = F.struct(*[F.coalesce(r["spec_info"][n], F.lit(0)).alias(n) for n in names])
    return r.withField("spec_info", filled)


def speculation(accepted: Column, drafted: Column, verified: Column, length: Column) -> Column:
    """Rates of speculation: accepted per drafted token, and the response's length per verification; zero without any."""
    return F.struct(
        accepted.cast("int").alias("spec_accept_token_num"), drafted.cast("int").alias("spec_draft_token_num"), verified.cast("int").alias("spec_verify_ct"),
        F.when(drafted > 0, accepted / drafted).otherwise(0.0).alias("spec_accept_rate"), F.when(verified > 0, length / verified).otherwise(0.0).alias("spec_accept_length"),
    )


def generated(pairs: Column) -> Column:
    """(tokens, log_probs) of pairs (log_prob, token); an error without any."""
    checked = F.when(F.coalesce(F.size(pairs), F.lit(0)) > 0, pairs).otherwise(F.raise_error(F.lit("no tokens were returned")).cast("array<struct<log_prob:double,token:int>>"))
    return F.struct(F.transform(checked, lambda p: p["token"]).alias("tokens"), F.transform(checked, lambda p: p["log_prob"]).alias("log_probs"))


def aligned_mask(mask: Column, n: Column) -> Column:
    """A text's mask with zeros before it, for tokens that other media add; an error if it is longer than the tokens."""
    room = n - F.size(mask)
    return F.concat(F.array_repeat(F.lit(0), F.when(room >= 0, room).otherwise(F.raise_error(F.lit("the mask is longer than the tokens")).cast("int"))), mask)


def sequence_kl(log_p: Column, old: Column, mask: Column) -> Column:
    """The masked mean of old - new, the same for every token."""
    mean = A.masked_mean(F.zip_with(old, log_p, lambda a, b: a - b), mask)
    return F.array_repeat(mean, F.size(log_p))


def flat_returns(reward: Column, kl: Column) -> Column:
    return F.transform(kl, lambda _: reward.cast("double"))


def penalised_returns(reward: Column, kl: Column, coef: float) -> Column:
    return F.transform(kl, lambda k: reward - coef * k)


def discounted_penalised(reward: Column, kl: Column, mask: Column, coef: float, gamma: float) -> Column:
    """Discounted sums of -coef * kl with the reward at the last token of the mask; an error if it has none."""
    return A.reverse_scan(A.add_at_last(F.transform(kl, lambda k: -coef * k), reward, mask), gamma)


def distillation(teacher: Column, student: Column) -> Column:
    """Teacher less student, over the last tokens of the teacher's array."""
    return F.zip_with(F.slice(teacher, F.size(teacher) - F.size(student) + 1, F.size(student)), student, lambda t, s: t - s)
