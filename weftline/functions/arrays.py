"""Algebra on arrays of numbers: scores of tokens and candidates, returns, masks. Doubles inside; cast last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import bind

DOUBLES = "array<double>"


def doubles(x: Column) -> Column:
    return x.cast(DOUBLES)


def total(x: Column) -> Column:
    """Sum of an array, in order; nulls count as nothing."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v.cast("double"), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def masked_mean(x: Column, mask: Column) -> Column:
    """Over a divisor of one at least, so an empty mask gives zero."""
    return dot(doubles(x), doubles(mask)) / F.greatest(total(doubles(mask)), F.lit(1.0))


def compose_delta(pairs: list[tuple[float, Column, Column | None]]) -> Column:
    """Weighted sum of post - pre (or of post alone) over anchors, per element."""

    def one(w: float, post: Column, pre: Column | None) -> Column:
        if pre is None:
            return F.transform(doubles(post), lambda a: w * a)
        return F.zip_with(doubles(post), doubles(pre), lambda a, b: w * (a - b))

    out = one(*pairs[0])
    for pair in pairs[1:]:
        out = F.zip_with(out, one(*pair), lambda a, b: a + b)
    return out


def split_delta(delta: Column) -> tuple[Column, Column]:
    """(post, pre) as floats, neither above zero, whose difference is delta."""
    return F.transform(delta, lambda d: F.least(d, F.lit(0.0))).cast("array<float>"), F.transform(delta, lambda d: F.least(-d, F.lit(0.0))).cast("array<float>")


def intersect_masks(masks: list[Column]) -> Column:
    """True where all are; anchors of weight zero take part too."""
    out = masks[0]
    for m in masks[1:]:
        out = F.zip_with(out, m, lambda a, b: a & b)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def approx_kl(log_p: Column, log_base: Column, kind: str) -> Column:
    """Estimators of the divergence of one token from its log probabilities: k1, k2, k3, low_var (k3 within 10)."""
    r = log_p - log_base
    if kind == "k1":
        return r
    if kind == "k2":
        return r * r / 2
    k3 = F.exp(-r) - 1 + r
    if kind == "k3":
        return k3
    if kind == "low_var":
        return clamp(k3, -10.0, 10.0)
    raise ValueError(kind)


def low_var_kl_clamped(log_p: Column, log_base: Column) -> Column:
    """k3 within 10 of a log ratio held within 20 first."""
    r = clamp(log_base - log_p, -20.0, 20.0)
    return clamp(F.exp(r) - 1 - r, -10.0, 10.0)


def policy_loss(log_ratio: Column, advantage: Column, low: float, high: float, dual: float | None = None) -> tuple[Column, Column]:
    """Clipped loss of a token, and whether it was clipped (as 0 or 1). dual: bound of the loss where advantages are negative."""
    ratio = F.exp(log_ratio)
    plain, clipped = -ratio * advantage, -clamp(ratio, 1 - low, 1 + high) * advantage
    loss = F.greatest(plain, clipped)
    was = (clipped > plain).cast("double")
    if dual is not None:
        loss = F.when(advantage < 0, F.least(loss, -F.lit(dual) * advantage)).otherwise(loss)
    return loss, was


def value_loss(value: Column, old: Column, target: Column, clip: float) -> tuple[Column, Column]:
    """The larger of the squared errors of a value and of it held near the old one, and whether the latter was used."""
    held = old + clamp(value - old, -clip, clip)
    a, b = (value - target) * (value - target), (held - target) * (held - target)
    return F.greatest(a, b), (b > a).cast("double")


def truncated_weight(log_new: Column, log_old: Column, low: float, high: float) -> Column:
    """An importance weight, held in a band."""
    return clamp(F.exp(log_new - log_old), low, high)


def band_weight(log_new: Column, log_old: Column, low: float, high: float) -> Column:
    """An importance weight, zero outside a band."""
    w = F.exp(log_new - log_old)
    return F.when((w >= low) & (w <= high), w).otherwise(0.0)


def softmax(x: Column) -> Column:
    """Shifted by the greatest value."""
    return bind(x, lambda v: bind(F.transform(v, lambda a: F.exp(a - F.array_max(v))), lambda e: F.transform(e, lambda a: a / total(e))))


def log_sum_exp(x: Column) -> Column:
    return bind(x, lambda v: F.array_max(v) + F.log(total(F.transform(v, lambda a: F.exp(a - F.array_max(v))))))


def topk_other(log_p: Column, floor: float = 1e-8) -> Column:
    """Probabilities of the candidates and of all else (at least floor), made to sum to one."""
    p = bind(F.transform(log_p, F.exp), lambda v: F.concat(v, F.array(F.greatest(1 - total(v), F.lit(floor)))))
    return bind(p, lambda v: F.transform(v, lambda a: a / total(v)))


def tilted(log_p: Column, delta: Column, alpha: float) -> Column:
    """q in proportion to p * exp(delta / alpha)."""
    return softmax(F.zip_with(log_p, delta, lambda a, d: a + d / alpha))


def candidate_log_probs(logits: Column, ids: Column, temperature: float) -> Column:
    """Log probabilities of ids among all logits at a temperature; an id that isn't there is an error."""

    def one(v: Column) -> Column:
        z = log_sum_exp(v)
        pick = lambda i: F.coalesce(F.get(v, i), F.raise_error(F.lit("no such id")).cast("double"))
        return F.transform(ids, lambda i: pick(i) - z)

    return bind(F.transform(logits, lambda x: x / temperature), one)


def same_width(x: Column, n: int) -> Column:
    """The array if it has n elements, else an error."""
    return F.when(F.size(x) == n, x).otherwise(F.raise_error(F.lit(f"a row has another width than {n}")).cast("array<float>"))


def kl(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - F.log(b))).otherwise(0.0)))


def total_variation(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2


def entropy(p: Column) -> Column:
    return -total(F.transform(p, lambda a: F.when(a > 0, a * F.log(a)).otherwise(0.0)))


def reward_sum_count(scores: Column, post: Column, pre: Column, mask: Column) -> Column:
    """(total, n) over masked tokens and their candidates: post - pre, weighted by a softmax of the model's scores."""

    def one(r: Column) -> Column:
        return dot(softmax(r["s"]), F.zip_with(r["a"], r["b"], lambda a, b: a - b))

    rows = F.zip_with(F.zip_with(F.zip_with(scores, post, lambda s, a: F.struct(s.alias("s"), a.alias("a"))), pre, lambda r, b: F.struct(r["s"].alias("s"), r["a"].alias("a"), b.alias("b"))), mask, lambda r, m: F.struct(r["s"].alias("s"), r["a"].alias("a"), r["b"].alias("b"), m.cast("boolean").alias("m")))
    kept = F.filter(rows, lambda r: r["m"])
    return F.struct(total(F.transform(kept, one)).alias("total"), F.aggregate(kept, F.lit(0).cast("long"), lambda n, r: n + F.size(r["s"])).alias("n"))


def top_k(scores: Column, ids: Column, k: int) -> Column:
    """The k entries (score, id) with the largest scores, ties to the smaller id."""
    entries = F.zip_with(scores, ids, lambda s, i: F.struct((-s).alias("less"), i.alias("id"), s.alias("score")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["score"].alias("score"), e["id"].alias("id")))


def reverse_scan(x: Column, factor: float) -> Column:
    """y[t] = x[t] + factor * y[t+1]. The state carries the last value, so no element is looked up."""
    state = F.struct(F.lit(0.0).alias("last"), F.array().cast(DOUBLES).alias("out"))

    def step(s, v):
        y = v + factor * s["last"]
        return F.struct(y.alias("last"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.reverse(F.aggregate(F.reverse(x), state, step, lambda s: s["out"]))


def chunked_scan(x: Column, factor: float, size: int) -> Column:
    """reverse_scan by chunks: each is scanned alone, then the first elements of all of them with factor ** size, whose
    results are what each chunk gets from the next one. No array longer than a chunk or the number of chunks is copied."""
    n = F.size(x)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / size), F.lit(0)).cast("int"))
    local = F.transform(starts, lambda c: reverse_scan(F.slice(x, c * size + 1, size), factor))

    def joined(chunks: Column) -> Column:
        heads = reverse_scan(F.transform(chunks, lambda c: F.get(c, F.lit(0))), factor**size)

        def whole(h: Column) -> Column:
            return F.flatten(F.transform(chunks, lambda c, k: F.transform(c, lambda v, i: v + F.pow(F.lit(factor), F.size(c) - i) * F.coalesce(F.get(h, k + 1), F.lit(0.0)))))

        return bind(heads, whole)

    return F.when(n > 0, bind(local, joined)).otherwise(F.array().cast(DOUBLES))


def discounted_returns(rewards: Column, gamma: float) -> Column:
    return reverse_scan(doubles(rewards), gamma)


def gae(rewards: Column, values: Column, gamma: float, lam: float, chunk: int | None = None) -> tuple[Column, Column]:
    """Advantages and returns; after the last token the value is zero. chunk: scan by chunks of so many tokens."""
    r, v = doubles(rewards), doubles(values)
    after = F.concat(F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0))), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(r, after, lambda a, b: a + gamma * b), v, lambda a, b: a - b)
    adv = reverse_scan(delta, gamma * lam) if chunk is None else chunked_scan(delta, gamma * lam, chunk)
    return adv, F.zip_with(adv, v, lambda a, b: a + b)


def add_at_last(x: Column, value: Column, mask: Column | None = None) -> Column:
    """value added to the last element, or to the last where mask holds; an error if it holds nowhere."""
    where = F.size(x) if mask is None else F.array_max(F.transform(mask, lambda m, i: F.when(m.cast("int") == 1, i + 1)))
    if mask is not None:
        where = F.when(where.isNotNull(), where).otherwise(F.raise_error(F.lit("the mask holds nowhere")).cast("int"))
    return F.transform(x, lambda v, i: F.when(i + 1 == where, v + value).otherwise(v))


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """1 - C(n-c, k) / C(n, k), as a product. c of zero is apart: a descending sequence would be made of it."""
    return F.when(c == 0, 0.0).when(n - c < k, 1.0).otherwise(1 - F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (1 - k / i)))


def pass_hat_k(n: Column, c: Column, k: Column) -> Column:
    """C(c, k) / C(n, k), as a product."""
    return F.aggregate(F.sequence(F.lit(0).cast("long"), k - 1), F.lit(1.0), lambda a, i: a * (F.greatest(c - i, F.lit(0)) / (n - i)))


def pad(x: Column, multiple: int, value) -> Column:
    return F.concat(x, F.array_repeat(value, F.pmod(-F.size(x), F.lit(multiple)).cast("int")))


def zigzag(x: Column, ways: int, rank: int) -> Column:
    """Chunks rank and 2 * ways - 1 - rank of 2 * ways equal ones."""
    size = (F.size(x) / (2 * ways)).cast("int")
    return F.concat(F.slice(x, F.lit(rank) * size + 1, size), F.slice(x, F.lit(2 * ways - 1 - rank) * size + 1, size))


def find_runs(x: Column, run: Column) -> Column:
    """All places (from 0) where run begins in x."""
    last = F.size(x) - F.size(run)
    return F.when((last >= 0) & (F.size(run) > 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(x, i + 1, F.size(run)) == run)).otherwise(F.array().cast("array<int>"))


def mask_runs(mask: Column) -> Column:
    """(start, length) of each run of ones."""
    state = F.array().cast("array<struct<start:int,length:int>>")
    marks = F.transform(mask, lambda m, i: F.struct(m.cast("int").alias("m"), i.alias("i")))

    def step(s, x):
        last = F.element_at(s, -1)
        grow = (F.size(s) > 0) & (F.when(F.size(s) > 0, last["start"] + last["length"]).otherwise(-1) == x["i"])
        more = F.concat(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), (last["length"] + 1).alias("length"))))
        return F.when(x["m"] != 1, s).when(grow, more).otherwise(F.concat(s, F.array(F.struct(x["i"].alias("start"), F.lit(1).alias("length")))))

    return F.aggregate(marks, state, step)


def inverse_permutation(x: Column) -> Column:
    return F.transform(F.array_sort(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))), lambda e: e["i"])


def adaptive_coefficients(signals: Column, start: float, rate: float, low: float, high: float) -> Column:
    """The coefficient after each signal: times 1 + rate where it is above zero, 1 - rate where below, held in a band."""
    state = F.struct(F.lit(start).alias("c"), F.array().cast(DOUBLES).alias("out"))

    def step(s, x):
        c = clamp(s["c"] * (1 + rate * F.signum(x)), low, high)
        return F.struct(c.alias("c"), F.concat(s["out"], F.array(c)).alias("out"))

    return F.aggregate(signals, state, step, lambda s: s["out"])
