"""Text as columns: normal forms, tokens, shingles and what is counted on them. All in the JVM, unless named py_."""

from __future__ import annotations

import bz2
import gzip
import lzma
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType


def newlines(x: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(x, "\r\n?", "\n")


def norm_tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits; a null text has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


# The words around a prompt that don't belong to it.
PROMPT_HEAD = r"(?iU)^\s*solve\s+the\s+following\s+coding\s+problem\s+using\s+the\s+programming\s+language\s+python\s*:\s*"
PROMPT_TAIL = ("now solve the problem and return the code.", "now solve the problem and return the code")


@F.pandas_udf(StringType())
def py_nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def prompt_tokens(x: Column) -> Column:
    """norm_tokens of a prompt without the words around it, in NFKC."""
    text = F.regexp_replace(x, PROMPT_HEAD, "")
    kept = F.regexp_replace(text, r"(?U)\s+$", "")
    low = F.lower(kept)
    cut = F.when(low.endswith(PROMPT_TAIL[0]), F.left(kept, F.length(kept) - len(PROMPT_TAIL[0]))).when(low.endswith(PROMPT_TAIL[1]), F.left(kept, F.length(kept) - len(PROMPT_TAIL[1]))).otherwise(text)
    return norm_tokens(py_nfkc(cut))


def strip_wrapper(x: Column, prefixes: list[str], suffix: str | None = None) -> Column:
    """Without the first of the prefixes that it begins with, and without one suffix at its end."""
    out = x
    for p in reversed(prefixes):
        out = F.when(x.startswith(p), F.substring(x, len(p) + 1, 1 << 30)).otherwise(out)
    if suffix:
        out = F.when(out.endswith(suffix), F.left(out, F.length(out) - len(suffix))).otherwise(out)
    return out


def bind(array: Column, body) -> Column:
    """body(array) with the array computed once: it is a lambda's variable, which no rule copies into other expressions."""
    return F.element_at(F.transform(F.array(array), body), 1)


def shingles(tokens: Column, k: int, short: str = "whole") -> Column:
    """Distinct runs of k tokens, joined by spaces. Fewer tokens: the whole run ("whole") or none ("none"); no token: none."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), " "))
        few = F.array(F.array_join(t, " ")) if short == "whole" else F.array().cast("array<string>")
        return F.when(F.size(t) >= k, F.array_distinct(many)).when(F.size(t) > 0, few).otherwise(F.array().cast("array<string>"))

    return bind(tokens, of)


def shingle_hashes(tokens: Column, k: int, short: str = "whole") -> Column:
    """64-bit hashes of the distinct shingles that shingles() would give, without building their strings."""

    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.xxhash64(F.slice(t, i, k)))
        few = F.array(F.xxhash64(t)) if short == "whole" else F.array().cast("array<bigint>")
        return F.when(F.size(t) >= k, F.array_distinct(many)).when(F.size(t) > 0, few).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


PRIME = 4_294_967_311  # the least above 2**32


def minhash(sh: Column, seeds: int) -> Column:
    """A signature of a set: for each of `seeds` functions the least (a * h + b) mod PRIME, h being 32 bits of an element's
    MD5; null for an empty set. Equal places of two signatures estimate the sets' Jaccard similarity."""
    h = F.transform(sh, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint"))
    one = lambda e: F.array(*[F.pmod(e * a + b, F.lit(PRIME)) for a, b in minhash_factors(seeds)])
    least = F.aggregate(h, F.array_repeat(F.lit(PRIME).cast("bigint"), seeds), lambda s, e: F.zip_with(s, one(e), lambda x, y: F.least(x, y)))
    return F.when(F.size(sh) > 0, least)


def minhash_factors(seeds: int) -> list[tuple[int, int]]:
    """(a, b) of each function, below 2**30, by a multiplicative rule."""
    return [((i + 1) * 2_654_435_761 % (1 << 30) | 1, (i + 1) * 40_503 % (1 << 30)) for i in range(seeds)]


def strip_thought(x: Column, end: str = "</think>") -> Column:
    """What follows the last end mark; all of it if there is none."""
    return F.element_at(F.split(x, end, -1), -1)


def alnum_words(x: Column) -> Column:
    """Lower case; everything but ASCII letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def answer_words(x: Column) -> Column:
    """Lower case, ASCII punctuation and English articles out, single spaces."""
    plain = F.regexp_replace(F.lower(x), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token arrays as multisets."""

    def count(t, w):
        return F.size(F.filter(t, lambda x: x == w))

    same = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, w: n + F.least(count(a, w), count(b, w)))
    p, r = same / F.size(a), same / F.size(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (same > 0), 2 * p * r / (p + r)).otherwise(0.0)


def mask_volatile(x: Column) -> Column:
    """Lower case without white space at the ends; UUIDs, times and the first names below /tmp become fixed marks."""
    x = F.regexp_replace(F.lower(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))), r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>")
    x = F.regexp_replace(x, r"\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}", "<timestamp>")
    return F.regexp_replace(x, r"/tmp/[^\s/]+", "/tmp/<tmp>")


def preview(x: Column, head: int, tail: int) -> Column:
    """The beginning and the end, with the number of characters left out."""
    n = F.length(x) - (head + tail)
    return F.when(n > 0, F.concat(F.left(x, F.lit(head)), F.lit(" ... ["), n.cast("string"), F.lit(" chars] ... "), F.right(x, F.lit(tail)))).otherwise(x)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def last_answer_line(x: Column) -> Column:
    """What follows the last "Answer:" on its line; null if there is none."""
    found = F.regexp_extract_all(x, F.lit(r"(?i)answer\s*:\s*([^\n]+)"), F.lit(1))
    return F.when(F.size(found) > 0, F.trim(F.element_at(found, -1)))


# How a choice is told, in order.
CHOICES = [r"(?:answer|option|choice)\s*(?:is|:)?\s*([A-Z])", r"([A-Z])\s*(?:is\s*(?:the)?\s*correct)", r"final\s*(?:answer|option)\s*(?:is|:)?\s*([A-Z])"]


def choice_letter(x: Column, letters: str = "ABCDEFGH") -> Column:
    """The chosen letter after the last thought: by the first way of telling whose first match is a letter that may be
    chosen, else the last such capital that stands alone; null if there is none."""
    tail = strip_thought(x)
    told = [F.upper(F.regexp_extract(tail, f"(?iU){p}", 1)) for p in CHOICES]
    alone = F.filter(F.regexp_extract_all(tail, F.lit(r"(?U)\b([A-Z])\b"), F.lit(1)), lambda c: c.isin(*letters))
    return F.coalesce(*[F.when(t.isin(*letters), t) for t in told], F.get(alone, F.size(alone) - 1))


@F.pandas_udf(StringType())
def py_nfkc_fold(x: pd.Series) -> pd.Series:
    """NFKC, casefold, words joined by single spaces."""
    return x.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).casefold().split()))


@F.pandas_udf(StringType())
def py_nfc_strip(x: pd.Series) -> pd.Series:
    """NFC, LF, no white space at the ends."""
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFC", s.replace("\r\n", "\n").replace("\r", "\n")).strip())


PACKERS = {"zlib": zlib.compress, "gzip": lambda b: gzip.compress(b, mtime=0), "bz2": bz2.compress, "lzma": lzma.compress}


def compression_ratio(method: str = "zlib"):
    """A pandas UDF: bytes over compressed bytes; 1 for an empty text."""

    @F.pandas_udf(DoubleType())
    def ratio(x: pd.Series) -> pd.Series:
        pack = PACKERS[method]
        return x.map(lambda s: 1.0 if not s else len(s.encode()) / len(pack(s.encode()))).astype(float)

    return ratio


@F.pandas_udf(BooleanType())
def py_is_repetitive(x: pd.Series) -> pd.Series:
    """Over 10,000 characters, the last 10,000 of which zlib packs more than tenfold."""

    def test(s):
        tail = (s or "")[-10_000:].encode()
        return s is not None and len(s) > 10_000 and len(tail) > 10 * len(zlib.compress(tail))

    return x.map(test)
