"""Queries on small tables made so that any cut of rows or texts would show."""

import re
import string
import uuid
from collections import Counter

from weftline.operators import batches
from weftline.plans import registry
from weftline.plans.common import shared_folder

QUERIES = registry.queries()


def folder(spark, **tables):
    path = shared_folder(spark, f"whole-{uuid.uuid4().hex[:6]}")
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def run(spark, query, **tables):
    return [tuple(r) for r in QUERIES[query](spark, folder(spark, **tables)).collect()]


def test_conflicts_by_whole_prompt(spark):
    same = "one two three four five six seven eight "
    docs = [(0, same + "nine", "en"), (1, same + "ten", "de"), (2, same + "Ten!", "en")]
    marks = [(0, 0), (1, 1), (2, 0)]
    got = run(spark, "agg_conflict_groups", documents=(docs, "doc_id long, text string, lang string"), labels=(marks, "doc_id long, quality int"))
    assert [r[1:] for r in got] == [(2, 2, "de,en")]


def test_long_duplicates(spark):
    long = "word " * 1200
    docs = [(0, long), (1, long.upper() + "!"), (2, long + "more"), (3, "a b"), (4, "A, b")]
    got = run(spark, "agg_norm_dedup", documents=(docs, "doc_id long, text string"))
    assert sorted(got) == [(0, 5999), (2, 6004), (3, 3)]


def test_whole_batch_beyond_one_thousand_events(spark):
    for n in (1203, 1208):  # the whole batch; groups of 8
        events = [(i, float(i * i % 17)) for i in range(n)]
        got = dict(run(spark, "win_group_norm_whole_batch", events=(events, "event_id long, value double")))
        groups = [events[i : i + 8] for i in range(0, n, 8)] if n % 8 == 0 else [events]
        want = {i: v - sum(x for _, x in g) / len(g) for g in groups for i, v in g}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_whole_batch_is_no_window(spark):
    path = folder(spark, events=([(i, float(i)) for i in range(9)], "event_id long, value double"))
    assert "Window" not in QUERIES["win_group_norm_whole_batch"](spark, path)._jdf.queryExecution().optimizedPlan().toString()


def f1_of(a, b):
    """The reference's rule."""
    a, b = ([w for w in re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in x.lower() if c not in string.punctuation)).split()] for x in (a, b))
    lone = ("yes", "no", "noanswer")
    n = sum((Counter(a) & Counter(b)).values())
    if not n or a != b and (" ".join(a) in lone or " ".join(b) in lone):
        return 0.0
    return 2 * (n / len(a)) * (n / len(b)) / (n / len(a) + n / len(b))


def test_f1_of_whole_texts(spark):
    filler = "filler words here " * 50
    texts = [filler + "The end, an end.", "end end " + filler, "réa était a la", "réa la", "yes", "Yes!", "yes yes", "", "", "same"]
    rows = [(i, x, "en" if i % 2 else "fr") for i, x in enumerate(texts)]
    got = dict(run(spark, "rw_f1", documents=(rows, "doc_id long, text string, lang string")))
    assert got == {i: round(f1_of(a, b), 6) for i, (a, b) in enumerate(zip(texts, texts[1:]))}


def test_whole_texts(spark):
    common = "x " * 150
    rows = [(0, common + "alpha beta", "en"), (1, common + "alpha gamma", "de")]
    schema = "doc_id long, text string, lang string"
    docs = {"documents": (rows, schema)}
    assert run(spark, "fn_jaccard", **docs) == [(0, 0.5, round(2 / 3, 6))]
    assert run(spark, "agg_topn_names", **docs) == [("x", 300), ("alpha", 2), ("beta", 1), ("gamma", 1)]
    late = [(0, "x " * 150 + "b", "en"), (1, "a", "en")]  # b comes first, 150 words into the earlier text
    assert run(spark, "agg_topn_names", documents=(late, schema)) == [("x", 150), ("b", 1), ("a", 1)]
    assert run(spark, "fn_teacher_tokens", **docs) == [(3, 2)]
    assert sorted(run(spark, "fn_context_projection", **docs)) == [(0, 0, 10.0 * (150 + 5 + 4)), (1, 0, 10.0 * (150 + 5 + 5))]
    assert sorted(r[1] for r in run(spark, "proj_template_math", **docs)) == [f"Solve:\n{x[1]}\nAnswer:" for x in rows]


def test_answers_in_whole_turns(spark):
    long = "words of a turn " * 20
    talk = [(0, 0, "user", long + "so (D) is correct: D."), (0, 1, "user", long + "no more")]
    got = run(spark, "fn_extract_letter", conversations=(talk, "conv_id long, turn int, role string, text string"))
    assert sorted(got) == [(0, 0, "D", "A"), (0, 1, "-", "B")]


def test_packs_by_tokens(spark):
    words = [3000 + 37 * i for i in range(12)] + [1]  # 38443 words: ten packs
    rows = [(i, " ".join(["ab"] * n)) for i, n in enumerate(words)] + [(60, "abc " * 9000)]  # one row: one pack
    docs = {"documents": (rows, "doc_id long, text string")}
    got = sorted(run(spark, "pk_sequences", **docs))
    parts = batches.largest_differencing(words, -(-sum(words) // 4096))
    want = [(k, sum(words[i] for i in p), len(p) + 1, 2 * sum(words[i] for i in p), max(words[i] for i in p) - 1) for k, p in enumerate(parts)]
    assert len(want) == 10 and got == [*want, (50, 9001, 2, 27000, 9000)]
    back = sorted(run(spark, "pk_unpack", **docs))
    assert back == [*((k, j, 2 * words[i]) for k, p in enumerate(parts) for j, i in enumerate(p)), (50, 0, 27000)]
