"""Line rules learn from all lines of a labelled document."""

import re
from collections import Counter

import numpy as np

from weftline.llm import line_rules


def test_lines_after_the_first_400(spark):
    good = "\n".join(f"A line of words, number {i}, that ends here." for i in range(420))
    junk = "\n" + "\n".join(f"### {i} $$$ !!! %%%" for i in range(150))
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    fit = lambda tail: line_rules.train(spark.createDataFrame([(i, good + (tail if i % 2 == 0 else "")) for i in range(12)], "doc_id long, text string"), marks, spark)
    assert not np.allclose(fit("").w, fit(junk).w)


def test_groups_of_any_size_give_one_fit(monkeypatch):
    rng = np.random.default_rng(0)
    xs = [rng.normal(size=(n, line_rules.N_FEATURES)) for n in (3, 1, 8, 40, 2, 5)]
    ys = [rng.integers(0, 2, len(x)) for x in xs]
    whole = line_rules.Field().fit(xs, ys, rounds=20)
    monkeypatch.setattr(line_rules, "LINES", 10)
    assert np.allclose(line_rules.Field().fit(xs, ys, rounds=20).w, whole.w)


def test_sample_is_bounded_by_lines(spark):
    """Documents that would exceed the lines are left out of the sample; the others' lines are all in it."""
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of it." for j in range(n))) for i, n in enumerate((900, 5, 6, 7, 2000, 8))], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    seen = []
    fit, line_rules.Field.fit = line_rules.Field.fit, lambda self, xs, ys, **k: seen.append([len(x) for x in xs]) or self
    try:
        line_rules.train(docs, marks, spark, most_lines=100)
        line_rules.train(docs, marks.limit(0), spark)
    finally:
        line_rules.Field.fit = fit
    fixed = [len(s) for s in line_rules.SEQUENCES]
    assert seen[1] == fixed and set(seen[0][len(fixed) :]) <= {5, 6, 7, 8} and sum(seen[0][len(fixed) :]) <= 100 and len(seen[0]) > len(fixed)


def plain_measures(text):
    """The base measures by the contract's words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_op6_against_the_words_of_its_contract(spark, data, duck):
    texts = dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    docs = spark.read.parquet(f"{data}/documents.parquet")
    field = line_rules.train(docs.select("doc_id", "text"), spark.read.parquet(f"{data}/labels.parquet"), spark)
    for r in line_rules.judge(docs, field).collect():
        n, chars, symbols, dup, again = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again)
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        lines = [x for x in texts[r.doc_id].split("\n") if x.split()]
        x = line_rules.line_features(lines)
        u = x @ field.w
        best = [(field.start[0], field.start[1] + u[0], "0", "1")] if len(u) else []
        for v in u[1:]:  # the best path to each state, written out
            a, b, p, q = best[-1]
            zero = max((b + field.change[1, 0], q), (a + field.change[0, 0], p))
            one = max((b + field.change[1, 1], q), (a + field.change[0, 1], p))
            best.append((zero[0], one[0] + v, zero[1] + "0", one[1] + "1"))
        path = (best[-1][3] if best[-1][1] >= best[-1][0] else best[-1][2]) if best else ""
        sizes = [len(x.split()) for x in lines]
        share = sum(s for s, c in zip(sizes, path) if c == "1") / sum(sizes) if sizes else 0.0
        assert r.kept == (not r.base_failed and share >= 0.5)
