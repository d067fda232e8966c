"""Each stage of the pipeline against brute force on what the stage before left, and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_edges import DOCS, ROWS, ids_of, shares

import corpus_pipeline
from weftline.llm import html_text, line_rules, log_bilinear, quality, shared

pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


def without_later_runs(rows, least=50):
    """Texts in order of id and place without lines that a later copy of a run of `least` words covers, by all windows."""
    count = lambda x: len(WORD.findall(x))
    full = [[(p, x) for p, x in enumerate((t or "").split("\n")) if count(x)] for _, t in rows]
    seen, gone = set(), [set() for _ in rows]
    for k, lines in enumerate(full):
        sizes = [count(x) for _, x in lines]
        for s in range(len(lines)):
            words = 0
            for e in range(s, len(lines)):
                words += sizes[e]
                if words >= least:
                    block = tuple(x for _, x in lines[s : e + 1])
                    if block in seen:
                        gone[k].update(range(s, e + 1))
                    seen.add(block)
                    if words - sizes[s] >= least and words - sizes[e] >= least:
                        break  # a longer window has one of these inside
    out = []
    for (_, t), lines, hit in zip(rows, full, gone):
        lost, hit = set(), sorted(hit)
        for i, h in enumerate(hit):
            to = hit[i + 1] if i + 1 < len(hit) and hit[i + 1] == h + 1 else h
            lost.update(range(lines[h][0], lines[to][0] + 1))
        out.append(t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in lost))
    return out


def fingerprint(x):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), 42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
    return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))


def heads(rows):
    """Of each component the first row: by id, nulls last."""
    prints, of = [fingerprint(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and of[i] != of[j]:
                low, high = sorted((of[i], of[j]))
                of = [low if c == high else c for c in of]
    first = {}
    for i, c in enumerate(of):
        first[c] = min(first.get(c, i), i, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    return set(first.values())


def copies(rows):
    """How often the mix takes each row (id, text, source), by the rule as it is told."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    of = {}
    for (_, _, s), n in zip(rows, size):
        of[s] = of.get(s, 0) + n
    goal, out = shares(list(of.items())), {}
    for s, n in of.items():
        own = sorted((i for i, r in enumerate(rows) if r[2] == s), key=lambda i: (size[i], rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
        rate = goal[s] / n if n else 0.0
        u = int(hashlib.md5(f"mix\0{chr(0) if s is None else s}".encode()).hexdigest()[:6], 16) / 16777216
        part = rate - math.floor(rate)
        for k, i in enumerate(own):
            out[i] = math.floor(rate) + math.floor(u + (k + 1) * part) - math.floor(u + k * part)
    return out


def stages(spark, docs, sf_dir):
    """Each stage's input and output as rows."""
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = shared.written(stage(spark, docs, sf_dir), spark, "stage")
        yield name, before, docs


def check(spark, docs, sf_dir, field=None):
    columns = docs.columns
    for name, before, after in stages(spark, docs, sf_dir):
        old, new = before.collect(), after.collect()
        text = lambda rows: Counter((r.doc_id, r.text) for r in rows)
        assert name == "packing" or after.columns == columns
        if name == "quality rules":
            kept = [r for r in line_rules.judge(before, line_rules.train(before.select("doc_id", "text"), shared.table(spark, sf_dir, "labels"), spark), keep_columns=True).collect() if r.kept]
            assert text(new) == text(kept)
        elif name == "line dedup":
            order = sorted(range(len(old)), key=lambda i: (old[i].doc_id is None, old[i].doc_id or 0))
            want = without_later_runs([(old[i].doc_id, old[i].text) for i in order])
            assert text(new) == Counter((old[i].doc_id, t) for i, t in zip(order, want))
        elif name == "near dedup":
            stay = heads([(r.doc_id, r.text) for r in old])
            assert text(new) == text([r for i, r in enumerate(old) if i in stay])
        elif name == "mixture":
            n = copies([(r.doc_id, r.text, r.source) for r in old])
            assert text(new) == Counter({k: v for k, v in sum((Counter({(r.doc_id, r.text): n[i]}) for i, r in enumerate(old)), Counter()).items() if v})
        else:
            want = Counter()
            for r, ids in zip(old, ids_of([r.text for r in old])):
                short = len(ids) % 2048
                cuts = [0] * (short > 0) + [short + 2048 * k for k in range(len(ids) // 2048)]
                for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
                    want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in new) == want
            load = Counter()
            for r in new:
                load[r.sequence_id] += r.length
            assert not load or max(load.values()) <= 2048


def test_stages_against_brute_force(spark, data):
    check(spark, shared.table(spark, data, "documents"), data)


def test_stages_on_awkward_rows(spark, data):
    """Nulls, empty and long texts, ties, repeated rows and a column with a clashing name; and an empty table."""
    good = [(20 + i, "\n".join(f"A line of words, number {i * 7 + j}, that ends as lines end." for j in range(12)), "en", None if i % 3 else "b", 1) for i in range(9)]
    rows = spark.createDataFrame(ROWS + good + good[:2], DOCS).repartition(3)
    check(spark, rows, data)
    check(spark, rows.limit(0), data)
    clash = rows.selectExpr("*", "'x' AS fp", "1 AS copies", "2 AS size", "3 AS kept", "4 AS n_removed", "5 AS n_words")
    for name, before, after in stages(spark, clash, data):
        assert name == "packing" or set(after.columns) == set(clash.columns), name


def test_clashing_columns_of_scores(spark):
    docs = spark.createDataFrame(ROWS, DOCS).selectExpr("*", "'x' AS score", "1 AS held_out", "2 AS x", "3 AS n_tokens", "4 AS predicted", "5 AS word")
    labels = spark.createDataFrame([(3, 1, "z"), (6, 0, "z")], "doc_id long, quality int, x string")
    scored = quality.features(docs, spark)
    assert quality.score(scored, quality.train(scored, labels)).count() == len(ROWS)
    assert log_bilinear.score_texts(docs, spark).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_statistics_by_their_definitions():
    text = "One two two three.\nOne two two three.\nA very-very-long-word-of-many-letters 42 ## !\n\n"
    words = text.split()
    logit = lambda k, of: math.log((k + 0.5) / (max(of, k) - k + 0.5 + 0.02 * of))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = Counter(zip(words, words[1:]))
    want = {
        "words": math.log1p(len(words)), "word_length": math.log((len(text) + 5) / (len(words) + 1)), "long_words": logit(1, len(set(words))), "symbols": logit(2, len(text)), "marks": logit(1, len(text)),
        "upper": logit(3, sum(c.isalpha() for c in text)), "digits": logit(2, len(text)), "distinct": logit(len(set(words)), len(words)), "same_next": logit(2, len(words)), "top_word": logit(4, len(words)),
        "repeated_pairs": logit(sum(n for n in pairs.values() if n > 1), len(words)), "repeated_lines": logit(1, 3), "line_words": math.log1p(len(words) / 4),
    }
    got = dict(zip(quality.FEATURES, quality.statistics(text)))
    assert len(lines) == 3 and all(abs(got[k] - v) < 1e-9 for k, v in want.items()), {k: (got[k], v) for k, v in want.items() if abs(got[k] - v) > 1e-9}
    assert len(quality.statistics(None)) == len(quality.FEATURES) == len(quality.statistics("word " * 60_000))


def test_equal_pages_give_equal_texts(spark):
    page = "<article><p>Some words of it</p><p>Some words of it</p></article>"
    got = html_text.extract(spark.createDataFrame([(1, page), (1, page), (2, page)], "page_id long, html string")).collect()
    assert [r.text for r in got] == ["Some words of it\n\nSome words of it"] * 3
