"""The registered queries on the test tables: SQL where there is one, brute force or planted cases where there is none."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from weftline.llm import queries, shared

pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_sql(spark, data, duck):
    assert set(queries.SQL) <= set(queries.QUERIES)
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, data)
        cols = sorted(df.columns)
        want = duck.sql(sql)
        assert cols == sorted(want.columns)
        assert sorted(map(repr, df.select(cols).toPandas().itertuples(index=False, name=None))) == sorted(map(repr, want.df()[cols].itertuples(index=False, name=None))), name


@pytest.fixture(scope="module")
def texts(data, duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents ORDER BY 1").fetchall())


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for d, x in texts.items()}


def test_op1_and_op10(spark, data, texts):
    ids, at = ids_of(texts), 0
    got = {r.doc_id: r for r in queries.QUERIES["op1_token_blocks"](spark, data).collect()}
    for d, x in ids.items():
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    load = Counter()
    rows = queries.QUERIES["op10_best_fit_packing"](spark, data).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        load[r.sequence_id] += r.length
    assert sum(load.values()) == at and max(load.values()) <= 2048 and len(load) <= 1.03 * at / 2048 + 2


def test_op3(spark, data, texts):
    def print_of(x):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x))
        sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in sh]
        return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64))

    prints = {d: print_of(x) for d, x in texts.items()}
    of = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4 and of[a] != of[b]:
                low, high = sorted((of[a], of[b]))
                of = {d: low if c == high else c for d, c in of.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash_near_dedup"](spark, data).collect()}
    assert got == {d: (f"{prints[d]:016x}", of[d]) for d in prints}


def test_op4_and_op6_on_labels(spark, data, duck):
    labels = dict(duck.sql("SELECT doc_id, quality FROM labels").fetchall())
    for r in queries.QUERIES["op4_quality_scores"](spark, data).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in labels and r.held_out:
            assert r.predicted == labels[r.doc_id]
    rules = [r for r in queries.QUERIES["op6_line_quality_rules"](spark, data).collect() if r.doc_id in labels and not r.base_failed]
    good = [r.kept for r in rules if labels[r.doc_id] == 1]
    assert sum(good) >= 0.98 * len(good) and sum(r.kept for r in rules if labels[r.doc_id] == 0) <= 0.2 * len(rules)


def test_op5_base(spark, data, texts):
    words = {d: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x)) + ["\n"] for d, x in texts.items()}
    c = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    got = queries.QUERIES["op5_log_bilinear"](spark, data).collect()
    for r in got:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws))
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op8_recall(spark, data, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found, hit = {}, 0
    for r in queries.QUERIES["op8_learned_partitions"](spark, data).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(x[ids == r.query_id][0] @ x[ids == r.vec_id][0]), abs=1e-12)
    for q in found:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(found[q] & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit >= 0.9 * 20 * len(found)


def test_pipeline(spark, data, texts):
    docs = shared.table(spark, data, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = docs
        docs = shared.written(stage(spark, docs, data), spark, "stage")
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name in ("quality rules", "near dedup"):
            assert docs.exceptAll(before).count() == 0, name
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2]
    out = corpus_pipeline.STAGES[4][1](spark, docs, data)
    assert out.agg({"length": "sum"}).first()[0] == sum(len(x) for x in ids_of({i: r.text for i, r in enumerate(docs.collect())}).values())
