"""Every query that has SQL against DuckDB on the same tables; every other one by its rows."""

import math

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.registry.queries(), entry.registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "__float__") and not isinstance(v, (int, bool, str)):
        return round(float(v), 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([plain(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in SQL:
        want = duck.sql(SQL[name])
        a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        assert a[1] == b[1]


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_places_of_equal_and_missing_scores(spark, tmp_path):
    """Few distinct values, both zeros, NaN, infinities, nulls, vectors that are short, empty or null: places are those of the SQL."""
    import duckdb

    base = [((7 * i) % 64 - 20) / 8 for i in range(64)]

    def with_(**at):
        return [at.get(f"k{i}", v) for i, v in enumerate(base)]

    nan, inf = math.nan, math.inf
    vectors = [base, with_(k3=base[20]), with_(k0=base[31], k9=base[31]), [0.5] * 64, [float(i % 4) for i in range(64)], with_(k3=0.0, k20=-0.0), with_(k3=-0.0, k20=0.0)]
    vectors += [with_(k3=nan, k20=nan), with_(k3=inf, k20=inf, k5=-inf), with_(k3=None), with_(k3=None, k20=None, k9=nan), [None] * 64, base[:10], [*base[:9], None], [], None]
    name, path = "fn_inverse_permutation", f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").selectExpr("*", "0 AS label").coalesce(1).write.parquet(path)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = c.sql(SQL[name])
    df = QUERIES[name](spark, str(tmp_path))
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
