"""Components of chains, stars and rings."""

import numpy as np

from weftline.llm import graph


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, x) for x in range(501, 530)]
    ring = [(x, 900 + (x - 900 + 7) % 20) for x in range(900, 920)]
    links = chain[::-1] + star + ring + [(5, 5), (None, 3), (180, 100)]
    got = dict(graph.components(spark.createDataFrame(links, "a long, b long"), spark).collect())
    want = {i: 100 for i in range(101, 181)} | {x: 500 for x in range(501, 530)} | {x: 900 for x in range(901, 920)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), spark).count() == 0


def test_roots():
    a, b = np.array([9, 4, 4, 20]), np.array([4, 2, 7, 21])
    nodes, low = graph.roots(a, b)
    assert dict(zip(nodes.tolist(), low.tolist())) == {4: 2, 7: 2, 9: 2, 21: 20}
