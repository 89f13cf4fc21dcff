import math

import numpy as np
import pytest

from modlens.llm import search

VECTORS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, queries, k):
    out = {}
    for q, v in queries:
        found = sorted((-int(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in found[:k]]
    return out


def quantize(v):
    return [math.floor(1024 * float(np.float32(x))) for x in v]


@pytest.mark.parametrize("queries_are_rows", [True, False])
def test_top_k(spark, queries_are_rows):
    mixed = np.random.default_rng(0)
    rows = [(k, mixed.normal(0, 0.2, 64).tolist(), 0) for k in range(700)]
    rows += [(1000 + k, rows[5][1], 0) for k in range(60)]  # ties
    rows += [(2000, [0.1] * 8, 0), (2001, [0.2] * 8, 0), (2100, [0.3] * 8, 0), (3000, [], 0), (3100, [], 0)]
    bad = [(4000, None, 0), (4100, [float("nan")] * 64, 0), (4200, [None] * 64, 0), (4300, [float("inf")] + [0.0] * 63, 0), (None, [0.1] * 64, 0)]
    frame = search.quantized(search.usable(spark.createDataFrame(rows + bad, VECTORS).repartition(5), "vec_id", "embedding"), 1024)
    got = {}
    for r in search.top_k(frame, frame.where("vec_id % 100 = 0"), 10, queries_are_rows).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    plain = [(i, quantize(v)) for i, v, _ in rows]
    want = by_hand(plain, [p for p in plain if p[0] % 100 == 0], 10)
    assert {q: [(i, s) for _, i, s in sorted(found)] for q, found in got.items()} == {q: f for q, f in want.items() if f}


def test_empty(spark):
    frame = search.quantized(search.usable(spark.createDataFrame([], VECTORS), "vec_id", "embedding"), 1024)
    assert search.top_k(frame, frame, 10, True).collect() == []


def test_bounds_hold():
    mixed = np.random.default_rng(1)
    a, b = mixed.normal(size=(2, 40, 30))
    for segments in (1, 2, 7, 30, 99):
        assert (search.statistics(a, segments) @ search.statistics(b, segments).T + 1e-9 >= a @ b.T).all()
