import math
import random

import numpy as np
import pytest
from shardmend.llm import ann


def brute(rows, k):
    """rows: (id, vector); nearest by the same double-precision measure."""
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, u in good:
        if q % 50:
            continue
        best = {}
        for i, v in good:
            if i != q and len(v) == len(u):
                s = float(ann.cosine(np.array([u]), np.array([v]))[0])
                best[i] = max(s, best.get(i, -2))
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return {(q, n, i, -s) for q, b in out.items() for n, (s, i) in enumerate(b, 1)}


def test_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(12)]) for i in range(400)]
    hot = rows[50][1]
    rows += [(i, hot) for i in range(400, 700)]  # a vector that very many rows share
    rows += [(700, None), (701, []), (702, [0.0] * 12), (703, [math.nan] * 12), (704, [math.inf] + [1.0] * 11), (705, [None] + [1.0] * 11), (None, hot)]
    rows += [(750, [1e-30] * 12), (751, [1e30] * 12), (752, [-1.0] * 12), (800, [1.0, 2.0]), (801, [2.0, 4.0]), (850, [3.0] * 5)]
    rows += rows[3:6]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double").repartition(5)
    f32 = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = ann.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    want = brute(f32, 5)
    assert len(got) == len(want)
    assert {tuple(r)[:3] for r in got} == {w[:3] for w in want}
    assert max(abs(a[3] - b[3]) for a, b in zip(sorted(map(tuple, got)), sorted(want), strict=True)) < 1e-12
    assert ann.nearest(frame.limit(0), frame.limit(0)).count() == 0


@pytest.mark.parametrize("dims", [3, 64, 1500])
def test_bounds_hold(dims):
    rng = np.random.default_rng(dims)
    a, b = rng.normal(size=(40, dims)), rng.normal(size=(60, dims)) * rng.choice([1e-6, 1, 1e6], (60, 1))
    near, error = ann.tile_bounds(ann.Codes(a), ann.Codes(b))
    true = (a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
    assert (np.abs(true - near) <= error).all() and error.max() < 0.1
