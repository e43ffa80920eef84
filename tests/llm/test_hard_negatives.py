"""Hard negatives against all pairs in plain Python."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SMALL
from wellstream.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    kept = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own = ((label + 1) % 10 if i % 7 == 0 else label, [float(c) for c in x])
        kept[i] = min(kept.get(i, own), own)
    kept = {i: (label, [math.floor(256 * c) for c in x]) for i, (label, x) in kept.items()}
    out = []
    for a in (i for i in kept if i % 100 == 0):
        near, far = defaultdict(list), None
        for i, (label, x) in kept.items():
            if i != a:
                near[label == kept[a][0]].append((-sum(p * q for p, q in zip(x, kept[a][1], strict=False)), i))
        far = sorted(near[False])
        for s, p in sorted(near[True])[:5]:
            fit = [(-t, i) for t, i in far if 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, rank, i, -s, t) for rank, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def found(spark, rows, schema=SCHEMA):
    result = hard_negatives.summary(spark.createDataFrame(rows, schema))
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in result.collect())


def test_given_vectors(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("length", [1, 3, 64, 100])
def test_intervals_hold(length):
    rng = np.random.default_rng(length)
    numbers = np.floor(rng.normal(size=(60, length)) * rng.choice([1, 50, 10_000], size=(60, 1)))
    numbers[3], numbers[7] = 0, numbers[5]
    words, scales, rest = hard_negatives.encode(numbers)
    of = hard_negatives.Vectors(np.arange(60), np.zeros(60), numbers.astype(np.int64), words, scales, rest, np.sqrt((numbers**2).sum(axis=1)))
    low, high = hard_negatives.intervals(of, of)
    true = numbers @ numbers.T
    assert (low <= true).all() and (true <= high).all()
    lengths = of.length[:, None] * of.length
    assert np.mean((high - low)[lengths > 0] / lengths[lengths > 0]) < 0.8 or length < 64


def test_blocks_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 16)
    rng = random.Random(7)
    hot = [rng.uniform(-1, 1) for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(8)], rng.choice([1, 1, 2, 3])) for i in range(900)]
    assert found(spark, rows) == expected(rows)


def test_odd_rows(spark):
    v = [0.5, -0.25, 1.0]
    rows = [(0, v, 1), (0, v, 1), (100, v, 1), (100, [0.75, 0.0, 1.0], 1), (200, None, 1), (300, v, None), (None, v, 1), (400, [0.5, None, 1.0], 2), (500, [float("nan"), 1.0, 1.0], 1),
            (600, [float("inf"), 1.0, 1.0], 1), (700, [], 1), (800, v, 3), (1, v, 1), (2, [0.5], 2), (3, [0.5, -0.25, 1.0, 0.5], 2), (4, v, 4), (5, v, 5), (6, [0.5, -0.2, 0.9], 2), (7, v, 1), (8, v, 1), (9, v, 6), (11, v, 7), (12, v, 8),
            (13, [-0.5, 0.25, -1.0], 1), (900, [-0.5, 0.25, -1.0], 9), (14, [3e38, 0.0, 0.0], 2), (1000, [0.0, 0.0, 0.0], 2)]
    names = ["vector", "codes", "scales", "rest", "length", "limits", "anchor_id", "cap", "score", "rank", "count", "least"]
    wide = [(*r, *range(len(names))) for r in rows if r[0] != 14]
    assert found(spark, wide, f"{SCHEMA}, {', '.join(f'{c} int' for c in names)}") == expected([r for r in rows if r[0] != 14])
    assert len(found(spark, rows)) > 0
    assert found(spark, []) == []
