"""Hard negatives against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonescope.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows, positives=5, k=5):
    table = set()
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            table.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, q in table:
        if i % 10:
            continue
        most = negatives.MOST
        rows = sorted((-max(-most, min(most, sum(a * b for a, b in zip(q, r, strict=True)))), j, own)
                      for j, own, r in table if j != i and len(r) == len(q))
        for fall, j, _ in [r for r in rows if r[2] == label][:positives]:
            window = [r for r in rows if r[2] != label and -80 * fall <= -100 * r[0] <= -100 * fall]
            out += [(i, j, n + 1, r[1], -fall, -r[0]) for n, r in enumerate(window[:k])]
    return sorted(out)


def mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("clash"), "slot": F.lit(1)})
    return sorted(map(tuple, negatives.hard_negatives(
        frame, F.col("id") % 10 == 0, **options).collect()))


def random_rows(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.random()]) for _ in range(6)], rng.randint(0, 3))
            for i in range(n)]
    rows += [(n + i, rows[0][1], i % 4) for i in range(150)]  # one vector very often
    rows += [(i, v, c) for i, v, c in rows[:40]] * 3  # repeated rows
    rows += [(-10, [0.5] * 6, 1), (7, [0.5] * 6, 1), (10, [1.0] * 6, 2)]  # ids twice, below zero
    rows += [(1000, None, 1), (1001, [0.1] * 6, None), (None, [0.1] * 6, 1), (1010, [], 1), (1011, [], 2),
             (1012, [], 1), (1002, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [math.nan] + [0.0] * 5, 1),
             (1020, [math.inf] + [0.0] * 5, 1), (1030, [1.0, 1.0], 1), (1031, [1.0, 1.0], 1),
             (1032, [1.0, 0.9], 2)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [False, True])
def test_every_window(spark, blocks, monkeypatch):
    if blocks:
        for name, value in (("ANCHORS", 9), ("PART", 60), ("CHUNK", 7), ("MERGE", 2)):
            monkeypatch.setattr(negatives, name, value)
    rows = random_rows(5)
    got = mined(spark, rows)
    assert got == brute_force(rows) and len(got) > 300


def test_other_counts(spark):
    rows = random_rows(6, 120)
    assert mined(spark, rows, positives=2, k=3) == brute_force(rows, 2, 3)


def test_large_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1.0, 3e6, 1e9, 7e12, 3e38]) for _ in range(3)], i % 2) for i in range(60)]
    assert mined(spark, rows) == brute_force(rows)


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 2)]) == []
