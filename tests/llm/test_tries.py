"""Prefix tries against rebuilt conversations in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from zonescope.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def said(row):
    return row[2] or "", row[3] or ""


def tie(row):
    return hashlib.md5("\0".join(said(row)).encode()).digest()


def brute_force(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    for turns in own.values():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, tie(r)))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(map(said, own.get(base, [])[:h] + own[c][h:]))
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(of) - 1) * len(node[-1][1]) if node else 0
    return {
        (min(of), len(node), min(members[node[:-1]]) if node else None, len(of), children[node],
         leaves[node], saved[node], hashlib.sha256(",".join(
             str(c) for c in sorted(of) if paths[c] == node).encode()).hexdigest())
        for node, of in members.items()}


def found(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumns(
        {"depth": F.lit("clash"), "k1": F.lit(1), "conv": F.lit(2)})
    got = tries.prefix_trie(frame).collect()
    assert len(got) == len(set(got))
    return set(map(tuple, got))


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), *range(300, 340), *range(-130, -90), 7_000_000_019]:
        for turn in range(rng.choice([0, 1, 2, 5, 8, 9])):
            rows.append((c, turn, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None])))
    rows += [(5, 3, "user", "tie"), (5, 3, "bot", "tie"), (5, None, "user", "first")] * 2
    rows += [(None, 1, "user", "nobody"), (303, 2, "user", "long " * 50_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_every_node(spark, seed):
    rows = random_rows(seed)
    assert found(spark, rows) == brute_force(rows)


def test_long_conversations_span_blocks_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", 16)
    monkeypatch.setattr(tries, "PACK", 3)
    rows = [(c, i, "user", f"t{i // 2}") for c in (200, 201, 205) for i in range(300)]
    rows += [(c, 0, "user", "hello") for c in range(400, 460)]
    assert found(spark, rows) == brute_force(rows)


def test_equal_products_of_different_turns_are_told_apart(spark, monkeypatch):
    """With elements that depend on the seed only from the second try on, the first try fails."""
    plain = tries.turns_of
    monkeypatch.setattr(tries, "turns_of", lambda rows, seed: plain(rows, seed) if seed else plain(
        rows, seed).withColumns({"a": F.lit(5).cast("long"), "b": F.lit(6).cast("long")}))
    rows = random_rows(3)
    assert found(spark, rows) == brute_force(rows)


def test_empty_table_and_only_null_ids(spark):
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "x")]) == set()
