"""Operators over whole tables: mixing, url rules, revisits, vectors, components."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonescope.llm import components, embeddings, mixing, urls, warc


def water_levels(sizes, weights, share, limit):
    """Reshare by weight until no source is above its limit."""
    named = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(named)}
    total, target, capped = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(limit * sizes[s] for s in capped)
        free = sum(weight[s] for s in named if s not in capped)
        target = {s: limit * sizes[s] if s in capped else left * weight[s] / free for s in named}
        over = {s for s in named if s not in capped and target[s] > limit * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def mixed(docs, **options):
    keyed = mixing.sized(docs)
    return mixing.mix(keyed, mixing.mix_plan(keyed, **options))


def test_mix_reaches_every_target(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "a", "a", "b", "c", None, "zero"]))
            for i in range(600)]
    rows = [(i, None if s == "zero" else t, s) for i, t, s in rows] + [(None, "x y z", "b")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns(
        {"size": F.lit("clash"), "Taken": F.lit(1)})
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    for options in ({}, {"weights": (1, 9), "share": 0.3, "limit": 3.0}, {"share": 2.0}):
        got = mixed(docs, **options).collect()
        settings = {"weights": (5, 2, 1), "share": 1.5, "limit": 2.0} | options
        want, taken = water_levels(sizes, **settings), defaultdict(int)
        for r in got:
            assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
            assert 0 <= r.taken <= settings["limit"] * r.size
            taken[r.source] += r.taken
        assert len(got) == len(rows)
        assert all(abs(taken[s] - want[s]) <= 3 for s in sizes), (taken, want)
    again = mixed(docs.repartition(7)).collect()
    key = lambda rows: sorted((str(r.doc_id), r.taken) for r in rows)
    assert key(again) == key(mixed(docs).collect())


def test_mix_as_documents(spark):
    docs = spark.createDataFrame(
        [(i, "a b c", "s" if i % 3 else "t", i) for i in range(90)],
        "doc_id long, text string, source string, size long")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    # 289 of 270 words make 96 documents, 115 of 90 make 38 and a third of one.
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {
        "s": 96, "t": 38}
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    equal = spark.createDataFrame(
        [(1, "a b c d e", "s", i) for i in range(1000)] + [(2, "w " * 5000, "t", 0)],
        "doc_id long, text string, source string, n int").repartition(5)
    out = mixing.mixed_documents(equal, weights=(7, 4), share=1.1)  # 7000 of 11,000 words for s
    assert {r["source"]: r["count"] for r in out.groupBy("source").count().collect()} == {
        "s": 1400, "t": 1}
    with pytest.raises(ValueError, match="weights"):
        mixed(docs, weights=())


URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://User@A.NET:80/x?y#z",
        "http://example.net/en/1", "http://x.example.net/en/", "http://notexample.net/en/",
        "http://example.net/e", "s://example.com/de/9", "http://b.example.com/de/#/en/", "a://org/fr/",
        "a://x.org/fr/?q", "a://org/fr", "http://a\x01net/", "http://net/\x01", "://net/", "a://b://net/",
        "http://.net/", "http://net./", "http://net//", "http://\U0010ffff.net/"]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"), ("allow", "org", "/fr/"), ("allow", "net", "/x"),
         ("block", "example.net", "/en/"), ("block", None, "/"), ("block", "", ""), ("odd", "net", "/")]


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h), len(p), v == "block", h + p, v) for v, h, p in rules
            if h and p is not None and v in ("allow", "block")
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[3:] if fits else (None, "allow")
    return host, path, rule, verdict


def test_url_rules_equal_a_plain_search(spark):
    rng = random.Random(9)
    names = ["net", "org", "a", "b", "example"]
    rules = RULES + [(rng.choice(["allow", "block"]), ".".join(rng.choices(names, k=rng.randint(1, 3))),
                      rng.choice(["/", "/a", "/a/b", ""])) for _ in range(60)]
    listed = URLS + ["http://" + ".".join(rng.choices(names, k=rng.randint(1, 5)))
                     + rng.choice(["", "/", "/a", "/a/b/c", "/ab?x"]) for _ in range(500)]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(listed)],
                                  "page_id long, url string, verdict string").repartition(5)
    for ranges in (1, 7, 300):
        for own in (rules, RULES):
            got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged_urls(
                pages, urls.rule_table(spark, own), ranges=ranges).collect()}
            assert got == {i: plain_verdict(u, own) for i, u in enumerate(listed)}
    none = urls.judged_urls(pages, urls.rule_table(spark, []), default="block")
    assert {r.verdict for r in none.collect()} == {"block"} and none.count() == len(listed)
    assert urls.judged_urls(pages.limit(0), urls.rule_table(spark, rules)).count() == 0


CAPTURES = ("record_id string, url string, captured_at long, warc_type string, status int, "
            "headers map<string,string>, resolution string")


def test_revisits(spark):
    full = lambda i, u, t, **h: (i, u, t, "response", 200, {k.replace("_", "-"): v for k, v in h.items()}, "x")  # noqa: E501,E731
    seen = lambda i, u, t, **h: (i, u, t, "revisit", 304, {k.replace("_", "-"): v for k, v in h.items()}, "x")  # noqa: E501,E731
    rows = [
        seen("r0", "http://a/", 1, etag="1"), full("f1", "HTTP://A:80", 2, ETag="1", Content_Length="9", Date="d"),
        seen("r1", "http://a/#x", 2, etag="1"), seen("r2", "http://a/", 3, ETAG='W/1', Content_Length="0", X="y"),
        full("f2", "http://a/", 4, etag="2", Last_Modified="m"), full("f3", "http://a/", 4, etag="3", Last_Modified="m"),
        seen("r3", "http://a/?", 5, etag="1"), seen("r4", "http://a/", 6, Last_Modified="m", Date="e"),
        seen("r5", "http://a/", 7), seen("r5", "http://a/", 7), seen("r6", None, 8, etag="3"),
        seen("r7", "http://a/", None, etag="3"), ("o", "http://a/", 5, "request", None, None, "x"),
        ("p", "http://a/", 5, "response", 206, {"etag": "9"}, "x"), full(None, "http://b/", 1, etag="1"),
        seen("r8", "http://b/", 2, etag="1"), seen("r9", "http://b/?q=1", 2, etag="1")]
    df = spark.createDataFrame(rows, CAPTURES).repartition(4)
    got = warc.resolved_revisits(df)
    assert got.columns == [c.split()[0] for c in CAPTURES.split(", ")][:6] + [
        "canonical_url", "resolution", "refers_to", "merged_headers"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.record_id].append((r.resolution, r.refers_to, r.merged_headers))
    assert by["r0"] == [("orphan", None, {"etag": "1"})] and by["r1"][0][0] == "orphan"
    assert by["r2"] == [("resolved", "f1", {"etag": "W/1", "content-length": "9", "date": "d", "x": "y"})]
    assert by["r3"][0][:2] == ("mismatch", None)
    assert by["r4"] == [("resolved", "f3", {"etag": "3", "last-modified": "m", "date": "e"})]
    assert [x[0] for x in by["r5"]] == ["unchecked"] * 2
    assert by["r6"][0][0] == by["r7"][0][0] == by["r9"][0][0] == "orphan"
    assert by["o"][0][0] == by["p"][0][0] == "other" and by["r8"][0][0] == "resolved"
    assert warc.resolved_revisits(df.limit(0)).count() == 0


def test_revisits_of_a_hot_url_span_ranges(spark):
    rng = random.Random(1)
    rows = [(f"{t:04}", "http://hot/", t, *(("response", 200) if rng.random() < 0.02 else ("revisit", 304)),
             {"etag": "e"}, "x") for t in range(900)]
    df = spark.createDataFrame(rows, CAPTURES).repartition(6)
    last, want = None, {}
    for r in rows:
        if r[3] == "response":
            last = r[0]
        else:
            want[r[0]] = last
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.record_id: r.refers_to for r in warc.resolved_revisits(df).collect()
               if r.warc_type == "revisit"}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)]
    edges += [(rng.randint(1000, 1400), rng.randint(1000, 1400)) for _ in range(180)] + [(7, 7), (8, 9), (9, 8)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    want = plain_components([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rows = []
    for i in range(40):
        centre = rng.normal(size=12)
        for _ in range(rng.integers(1, 14) if i else 90):
            spread = rng.normal(size=12) * np.sqrt((centre @ centre) / 12) * rng.choice([0.02, 0.1, 0.14])
            rows.append(((centre + spread).tolist(), int(rng.integers(0, 2))))
    rows += [([1.0] * 12, 0), ([1.0] * 12, 0), ([3.0] * 12, 0), ([1.0] * 12, None), (None, 0), ([], 0),
             ([0.0] * 12, 0), ([float("nan")] * 12, 0), ([float("inf")] + [0.0] * 11, 0),
             ([None] + [1.0] * 11, 0), ([1.0, 0.0], 0), ([1.0, 0.01], 0), ([1e300] * 12, 1), ([1e-300] * 12, 1)]
    table = spark.createDataFrame([(i, v, lab, "clash") for i, (v, lab) in enumerate(rows)],
                                  "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(
        table.repartition(3)).collect()}
    unit = [np.frombuffer(embeddings.unit(v)) if embeddings.unit(v) else None for v, _ in rows]
    edges, links = [], defaultdict(int)
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][1] is not None \
                    and rows[i][1] == rows[j][1] and a @ b >= 0.98:
                edges.append((i, j))
                links[i] += 1
                links[j] += 1
    label = plain_components(edges)
    assert got == {i: (links[i], label.get(i, i), label.get(i, i) == i) for i in range(len(rows))}
    assert len(edges) > 2000
    assert embeddings.near_vectors(table.limit(0)).count() == 0
    odd = embeddings.near_vectors(spark.createDataFrame(
        [(None, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1)],
        "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r.id), r.n_links, r.component_id, r.kept) for r in odd) == [
        ("4", 1, 4, True), ("4", 1, 4, True), ("None", 0, None, True)]


@pytest.mark.parametrize("dim, noise", [(64, 0), (256, 1e-8), (256, 1e-7), (64, 1e-4)])
def test_cells_keep_links_of_rounded_and_scaled_copies(dim, noise):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=dim)
    rows = [centre * rng.uniform(0.5, 3) + noise * rng.normal(size=dim) for _ in range(300)]
    rows += list(rng.normal(size=(600, dim)))
    unit = np.stack([np.frombuffer(embeddings.unit(r.tolist())) for r in rows])
    drawn = np.unique(unit[rng.permutation(len(unit))[:54]], axis=0)
    for centroids in (drawn, embeddings.fit(unit, 54)):
        cells = list(embeddings.places(unit, centroids, np.sin(np.arccos(0.98) / 2)))
        lost = [(i, j) for i, j in np.argwhere(unit @ unit.T >= 0.98)
                if cells[i][0] not in cells[j] and cells[j][0] not in cells[i]]
        assert not lost
