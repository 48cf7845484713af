"""Line dedup, MinHash near-dedup and the pipeline against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from zonescope.llm import lines, minhash, mixing, quality

ALPHABET = "abcde fg"


def edited(rng, text):
    i, c = rng.randrange(len(text)), rng.choice(ALPHABET + "é👍")
    return rng.choice([text[:i] + c + text[i + 1:], text[:i] + c + text[i:], text[:i] + text[i + 1:]])


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return len(a) - len(b) <= 1 and a[i + 1:] == b[i + (len(a) == len(b)):]


def classes(items, linked):
    label = {x: x for x in items}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in items:
        for b in items:
            if a < b and find(a) != find(b) and linked(a, b):
                label[find(b)] = find(a)
    return {x: find(x) for x in items}


def plain_drops(docs, least=lines.MIN_CHARS):
    cut = [(i, t.split("\n")) for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0])
           if t is not None]
    every = sorted({x for _, own in cut for x in own if len(x) >= least})
    label, seen, equal, out = classes(every, one_edit), set(), set(), set()
    for i, own in cut:
        for k, x in enumerate(own):
            if len(x) >= least:
                if label[x] in seen:
                    out.add((i, k, x not in equal))
                seen.add(label[x])
                equal.add(x)
    return out


def test_lines_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", 3)
    rng = random.Random(5)
    base = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(24, 60))) for _ in range(30)] + ["a" * 40]
    docs = []
    for i in range(150):
        own = ["short", ""]
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base[:2] if rng.random() < 0.5 else base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                x = edited(rng, x)
            own.append(x)
        rng.shuffle(own)
        docs.append((i, "\n".join(own)))
    docs += [(900, None), (901, ""), (902, "z" * 20_000), (903, "z" * 10_000 + "y" + "z" * 9_999),
             (904, "\n".join(["same line of some length here"] * 3))]
    df = spark.createDataFrame(docs + [(None, docs[0][1])], "doc_id long, text string").withColumn(
        "line", F.lit("clash")).repartition(4)
    dropped = lines.dropped_lines(df)
    got = {tuple(r) for r in dropped.drop("of").collect()}
    assert got == plain_drops(docs) and len(got) > 100
    cleaned = {r.doc_id: r.text for r in lines.without_dropped(df, dropped).collect()}
    for i, t in docs:
        if t is not None:
            kept = [x for k, x in enumerate(t.split("\n")) if not {(i, k, True), (i, k, False)} & got]
            left = "\n".join(kept)
            assert cleaned.get(i, "") == left if left.strip() or left == t else i not in cleaned
    assert cleaned[None] == docs[0][1] and cleaned[900] is None


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("crowd", [3, 16])
def test_lines_a_few_edits_apart_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "BLOCK", 8)
    rng = random.Random(9)
    base = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([24, 47, 48, 71, 72, 95, 96, 99, 130])))
            for _ in range(12)]
    own = []
    for i in range(130):
        x = base[0] if i < 40 else rng.choice(base)
        for _ in range(rng.randint(0, 7)):
            x = edited(rng, x)
        own.append(x)
    own = [x for x in own if len(x) >= lines.MIN_CHARS]

    def linked(a, b):
        most = max(1, min(4, min(len(a), len(b)) // 24))
        return abs(len(a) - len(b)) <= most and edit_distance(a, b) <= most
    label, seen, equal, want = classes(sorted(set(own)), linked), set(), set(), set()
    for i, x in enumerate(own):
        if label[x] in seen:
            want.add((i, 0, x not in equal))
        seen.add(label[x])
        equal.add(x)
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in lines.dropped_lines(df, max_edits=4).drop("of").collect()}
    assert got == want and len(got) > lines.dropped_lines(df).count()


def test_rounds_of_lengths_let_few_probes_through_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(21)
    signs = ALPHABET + "\u00e9\u4e00\U0001f600"
    own = []
    for n in [24, 25, 47, 48, 49, 95, 96, 97, 120, 240] * 12:
        own.append("".join(rng.choice(signs if n % 2 else ALPHABET) for _ in range(n)))
        for edits in (rng.randint(0, 3), rng.randint(2, 6)):
            x = own[-1]
            for _ in range(edits):
                x = edited(rng, x)
            own.append(x)
    df = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").repartition(3)
    at_once = {tuple(r) for r in lines.dropped_lines(df, max_edits=4).collect()}

    rows, keep = {}, lines.written
    def kept(table, name, **more):
        out = keep(table, name, **more)
        rows.setdefault(name, []).append(out.count())
        return out
    monkeypatch.setattr(lines, "written", kept)
    monkeypatch.setattr(lines, "ROW_BITS", 2)
    monkeypatch.setattr(lines, "WORD_BITS", 6)
    monkeypatch.setattr(lines, "ROUND_SEGMENTS", 4 << 6)
    assert {tuple(r) for r in lines.dropped_lines(df, max_edits=4).collect()} == at_once
    every = lines.occurrences(df, "doc_id", "text", 24)
    probes = lines.segments(every, 4, 24, True).count()
    assert len(rows["line-probes"]) > 2 and len(at_once) > 100
    assert sum(rows["line-probes"]) < probes / 10


def test_word_sketches_pass_all_lines_within_the_edits(spark):
    rng = random.Random(22)
    pairs = []
    for _ in range(400):
        a = b = "".join(rng.choice("ab c") for _ in range(rng.randint(24, 60)))
        edits = rng.randint(0, 4)
        for _ in range(edits):
            at, sign = rng.randrange(len(b)), rng.choice(["a", " ", "", "b ", "x"])
            b = b[:at] + sign[:1] + b[at + rng.randint(0, 1):]
        pairs.append((a, b, edits))
    pairs += [(a, c, 9) for (a, _, _), (c, _, _) in zip(pairs, pairs[1:], strict=False)]
    table = spark.createDataFrame(pairs, "a string, b string, edits int")
    found = table.select("edits", lines.word_sketch(F.col("a")).alias("x"), lines.word_sketch(
        F.col("b")).alias("y")).select("edits", lines.alike("x", "y", F.col("edits")).alias("same"),
                                       lines.alike("x", "y", F.lit(1)).alias("close")).collect()
    assert all(r.same for r in found if r.edits < 9)
    assert sum(r.close for r in found if r.edits == 9) < 100


def test_probes_are_few_and_find_every_segment(spark):
    rng = random.Random(31)
    signs, pairs = "abcdefgh é👍", []
    for n in [24, 35, 36, 47, 48, 71, 72, 95, 96, 107, 108, 191, 192, 207, 208, 335, 4095, 4096] * 8:
        a = b = "".join(rng.choice(signs) for _ in range(n))
        for _ in range(max(1, min(4, n // 24))):
            i = rng.randrange(len(b))
            b = rng.choice([b[:i] + "x" + b[i:], b[:i] + "x" + b[i + 1:], b + "x"])
        pairs.append((a, b))
    table = lambda k: spark.createDataFrame(
        [(i, p[k]) for i, p in enumerate(pairs)], "node long, line string")
    keys = lambda k, probes: {
        (r.node, r.segment) for r in lines.segments(table(k), 4, 24, probes).collect()}
    met = {n for n, _ in keys(0, False) & (keys(1, False) | keys(1, True))}
    assert met == set(range(len(pairs)))
    # 44 for a line of 100 characters or more, when each length had segments of its own.
    assert lines.segments(table(0), 4, 24, True).count() < 16 * len(pairs)


def test_pair_sketches_pass_all_lines_within_the_edits(spark):
    rng = random.Random(32)
    words = ["".join(rng.choice("aeioust") for _ in range(rng.randint(4, 8))) for _ in range(300)]
    texts, edits = [], []
    for n in range(300):
        own = [rng.choice(words) for _ in range(80)]
        a = b = " ".join(own)
        if n % 2:
            for i in rng.sample(range(80), 2):
                own[i] = "".join(rng.choice("bcdfgh") for _ in range(7))
            b = " ".join(own)
        else:
            for _ in range(4):
                b = edited(rng, b)
        texts += [(2 * n, a), (2 * n + 1, b)]
        edits.append(n % 2)
    got = {r.node: r for r in lines.pair_sketches(spark.createDataFrame(
        texts, "node long, line string")).collect()}
    bits = lambda a, b, i: ((a[f"p{i}"] ^ b[f"p{i}"]) & (1 << 64) - 1).bit_count()
    apart = [sum(bits(got[2 * n], got[2 * n + 1], i) for i in range(lines.SKETCH)) for n in range(300)]
    assert all(x <= 16 for x, other in zip(apart, edits, strict=True) if not other)
    assert sum(x <= 16 for x, other in zip(apart, edits, strict=True) if other) < 15


def test_distances_of_what_is_left_between_equal_ends(spark):
    rng = random.Random(33)
    pairs = [("", ""), ("", "a"), ("abc", "abc"), ("a\u00e9b", "a\u00e8b"), ("aaaa", "aaa"), ("\u00e9" * 40, "")]
    for _ in range(300):
        a = b = "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randint(1, 40)))
        for _ in range(rng.randint(0, 6)):
            b = edited(rng, b) if b else b
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    found = df.select("a", "b", lines.distance(F.col("a"), F.col("b"), 4).alias("got"),
                      F.levenshtein("a", "b", 4).alias("want")).collect()
    assert all(r.got == r.want for r in found) and {r.got for r in found} == {-1, 0, 1, 2, 3, 4}


def test_texts_are_shuffled_only_where_lines_meet(spark, monkeypatch):
    plans, keep = [], lines.written
    def kept(table, name, **more):
        if name == "line-texts":
            plans.append(table._jdf.queryExecution().optimizedPlan().toString())
        return keep(table, name, **more)
    monkeypatch.setattr(lines, "written", kept)
    own = [(i, f"line {i} that has some near copy" + "x" * (i % 2)) for i in range(20)]
    df = spark.createDataFrame(own, "doc_id long, text string")
    lines.dropped_lines(df)
    assert len(plans) == 1 and "LeftSemi" not in plans[0]


def test_texts_of_one_id_are_documents_of_their_own(spark):
    line = "a line that is found twice in all of them"
    own = "a line that is found nowhere else at all"
    docs = spark.createDataFrame(
        [(1, line), (2, line + "\n" + line), (2, own + "\n" + line), (3, own[::-1]), (3, own[::-1]), (4, None)],
        "doc_id long, text string").withColumn("of", F.lit("clash"))
    cleaned = lines.without_dropped(docs, lines.dropped_lines(docs))
    assert sorted((r.doc_id, r.text or "") for r in cleaned.collect()) == [
        (1, line), (2, own), (3, own[::-1]), (3, own[::-1]), (4, "")]
    six = "one two three four five six"
    rows = spark.createDataFrame(
        [(1, six), (2, six), (2, "other words that none of the others has"), (5, None)],
        "doc_id long, text string").withColumn("text_hash", F.lit("clash"))
    assert sorted((r.doc_id, (r.text or "")[:5]) for r in minhash.one_per_group(rows).collect()) == [
        (1, "one t"), (2, "other"), (5, "")]


def test_lines_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dropped_lines(df).count() == 0
    with pytest.raises(ValueError, match="long enough"):
        lines.dropped_lines(df, min_chars=4)


def test_edit_automaton(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab", ""), ("", "ab"), ("ab", "ba")]
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))
        b = a
        for _ in range(rng.randint(0, 2)):
            b = edited(rng, b) if b else b
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", lines.one_edit(F.col("a"), F.col("b")).alias("one")).collect():
        assert r.one == one_edit(r.a, r.b), (r.a, r.b)


def shingle_set(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))) if words \
        else frozenset()


def plain_groups(docs, width):
    sets = {i: shingle_set(t, width) for i, t in docs}

    def near(i, j):
        a, b = sets[i], sets[j]
        both = len(a & b)
        return bool(a) and 100 * both >= 80 * (len(a) + len(b) - both)
    return sets, classes(sorted(sets), near)


def near_copies(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    docs = []
    for group in range(25):
        base = [word() for _ in range(rng.randint(1, 90))]
        for _ in range(120 if group == 0 else rng.randint(1, 6)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own))
    docs += [None, "", " \n", "One", "one", "ONE two", "one two", "é É", " ".join(word() for _ in range(9000))]
    return list(enumerate(docs))


@pytest.mark.parametrize("width, block, pooled, group", [
    (2, 4, 3, 4096), (2, 16, 8, 5), (5, 256, 64, 4096)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, block, pooled, group):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TOGETHER", 2)
    monkeypatch.setattr(minhash, "GROUP", group)
    monkeypatch.setattr(minhash, "POOLED", pooled)
    docs = near_copies(random.Random(width))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("bands", F.lit(1))
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(
        df.repartition(5), width=width).collect()}
    sets, label = plain_groups(docs, width)
    least = defaultdict(lambda: 10 ** 9)
    for i, c in label.items():
        least[c] = min(least[c], i)
    assert got == {i: (len(sets[i]), least[label[i]], least[label[i]] == i) for i, _ in docs}
    assert len(set(label.values())) < len(docs) - 20


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, "a b c"), (6, None)],
                                "doc_id long, text string")
    assert sorted((str(r.id), r.n_shingles, r.component_id, r.kept) for r in
                  minhash.near_duplicates(odd, width=2).collect()) == [
        ("3", 2, 3, True), ("3", 2, 3, True), ("5", 2, 3, False), ("6", 0, 6, True), ("None", 2, None, True)]
    assert sorted(str(r.doc_id) for r in minhash.one_per_group(odd, width=2).collect()) == [
        "3", "3", "6", "None"]


def test_posterior_bound_keeps_pairs_at_the_threshold():
    rule = minhash.needed(0.8)
    assert [n for n, _ in rule] == list(range(16, 129, 16))
    assert all(0.1 < m / n < 0.72 for n, m in rule) and [m for _, m in rule] == sorted(m for _, m in rule)


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name.replace(" ", "-")))
        seen[name], before = (docs, spark.read.parquet(str(tmp_path / name.replace(" ", "-")))), docs
        docs = seen[name][1]
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        assert docs.count() > 0 and before.count() > 0
    given, kept = seen["quality rules"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    values = quality.with_values(quality.measured(given), keep=["doc_id"])
    verdicts = quality.judged(values, quality.thresholds(quality.sketches(values))).collect()
    assert ids == {r.doc_id for r in verdicts if r.kept}
    given, cleaned = seen["line dedup"]
    rows = [(r.doc_id, r.text) for r in given.collect()]
    drops = {(i, k) for i, k, _ in plain_drops(rows)}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in drops) for i, t in rows}
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: t for i, t in want.items() if t.strip()}
    given, single = seen["near dedup"]
    _, label = plain_groups([(r.doc_id, r.text) for r in given.collect()], 5)
    groups = defaultdict(list)
    for i, c in label.items():
        groups[c].append(i)
    assert sorted(r.doc_id for r in single.collect()) == sorted(map(min, groups.values()))
    given, out = seen["source mixing"]
    keyed = mixing.sized(given)
    taken = {r.doc_id: r for r in mixing.mix(keyed, mixing.mix_plan(keyed)).collect()}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(counts.get(i, 0) * r.size - r.taken) <= r.size / 2 for i, r in taken.items())
    given, ids = seen["byte bpe"]
    assert ids.count() == given.count() and ids.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    same = given.select("doc_id", F.sha2("text", 256).alias("h")).join(ids, "doc_id").filter(
        "h = decoded_sha256")
    assert same.select("doc_id").distinct().count() == given.select("doc_id").distinct().count()


def test_pipeline_stages_on_odd_documents(spark):
    sf = "/root/testdata/sf0.001"
    words = " ".join(f"word{i:02}" for i in range(60))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, words, "en", "a", 9), (3, words, "en", "a", 9),
            (3, words.replace("word", "term"), None, "a", 9), (None, words.upper(), "en", None, 9),
            (4, " ".join(f"{i:06}" for i in range(60_000)), "en", "b", 9)]
    for given in (rows, []):
        docs = spark.createDataFrame(
            given, "doc_id long, text string, lang string, source string, n_chars long").withColumn(
            "Kept", F.lit("clash"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            left = sorted((str(r.doc_id), r.text[:5]) for r in out.collect()) if "text" in out.columns else None
            if name != "byte bpe":
                assert out.columns == docs.columns, name
            if given and name == "quality rules":
                assert left == [("3", "term0"), ("3", "word0"), ("3", "word0"), ("4", "00000"), ("None", "WORD0")]
            if given and name == "near dedup":  # the namesake stays, in both its texts
                assert left == [("3", "term0"), ("3", "word0"), ("3", "word0"), ("4", "00000"), ("None", "WORD0")]
            docs = out if name != "byte bpe" else docs
        assert out.count() == docs.count()
