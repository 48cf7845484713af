"""Operators on single texts: token counts, language, quality, byte-level BPE."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from zonescope.llm import bpe, language, quality, unigram

DOCS = "/root/testdata/sf0.001/documents.parquet"
ODD = [None, "", " ", "\n", "a", "é", "漢字 👍", "x" * 30_000, " " * 2000, "ab" * 4000, "one\r\ntwo\n\n",
       "<s> <|endoftext|>", "don't we'll 123 45,6", "a  b   c", "\x00\x1c\x85", "tab\tend "]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["a", "b ", "the", " ", "  ", "\n", "é", "ß", "1", "'s", "'", ".", "***", "漢", "👍", "\t", "ing"]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return ODD + mixed + pq.read_table(DOCS, columns=["text"])["text"].to_pylist()


def frame(spark, texts):
    rows = [(i, t, "en", "s", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_tokens long").repartition(3)


def test_token_counts_equal_the_tokenizer(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = unigram.read_pieces(path)
    # Control pieces are no text: the tokenizer gets the same pieces, and bytes to fall back to.
    whole = [("<unk>", 0.0), *pieces.pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    want = Tokenizer(models.Unigram(vocab=whole, unk_id=0, byte_fallback=True))
    docs = frame(spark, texts)
    got = {r.doc_id: r.n_tokens for r in unigram.with_token_counts(
        docs, spark.sparkContext.broadcast(pieces)).collect()}
    for i, t in enumerate(texts):
        own = "▁" + t.replace(" ", "▁") if t else ""
        assert got[i] == len(want.encode(own).ids), repr(t)[:80]


def test_token_count_ties_and_scores_that_do_not_add_up():
    tie = unigram.Counter(unigram.vocabulary(
        {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "abb": -3.0, "c": -0.5}, prefix=False))
    assert [tie.count(t) for t in ("ab", "abb", "ba", "cc", "a?b", "")] == [1, 1, 2, 2, 3, 0]
    odd = unigram.Counter(unigram.vocabulary({"a": -0.1, "aa": -0.15, "▁": -0.3, "▁a": -0.35}))
    assert not odd.by_part and odd.count("aa a") == 3
    assert unigram.Counter(unigram.vocabulary({})).count("é") == 5


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rest = language.held_out(F.col("doc_id"))
    model = language.fit(language.bin_counts(docs.filter(~rest)))
    scored = language.with_language(docs.filter(rest), spark.sparkContext.broadcast(model))
    hits = scored.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first().a
    assert hits > 0.97
    odd = frame(spark, ODD).drop("lang").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language.with_language(
        odd, spark.sparkContext.broadcast(model)).collect()}
    letters = [any(c.isalpha() for c in t or "") for t in ODD]
    assert [got[i].lang_pred != "und" for i in range(len(ODD))] == letters
    assert all(0 < r.score <= 1 if letters[i] else r.score == 0 for i, r in got.items())
    with pytest.raises(ValueError, match="languages"):
        language.fit(language.bin_counts(docs), cells=language.BINS)


def test_language_scores_do_not_depend_on_blocks(monkeypatch):
    texts = ["Ça va très bien", None, "the end of the story " * 9, "ß"]
    model = language.Model(("a", "b"), np.random.default_rng(1).normal(
        size=(language.BINS, 2)).astype(np.float32), np.zeros(2))
    whole, n = language.scores(texts, model)
    monkeypatch.setattr(language, "BLOCK", 5)
    cut, m = language.scores(texts, model)
    assert np.allclose(whole, cut) and (n == m).all()


def test_language_without_anything_to_learn(spark):
    nothing = spark.createDataFrame([(None, None)], "text string, lang string")
    model = language.fit(language.bin_counts(nothing))
    assert model.langs == () and language.predict(["a"], model) == [{"lang": "und", "score": 0.0}]


def test_measures_equal_a_plain_count(texts):
    for t in texts:
        words = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in t or "").split(" ") if w]
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} \
            if len(words) < 3000 else None
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        n_words, n_lines, chars, symbols, dup, repeat = quality.measure(None if t is None else t.encode())
        assert (n_words, n_lines, chars) == (len(words), len(lines), sum(map(len, words)))
        assert symbols == sum((t or "").count(c) for c in "#*$%&|<>")
        assert dup == len(lines) - len(set(lines)) and (again is None or repeat == len(again))


def test_quality_keeps_clean_documents_and_adapts(spark):
    rng = random.Random(2)
    text = lambda n, sign="": " ".join(
        "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) + sign for _ in range(n))
    rows = [(i, text(120), "en", "a") for i in range(300)]
    rows += [(1000 + i, text(120, "***"), "en", "a") for i in range(100)]
    rows += [(2000 + i, text(120, "#"), "en", "code") for i in range(300)]  # usual in this source
    rows += [(3000, None, None, None), (3001, "", "en", "a"), (3002, text(120), None, None),
             (3002, text(120), None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({"kept": F.lit("clash"), "n_words": F.lit(1)})
    kept = {r.doc_id for r in quality.accepted(docs).collect()}
    assert kept == set(range(300)) | set(range(2000, 2300)) | {3002}
    assert quality.accepted(docs).columns == docs.columns
    assert quality.accepted(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens)})


def test_bpe_equals_the_tokenizer_and_decodes(spark, texts, vocabulary, reference):
    docs, shared = frame(spark, texts), bpe.shared(spark, vocabulary)
    encoded = bpe.encode(docs, shared)
    got = {r.doc_id: r for r in bpe.decode(encoded, shared).collect()}
    digests = {r.doc_id: r.digest for r in bpe.round_trip(
        docs, shared, with_ids=True, cache=100).collect()}
    for i, t in enumerate(texts):
        want = reference.encode_ordinary(t or "")
        assert got[i].ids == want and bytes(got[i].bytes) == (t or "").encode(), repr(t)[:80]
        d = digests[i]
        assert (d.n_tokens, d.ids) == (len(want), want)
        assert d.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert d.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_long_words_and_small_caches(vocabulary, reference, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(bpe, "GROUP_BYTES", 500)
    words = ["".join(rng.choice("abcdeinst") for _ in range(rng.randint(60, 300))) for _ in range(40)]
    words += ["a" * 999, "aab" * 300, "é" * 500, "=" * 1000, "1" * 700]
    codec = bpe.Codec(vocabulary, cache=50)
    rows = codec.encode(words + [" ".join(words)] + words)
    for word, row in zip(words, rows, strict=False):
        assert np.frombuffer(row, np.int32).tolist() == reference.encode_ordinary(word)
    assert [x.decode() for x in codec.decode(rows)] == words + [" ".join(words)] + words
    with pytest.raises(ValueError, match="outside"):
        codec.decode([np.array([len(vocabulary.tokens)], np.int32).tobytes()])


def test_bpe_parts_are_cut_together_and_ids_joined_at_once(vocabulary, reference, monkeypatch):
    codec = bpe.Codec(vocabulary)
    calls, find = [], codec.pattern.findall
    codec.pattern = type("Pattern", (), {"findall": staticmethod(lambda t: calls.append(t) or find(t))})
    texts = ["one two's 3three \u00e9 end\n", "a\nb c\td  e", "x y\r\n\r\n", " z ", "q\x85 r \u2003s", None, ""]
    texts.append(" ".join(f"w{i}" for i in range(500)))
    rows = codec.encode(texts)
    for t, row in zip(texts, rows, strict=True):
        assert np.frombuffer(row, np.int32).tolist() == reference.encode_ordinary(t or "")
    assert len(calls) < 30
    parts = {"w1", "b\n", "", "\u00e9's", "3a"}
    assert codec.cut_parts(parts) == {p: find(" " + p) for p in parts}
    assert codec.decode([b"", *rows, b""]) == [b"", *[(t or "").encode() for t in texts], b""]
    assert codec.decode([b"", b""]) == [b"", b""]


def test_bpe_vocabularies_whose_merges_clash(tmp_path):
    """Tokens that come by several splits, in an order no training gives."""
    rng = random.Random(8)
    for n in range(6):
        own = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)},
                     key=lambda _: rng.random())
        tokens = [bytes([b]) for b in range(256)] + [t.encode() for t in own]
        path = tmp_path / f"ranks-{n}"
        path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
        codec = bpe.Codec(bpe.read_ranks(str(path), r"\S+|\s+"))
        plain = tiktoken.Encoding("x", pat_str=r"\S+|\s+", special_tokens={},
                                  mergeable_ranks={t: i for i, t in enumerate(tokens)})
        words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 90))) for _ in range(150)]
        for word, row in zip(words, codec.encode(words), strict=True):
            assert np.frombuffer(row, np.int32).tolist() == plain.encode_ordinary(word), word
