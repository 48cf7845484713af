"""BPE with a transducer lexicon against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, pre_tokenizers

from zonescope.llm import queries, transducer, wordbpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n", "a", "é", "漢字 👍", "x" * 30_000, " " * 2000, "ab" * 4000, "one\r\ntwo\n\n",
       "<s> <|endoftext|>", "<|endoftext|><|endoftext|> a", " <|endoftext|> \n b", "don't we'll 123 45,6",
       "a  b   c", "\x00\x1c\x85 \x1d \x85", "tab\tend ", "՘࢏ 1\U00010940's ՘", "a   b",
       "long " * 40_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return wordbpe.read_tokenizer(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    parts = ["a", "b ", "the", " ", "  ", "\n", "é", "ß", "1", "'s", "'", ".", "***", "漢", "👍", "\t",
             "ing", "<|endoftext|>", "՘", " "]
    mixed = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return ODD + mixed + pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()


def test_words_equal_the_library(vocabulary):
    own, words = pre_tokenizers.ByteLevel(add_prefix_space=False), wordbpe.Words(vocabulary)
    for point in [*range(0x3100), *range(0xA000, 0xD800), *range(0x10900, 0x10A00)]:
        c = chr(point)
        text = f"a{c}1{c}.{c} {c}{c}b"
        assert [len(w) for w, _ in own.pre_tokenize_str(text)] == [
            len(w.encode()) for w in words.find(text)], hex(point)


def test_merges_equal_the_library(vocabulary, library):
    rng, merge = random.Random(6), wordbpe.Merger(vocabulary)
    words = ["".join(rng.choice("abcdeinst") for _ in range(n)) for n in (*range(1, 60), 300)]
    for word in [*words, "a" * 999, "aab" * 300, "é" * 500, "=" * 1000, "-" * 31, "-" * 32]:
        assert merge(word.encode()) == library.encode(word, add_special_tokens=False).ids
    words += ["a" * n for n in range(64)] + ["aab" * 20, "ab" * 31, "漢字" * 10]
    assert merge.trained
    for word, ids in zip(words, merge.packed([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == merge(word.encode())
    odd = {(97, 98): (0, 300), (98, 98): (1, 301), (300, 98): (2, 302), (97, 301): (3, 302)}
    tokens = {b: bytes([b]) for b in range(256)}
    odd = wordbpe.Merger(wordbpe.Vocabulary(tokens, odd, {}, {}, ""))
    assert not odd.trained and odd.packed([b"abb", b""]) == [np.int32(302).tobytes(), b""]


def test_transducer_is_minimal_and_exact():
    rng = random.Random(2)
    words = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    entries = [(w, tuple(rng.randint(0, 3) for _ in range(rng.randint(0, 4)))) for w in words]
    for given in (entries, [(w, (len(w),)) for w in words], []):
        made = transducer.compile_words(given)
        inside = dict(given)
        asked = [*words, b"", b"abba" * 5, b"c", *(w + b"b" for w in words)]
        for word, ids in zip(asked, transducer.look_up(made, asked), strict=True):
            want = inside.get(word)
            assert (ids is None) == (want is None)
            assert want is None or tuple(np.frombuffer(ids, np.int32)) == want
    shared = transducer.compile_words([(p + b"ing", (1,)) for p in (b"go", b"sing", b"walk")])
    assert len(shared.finals) == 12  # 8 for the beginnings, one chain of 4 for the common end
    with pytest.raises(ValueError, match="order"):
        transducer.compile_words([(b"b", ()), (b"a", ())])


def frame(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


@pytest.mark.parametrize("size", [0, 200])
def test_equals_the_library_and_decodes(spark, texts, library, size, monkeypatch):
    docs = frame(spark, texts)
    lexicon = wordbpe.fitted(docs, PATH, lexicon=size)
    found = wordbpe.decode(wordbpe.encode(docs, lexicon), lexicon).collect()
    assert len(found) == len(texts)
    for r in found:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want, repr(texts[r.doc_id])[:80]
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    odd = spark.createDataFrame([([50256, 255, 128, 70_000, 64],), ([],), (None,)], "ids array<int>")
    assert [r.decoded for r in wordbpe.decode(odd, lexicon).collect()] == [
        library.decode([50256, 255, 128, 70_000, 64], skip_special_tokens=False), "", None]
    assert wordbpe.encode(docs.limit(0), lexicon).count() == 0
    assert wordbpe.word_counts(docs.limit(0), lexicon.vocabulary).count() == 0


def test_small_caches(vocabulary, library, texts, monkeypatch, tmp_path):
    monkeypatch.setattr(wordbpe, "CACHE_BYTES", 2000)
    monkeypatch.setattr(wordbpe, "SLICE_BYTES", 300)
    monkeypatch.setattr(wordbpe.SparkFiles, "get", lambda name: name)
    (tmp_path / "none").write_bytes(transducer.pack(transducer.compile_words([])))
    own = wordbpe.Codec(vocabulary, str(tmp_path / "none"))
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, np.int32).tolist() == want


def test_query(spark, library):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = set()
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        want.add((d["doc_id"], len(ids), sha(",".join(map(str, ids))),
                  sha(library.decode(ids, skip_special_tokens=False))))
    got = queries.op12_transducer_bpe(spark, SF)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(docs)


def test_lists_of_ids_are_decoded_together(vocabulary, library, monkeypatch, tmp_path):
    (tmp_path / "none").write_bytes(transducer.pack(transducer.compile_words([])))
    monkeypatch.setattr(wordbpe.SparkFiles, "get", lambda name: name)
    own = wordbpe.Codec(vocabulary, str(tmp_path / "none"))
    rows = [library.encode("two words", add_special_tokens=False).ids, None, [], [-1, 64, 1 << 30, 255], [128]]
    lists = pa.array([[0], *rows, [1]], pa.list_(pa.int32())).slice(1, len(rows))
    want = [None if x is None else library.decode(
        [i for i in x if 0 <= i < 50_257], skip_special_tokens=False) for x in rows]
    assert own.decode(lists) == want
