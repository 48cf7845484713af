"""BPE encoding and decoding with a lexicon of frequent words as a minimal acyclic transducer.

The words (pre-tokens) of the whole corpus are counted; the most frequent are merged once, on the
driver, and compiled into a transducer, one file in the shared folder that every worker memory-maps.
A task looks the distinct words of a slice of texts up in it, all at once, and merges the others
itself, exactly. The lexicon saves work and changes no result: its size is ``lexicon`` words,
whatever the corpus.

The vocabulary is a file of the tokenizers library (byte-level BPE without a normalizer). Which
characters are letters, numbers, space or neither is read off that library's own pre-tokenizer, as
its Unicode tables may be older or newer than those of other packages. Special tokens in a text
become their ids, as there.

Defined results. A null or empty text has no ids; null ids decode to null, no ids to the empty text.
Ids outside the vocabulary are skipped, and bytes that are no UTF-8 decode to U+FFFD, as in the
library. Texts are encoded whole; words of any length are merged whole; caches are bounded in bytes
and only save work. Every row is on its own, so repeated rows, nulls in other columns and an empty
table need no rule; the result column replaces an input column of its name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast, SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope.llm.pieces import by_size, id_lists, spaces_meet
from zonescope.llm.transducer import compile_words, look_up, mapped, pack
from zonescope.plans.workspace import new_folder

#: Words of the lexicon.
LEXICON = 1 << 17
#: Bytes of words and ids that a worker remembers, counted with what Python needs for each, the bytes
#: from which a word is not remembered, and the bytes of distinct words before counts are sent on.
CACHE_BYTES, LONG_WORD, COUNT_BYTES, ENTRY = 64 << 20, 512, 32 << 20, 250
#: Texts and bytes of text that are Python objects at a time.
SLICE, SLICE_BYTES = 512, 4 << 20
#: The pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The classes in it, each under a character that can stand for all of its class.
CLASSES = {"\u00aa": r"\p{L}", "1": r"\p{N}", ".": r"[^\s\p{L}\p{N}]", "\t": r"\s"}


class Vocabulary(NamedTuple):
    """Tokens by id, merges (left, right) -> (rank, id), special tokens and characters to be
    classed as others; a few megabytes, set by the file."""

    tokens: dict[int, bytes]
    merges: dict[tuple[int, int], tuple[int, int]]
    special: dict[str, int]
    stand_ins: dict[int, str]
    digest: str


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in byte-level files: printable ones for themselves, the
    others in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def stand_ins() -> dict[int, str]:
    """Characters whose class in the library differs from that of the pattern here, each with one of
    the class it has there.

    Characters of one class here are one string; the library cuts it where its own class changes.
    """
    from tokenizers import pre_tokenizers  # on the driver only

    own = pre_tokenizers.ByteLevel(add_prefix_space=False)
    joins = lambda text: len(own.pre_tokenize_str(text)) == 1
    every = "".join(chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000 and p != 0x20)
    out = {}
    for here, usual in CLASSES.items():
        some = "".join(regex.findall(usual, every))
        for _, (start, end) in own.pre_tokenize_str(some):
            there = next((sign for sign in list(CLASSES)[:3] if joins(sign + some[start])), "\t")
            if there != here:
                out |= {ord(c): there for c in some[start:end]}
    return out


def read_tokenizer(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library."""
    with open(path, "rb") as file:
        content = file.read()
    whole = json.loads(content)
    model, before = whole["model"], whole["pre_tokenizer"] or {}
    usual = (whole["normalizer"] is None and before.get("type") == "ByteLevel"
             and before.get("use_regex", True) and not before.get("add_prefix_space")
             and model.get("type") == "BPE" and not model.get("ignore_merges"))
    if not usual:
        raise ValueError("only byte-level BPE without a normalizer or a prefix space is read")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in whole["added_tokens"]):
        raise ValueError("special tokens must stand for themselves alone")
    signs, ids = byte_signs(), model["vocab"]
    tokens = {i: bytes(signs[c] for c in t) for t, i in ids.items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    tokens |= {i: t.encode() for t, i in special.items()}
    return Vocabulary(tokens, merges, special, stand_ins(), hashlib.sha256(content).hexdigest())


class Merger:
    """Merges words: always the leftmost pair of least rank, until none is left.

    Where every merge makes a token of its own that only later merges use, as training gives them, a
    pair's merge can make no pair of lower rank; then all places of a word's least pair go at once, and
    many words in step.
    """

    def __init__(self, vocabulary: Vocabulary):
        single = {t: i for i, t in vocabulary.tokens.items() if len(t) == 1}
        self.merges, self.of_byte = vocabulary.merges, [single[bytes([b])] for b in range(256)]
        made = {new: rank for rank, new in self.merges.values()}
        self.trained = len(made) == len(self.merges) and all(
            made.get(t, -1) < rank for pair, (rank, _) in self.merges.items() for t in pair)
        bits = max([1, *(t for pair in self.merges for t in pair)]).bit_length()
        keys = np.array([(a << bits) | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.bits, self.keys = bits, keys[order]
        found = np.array(list(self.merges.values()), np.int64).reshape(-1, 2)[order]
        self.ranks, self.made = found[:, 0], np.zeros(len(found) + 1, np.int64)
        if self.trained:
            self.ranks = np.unique(self.ranks, return_inverse=True)[1]
            self.made[self.ranks] = found[:, 1]

    def __call__(self, word: bytes) -> list[int]:
        ids = [self.of_byte[b] for b in word]
        return self.short(ids) if len(ids) < 32 else self.long(ids)

    def packed(self, words: list[bytes]) -> list[bytes]:
        """The ids of many words as packed 32-bit integers."""
        if not self.trained or not len(self.keys):
            return [np.array(self(w), np.int32).tobytes() for w in words]
        out: list[bytes] = [b""] * len(words)
        for i, word in enumerate(words):
            if len(word) >= 64:
                out[i] = np.array(self.long([self.of_byte[b] for b in word]), np.int32).tobytes()
        short = [i for i, word in enumerate(words) if 0 < len(word) < 64]
        for i, ids in zip(short, self.in_step([words[i] for i in short]), strict=True):
            out[i] = ids
        return out

    def in_step(self, words: list[bytes]) -> list[bytes]:
        none = len(self.keys)
        ids = np.array(self.of_byte)[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_ids, done_of = [], []
        while len(ids):
            pairs = (ids[:-1] << self.bits) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
            known = (self.keys[at] == pairs) & (of[:-1] == of[1:])
            rank = np.append(np.where(known, self.ranks[at], none), none)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff([*first, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == none
            done_ids.append(ids[over])
            done_of.append(of[over])
            hits = np.flatnonzero((rank == least) & ~over)
            # Where places follow each other, as in a run of one token, every other one goes.
            order = np.arange(len(hits))
            run = np.maximum.accumulate(np.where(np.diff(hits, prepend=-2) > 1, order, 0))
            hits = hits[(order - run) % 2 == 0]
            ids[hits] = self.made[rank[hits]]
            left = ~over
            left[hits + 1] = False
            ids, of = ids[left], of[left]
        ids, of = np.concatenate([*done_ids, ids]), np.concatenate([*done_of, of])
        ids = ids[np.argsort(of, kind="stable")].astype(np.int32).tobytes()
        ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))]) * 4
        return [ids[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def short(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 40, -1)
        while len(ids) > 1:
            found = [merges.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
            least = min(found)
            if least is none:
                break
            at = found.index(least)
            ids[at:at + 2] = [least[1]]
        return ids

    def long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and links between tokens that are left."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*merges[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:], strict=False))
                if pair in merges]
        heap = [(rank, i, new, pair) for rank, new, i, pair in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (ids[left], ids[right]) in merges:
                    found = ids[left], ids[right]
                    rank, made = merges[found]
                    heapq.heappush(heap, (rank, left, made, found))
        return [i for i in ids if i >= 0]


class Words:
    """Cuts texts: a text's parts at its single spaces, or its words where spaces meet."""

    def __init__(self, vocabulary: Vocabulary):
        self.pattern, self.stand_ins = regex.compile(PATTERN), vocabulary.stand_ins
        self.odd = frozenset(map(chr, self.stand_ins))
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None

    def after_spaces(self, parts: Iterable[str]) -> dict[str, list[str]]:
        """The words of parts that each follow a space: a word with a space in front opens a part, so
        all are cut in one go; plain searches tell for many."""
        out, rest = {}, []
        for part in parts:
            if part.isascii() and part.isalpha():
                out[part] = [" " + part]
            elif part:
                rest.append(part)
            else:
                out[part] = [" "]
        words = iter(self.find(" " + " ".join(rest)) if rest else ())
        last = next(words, None)
        for part in rest:
            out[part] = found = [last]
            for last in words:
                if last[0] == " ":
                    break
                found.append(last)
        return out

    def find(self, text: str) -> list[str]:
        """The words of a text by the pre-tokenizer's pattern."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pattern.findall(text)
        spans = self.pattern.finditer(text.translate(self.stand_ins))
        return [text[m.start():m.end()] for m in spans]

    def stretches(self, text: str) -> Iterator[tuple[str, str]]:
        """(text, special token after it or "")."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at:m.start()], m.group()
            at = m.end()
        yield text[at:], ""

    def cut(self, text: str) -> tuple[list[str], list[str]]:
        """Words, and parts that each follow a space: where a space has no other white space beside
        it, a word starts at it."""
        if not text:
            return [], []
        if spaces_meet(text):
            return self.find(text), []
        head, *rest = text.split(" ")
        return self.find(head), rest


def bounded(texts: list[str | None]) -> Iterator[list[str | None]]:
    yield from by_size(texts, lambda t: len(t or ""), SLICE_BYTES)


def sliced(column: pa.Array) -> Iterator[list[str | None]]:
    """A batch's texts, a bounded part at a time; at least one part, if empty."""
    for at in range(0, max(1, len(column)), SLICE):
        yield column.slice(at, SLICE).to_pylist()


def word_counts(docs: DataFrame, vocabulary: Broadcast, text: str = "text") -> DataFrame:
    """(word, n) over all texts. What a task meets only once between two spaces is not counted
    there: it is not frequent, and no result depends on it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(vocabulary.value)
        words, parts, size = Counter(), Counter(), 0

        def flushed() -> pa.RecordBatch:
            often = [part for part, n in parts.items() if n > 1]
            for part, found in own.after_spaces(often).items():
                for word in found:
                    words[word] += parts[part]
            many = [(w, n) for w, n in words.items() if n > 1 and len(w) < LONG_WORD]
            words.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in many], pa.string()),
                 pa.array([n for _, n in many], pa.int64())], names=["word", "n"])

        for batch in batches:
            for texts in sliced(batch.column(0)):
                before = len(parts) + len(words)
                for t in texts:
                    for stretch, _ in own.stretches(t or ""):
                        head, rest = own.cut(stretch)
                        words.update(head)
                        parts.update(rest)
                        size += len(stretch) if len(rest) < 2 else 0
                size += ENTRY * (len(parts) + len(words) - before)
                if size > COUNT_BYTES:
                    yield flushed()
                    size = 0
        yield flushed()
    return docs.select(F.col(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n"))


class Lexicon(NamedTuple):
    """A vocabulary, and the name under which workers find the file of the transducer."""

    vocabulary: Broadcast
    file: str


def share_file(spark: SparkSession, content: bytes, name: str) -> str:
    """Write a file in the shared folder and have every executor fetch it; its name there."""
    jvm, name = spark._jvm, f"{name}-{uuid.uuid4().hex}"
    path = jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'files')}/{name}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(path).toString())
    return name


def fitted(
    docs: DataFrame, path: str, text: str = "text", lexicon: int = LEXICON,
) -> Lexicon:
    """The vocabulary of a file with a lexicon of the most frequent words of the documents."""
    spark = docs.sparkSession
    vocabulary = read_tokenizer(path)
    shared = spark.sparkContext.broadcast(vocabulary)
    top = word_counts(docs, shared, text).orderBy(F.desc("n"), "word").limit(lexicon)
    merge = Merger(vocabulary)
    words = sorted(r.word.encode() for r in top.select("word").collect())
    ids = (tuple(np.frombuffer(ids, np.int32).tolist()) for ids in merge.packed(words))
    content = pack(compile_words(zip(words, ids, strict=True)))
    return Lexicon(shared, share_file(spark, content, "lexicon"))


class Recent:
    """What was asked for lately: two generations, the older of which is dropped when the newer has
    its share of the bytes."""

    def __init__(self, most: int):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size, self.most = 0, most // 2

    def among(self, keys: set[str]) -> dict[str, bytes]:
        """The keys that are held; those of the older generation become new."""
        found = {k: ids for k in keys if (ids := self.new.get(k)) is not None}
        if self.old:
            for k in keys:
                if k not in found and (ids := self.old.get(k)) is not None:
                    found[k] = ids
                    self.keep(k, ids)
        return found

    def keep(self, key: str, ids: bytes) -> None:
        self.new[key] = ids
        self.size += ENTRY + len(key) + len(ids)

    def turn(self) -> None:
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, 0


class Codec:
    """Encodes and decodes in a worker."""

    def __init__(self, vocabulary: Vocabulary, file: str):
        self.cut, self.merge = Words(vocabulary), Merger(vocabulary)
        self.special, self.tokens = vocabulary.special, vocabulary.tokens
        # By id, with nothing for ids that there are not.
        self.bytes_of = pa.array([self.tokens.get(i, b"") for i in range(max(self.tokens) + 2)],
                                 pa.large_binary())
        self.lexicon = mapped(SparkFiles.get(file))
        self.words, self.parts = Recent(CACHE_BYTES // 2), Recent(CACHE_BYTES // 2)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words: from the cache, the lexicon, or merged."""
        found = self.words.among(words)
        fresh = [w for w in words if w not in found]
        for word, ids in zip(fresh, self.ids_of(fresh), strict=True):
            found[word] = ids
            if len(word) < LONG_WORD:
                self.words.keep(word, ids)
        return found

    def ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of words, from the lexicon or merged."""
        raw = [w.encode() for w in words]
        known = look_up(self.lexicon, raw)
        unseen = iter(self.merge.packed([w for w, ids in zip(raw, known, strict=True) if ids is None]))
        return [next(unseen) if ids is None else ids for ids in known]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        out = []
        for some in bounded(texts):
            self.words.turn()
            self.parts.turn()
            cut = [[(*self.cut.cut(s), after) for s, after in self.cut.stretches(t)] if t else []
                   for t in some]
            parts = set().union(*(rest for row in cut for _, rest, _ in row))
            spaced = self.parts.among(parts)
            fresh = self.cut.after_spaces(parts - spaced.keys())
            # Parts of one word, the most, are remembered as parts alone.
            ones = [part for part, found in fresh.items() if len(found) == 1]
            made = dict(zip(ones, self.ids_of([fresh.pop(part)[0] for part in ones]), strict=True))
            words = self.learn({w for row in cut for head, _, _ in row for w in head}.union(
                *fresh.values()))
            made.update((part, b"".join([words[w] for w in found])) for part, found in fresh.items())
            spaced.update(made)
            for part, ids in made.items():
                if len(part) < LONG_WORD:
                    self.parts.keep(part, ids)
            for row in cut:
                pieces = []
                for head, rest, after in row:
                    pieces += map(words.__getitem__, head)
                    pieces += map(spaced.__getitem__, rest)
                    if after:
                        pieces.append(np.int32(self.special[after]).tobytes())
                out.append(b"".join(pieces))
        return out

    def decode(self, rows: pa.Array) -> list[str | None]:
        """The text of each list of ids; None for a null list."""
        none = len(self.bytes_of) - 1
        ids = rows.flatten().fill_null(none).to_numpy(zero_copy_only=False)
        ids = np.where((ids < 0) | (ids > none), none, ids)
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        pieces = self.bytes_of.take(pa.array(ids))
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:][cuts].tolist()
        data = memoryview(pieces.buffers()[2] or b"")
        known = rows.is_valid().to_pylist()
        return [str(data[i:j], "utf-8", "replace") if good else None
                for i, j, good in zip(ends[:-1], ends[1:], known, strict=True)]


#: The codec of a worker process, by vocabulary and file.
_codecs: dict[tuple[str, str], Codec] = {}


def codec(lexicon: Lexicon) -> Codec:
    key = lexicon.vocabulary.value.digest, lexicon.file
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(lexicon.vocabulary.value, lexicon.file)
    return _codecs[key]


def encode(docs: DataFrame, lexicon: Lexicon, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with the ids of their texts."""
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(lexicon)
        for batch in batches:
            for texts in sliced(batch):
                yield id_lists(own.encode(texts))
    return docs.withColumn(ids, F.arrow_udf(ids_of, "array<int>")(F.col(text)))


def decode(rows: DataFrame, lexicon: Lexicon, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """The rows with the texts of their ids."""
    def texts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(lexicon)
        for batch in batches:
            for at in range(0, max(1, len(batch)), SLICE):
                yield pa.array(own.decode(batch.slice(at, SLICE)), pa.string())
    return rows.withColumn(to, F.arrow_udf(texts_of, "string")(F.col(ids)))
