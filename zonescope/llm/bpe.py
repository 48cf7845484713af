"""Byte-level BPE encoding and decoding with recursive queries inside each task.

A task cuts its texts into pre-tokens with the tokenizer's pattern and encodes each distinct one once
in an in-process DuckDB: rows (word, position, token) join the merge table, a recursive query
contracts pairs until no word changes, and the rows in order are the ids. Decoding joins ids
with the vocabulary; the bytes in order, cut where rows end, are what comes out.

Each round contracts a word's leftmost pair of least rank, and with it all pairs whose contraction
can be shown to come anyway: (a, b) of rank r, when no token that can still arise to its left (they
all end in the byte before a) joins a under or at r, none to its right joins b under r, and the new
token joins none under r. Such contractions commute with all others, so the ids are those
of one contraction at a time, in fewer rounds. For long words the repeats of the least pair also go
in one round, every other one where they overlap.

Defined results. A null or empty text has no ids and decodes to nothing; null ids decode to null. An
id outside the vocabulary is an error. Texts are encoded whole; the caches are bounded and only save
work. Every row is on its own, so repeated rows, nulls in other columns and an empty table need no
rule; the result column replaces an input column of its name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonescope.llm.pieces import by_size, id_lists, spaces_meet

#: Entries of a cache, bytes of text encoded at a time, and bytes from which a word is long.
CACHE, GROUP_BYTES, LONG = 600_000, 4 << 20, 64
#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 512
#: Words go to one recursive query up to this many bytes, so its memory is bounded.
QUERY_BYTES = 1 << 19
DUCKDB = {"threads": 1, "memory_limit": "2GB", "temp_directory": ""}

ENCODE = """
WITH RECURSIVE s(k, t, f, l, done) AS (
  SELECT word * 2147483648 + place, token, byte, byte, false
  FROM (SELECT word, generate_subscripts(bytes, 1) AS place, unnest(bytes) AS byte FROM words)
  JOIN bytes USING (byte)
  UNION ALL (
  WITH pairs AS (
    SELECT k, t, f, l, k // 2147483648 AS w, lead(t) OVER o AS b, lead(l) OVER o AS last,
      lag(l) OVER o AS left_byte, lead(f, 2) OVER o AS right_byte,
      lag(k) OVER o // 2147483648 AS w0, lead(k) OVER o // 2147483648 AS w1,
      lead(k, 2) OVER o // 2147483648 AS w2
    FROM s WHERE NOT done WINDOW o AS (ORDER BY k)),
  ranked AS (
    SELECT p.k, p.t, p.f, p.l, p.w, p.last, m.rank, {calm} AS calm,
      coalesce({calm} AND m.rank < coalesce(x.least, 2147483647)
        AND m.rank <= coalesce(y.least, 2147483647), false) AS sure
    FROM pairs p LEFT JOIN merges m ON m.a = p.t AND m.b = p.b AND p.w = p.w1{around}
    LEFT JOIN from_left x ON x.byte = p.left_byte AND x.token = p.t AND p.w = p.w0
    LEFT JOIN from_right y ON y.token = p.b AND y.byte = p.right_byte AND p.w = p.w2),
  best AS (
    SELECT w, min(rank::BIGINT * 2147483648 + k % 2147483648) AS least
    FROM ranked WHERE rank IS NOT NULL GROUP BY w),
  chosen AS (
    SELECT r.*, least IS NULL AS done, coalesce(sure AND rank > least // 2147483648
      OR rank::BIGINT * 2147483648 + k % 2147483648 = least{repeats}, false) AS hit
    FROM {source} r LEFT JOIN best USING (w)),
  after AS (SELECT *, lag(hit) OVER (ORDER BY k) AS gone FROM chosen)
  SELECT k, CASE WHEN hit THEN rank ELSE t END, f, CASE WHEN hit THEN last ELSE l END, done
  FROM after WHERE gone IS NOT TRUE))
SELECT (k // 2147483648)::INT AS word, t AS id FROM s WHERE done ORDER BY k
"""
#: Whether the new token joins neither neighbour, whatever they become, under the pair's rank.
AROUND = """
    LEFT JOIN from_left u ON u.byte = p.left_byte AND u.token = m.rank AND p.w = p.w0
    LEFT JOIN from_right v ON v.token = m.rank AND v.byte = p.right_byte AND p.w = p.w2"""
CALM = "(coalesce(u.least, 2147483647) > m.rank AND coalesce(v.least, 2147483647) > m.rank)"
#: Every other one of the pairs of least rank that follow each other without a gap.
REPEATS = """(
    SELECT *, row_number() OVER (PARTITION BY w, rank, run ORDER BY k) % 2 = 1
      AND bool_and(calm) OVER (PARTITION BY w, rank) AS odd
    FROM (SELECT *, n - row_number() OVER (PARTITION BY w, rank ORDER BY k) AS run
      FROM (SELECT *, row_number() OVER (ORDER BY k) AS n FROM ranked)))"""
ENCODE_SHORT = ENCODE.format(calm="m.plain", around="", repeats="", source="ranked")
ENCODE_LONG = ENCODE.format(
    calm=CALM, around=AROUND, repeats=" OR odd AND rank = least // 2147483648", source=REPEATS)

DECODE = "SELECT place, bytes FROM ids JOIN vocabulary USING (token)"

MERGES = """
CREATE TABLE merges AS
  SELECT a, b, rank, coalesce(least > rank, true) AS plain
  FROM splits LEFT JOIN (
    SELECT token, min(rank) AS least
    FROM (SELECT a AS token, rank FROM splits UNION ALL SELECT b, rank FROM splits)
    GROUP BY token) ON token = rank;
CREATE TABLE from_left AS
  SELECT left_end AS byte, b AS token, min(rank) AS least FROM splits GROUP BY ALL;
CREATE TABLE from_right AS
  SELECT a AS token, right_start AS byte, min(rank) AS least FROM splits GROUP BY ALL;
CREATE TABLE bytes AS
  SELECT first AS byte, token FROM vocabulary WHERE size = 1;
"""


class Vocabulary(NamedTuple):
    """Tokens by rank and the pattern of the pre-tokens; a few megabytes, set by its file."""

    tokens: tuple[bytes, ...]
    pattern: str
    digest: str


def read_ranks(path: str, pattern: str) -> Vocabulary:
    """Read a rank file: base64 token and rank per line, all single bytes among them."""
    with open(path, "rb") as file:
        content = file.read()
    ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, content.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if len({t for t in ranks.values() if len(t) == 1}) != 256:
        raise ValueError("all single bytes must have a rank")
    digest = hashlib.sha256(content + pattern.encode()).hexdigest()
    return Vocabulary(tuple(ranks[r] for r in range(len(ranks))), pattern, digest)


class Cache(dict):
    """Bounded: when full, it goes back to the keys that were asked for again."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.again = most, set()

    def fresh(self, keys: set) -> set:
        """The keys that are not held; those held stay for what follows."""
        if len(self) > self.most:
            kept = {k: self[k] for k in self.again} if len(self.again) < self.most // 2 else {}
            kept |= {k: self[k] for k in keys & self.keys()}
            self.again = set()
            self.clear()
            self.update(kept)
        held = keys & self.keys()
        self.again |= held
        return keys - held


class Codec:
    """Encodes and decodes batches of one task with bounded caches."""

    def __init__(self, vocabulary: Vocabulary, cache: int = CACHE):
        self.tokens = vocabulary.tokens
        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.pattern = regex.compile(vocabulary.pattern)
        self.numerals = [str(i) for i in range(len(self.tokens))]
        self.words, self.after_space = Cache(cache), Cache(cache)
        self.db = duckdb.connect(":memory:", config=DUCKDB)
        splits = [(self.ranks[t[:i]], self.ranks[t[i:]], r, t[i - 1], t[i])
                  for t, r in self.ranks.items() for i in range(1, len(t))
                  if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, rank, left_end, right_start = zip(*splits, strict=True) if splits else [()] * 5
        self.table("splits", a=pa.array(a, pa.int32()), b=pa.array(b, pa.int32()),
                   rank=pa.array(rank, pa.int32()), left_end=pa.array(left_end, pa.uint8()),
                   right_start=pa.array(right_start, pa.uint8()))
        self.table("vocabulary", token=pa.array(range(len(self.tokens)), pa.int32()),
                   bytes=pa.array(self.tokens, pa.binary()),
                   first=pa.array([t[0] for t in self.tokens], pa.uint8()),
                   size=pa.array(map(len, self.tokens), pa.int32()))
        for statement in MERGES.split(";")[:-1]:
            self.db.execute(statement)

    def table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def contract(self, words: list[bytes], query: str) -> Iterator[bytes]:
        """The ids of each word, packed."""
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(w) for w in words])]), pa.int32()),
            pa.array(np.frombuffer(b"".join(words), np.uint8)))
        self.db.register("words", pa.table(
            {"word": pa.array(range(len(words)), pa.int64()), "bytes": lists}))
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("words")
        starts = np.searchsorted(found["word"].to_numpy(), np.arange(len(words) + 1)) * 4
        packed = found["id"].to_numpy().astype(np.int32, copy=False).tobytes()
        for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield packed[i:j]

    def learn(self, words: set[str]) -> None:
        """Put the ids of new pre-tokens in the cache; whole tokens need no query."""
        known, ranks, groups = self.words, self.ranks, {ENCODE_SHORT: [], ENCODE_LONG: []}
        for word in known.fresh(words):
            raw = word.encode("utf-8")
            if raw in ranks:
                known[word] = np.int32(ranks[raw]).tobytes()
            else:
                groups[ENCODE_SHORT if len(raw) < LONG else ENCODE_LONG].append((word, raw))
        for query, group in groups.items():
            for part in by_size(group, lambda pair: len(pair[1]), QUERY_BYTES):
                known.update(zip([word for word, _ in part],
                                 self.contract([raw for _, raw in part], query), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers in a row."""
        out = []
        for group in by_size(texts, lambda t: len(t or ""), GROUP_BYTES):
            out += self.encode_group(group)
        return out

    def encode_group(self, texts: list[str | None]) -> list[bytes]:
        find, cut = self.pattern.findall, []
        for text in texts:
            if not text or spaces_meet(text):
                cut.append((find(text or ""), []))
            else:
                head, *rest = text.split(" ")
                cut.append((find(head), rest))
        words, spaced = self.words, self.after_space
        parts = self.cut_parts(spaced.fresh({w for _, rest in cut for w in rest}))
        self.learn({w for head, _ in cut for w in head}.union(*parts.values()))
        spaced.update((w, b"".join([words[p] for p in found])) for w, found in parts.items())
        return [b"".join([*map(words.__getitem__, head), *map(spaced.__getitem__, rest)])
                for head, rest in cut]

    def cut_parts(self, parts: set[str]) -> dict[str, list[str]]:
        """The pre-tokens of parts that each follow a space: as one opens with that space, parts are cut
        together, but for those whose end would meet the space of the next."""
        find = self.pattern.findall
        joined = [p for p in parts if p and not p[-1].isspace()]
        out: dict[str, list[str]] = {}
        words = find(" " + " ".join(joined)) if joined else []
        starts = [i for i, w in enumerate(words) if w[:1] == " "]
        if len(starts) == len(joined) and starts[:1] == [0]:
            out = {p: words[i:j] for p, i, j in zip(
                joined, starts, [*starts[1:], len(words)], strict=True)}
        return out | {p: find(" " + p) for p in parts if p not in out}

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids."""
        out = []
        for group in by_size(rows, len, GROUP_BYTES):
            out += self.decode_group(group)
        return out

    def decode_group(self, rows: list[bytes]) -> list[bytes]:
        ids = np.frombuffer(b"".join(rows), np.int32)
        if not len(ids):
            return [b""] * len(rows)
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("an id is outside the vocabulary")
        self.db.register("ids", pa.table({"place": np.arange(len(ids)), "token": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("ids")
        place = found["place"].to_numpy()
        if (np.diff(place) < 0).any():
            found = found.take(np.argsort(place))
        pieces = pa.concat_arrays(found["bytes"].cast(pa.large_binary()).chunks)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:]
        data = memoryview(pieces.buffers()[2])
        cuts = ends[np.concatenate([[0], np.cumsum([len(row) // 4 for row in rows])])].tolist()
        return [data[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


#: The codec of a worker process, by the digest of its vocabulary and the size of its caches.
_codecs: dict[tuple[str, int], Codec] = {}


def codec(vocabulary: Broadcast, cache: int = CACHE) -> Codec:
    key = vocabulary.value.digest, cache
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary.value, cache)
    return _codecs[key]


def shared(spark: SparkSession, vocabulary: Vocabulary) -> Broadcast:
    return spark.sparkContext.broadcast(vocabulary)


def encode(docs: DataFrame, vocabulary: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """The documents with the ids of their texts."""
    def ids_of(texts: pa.Array) -> pa.Array:
        return id_lists(codec(vocabulary).encode(texts.to_pylist()))
    return docs.withColumn(ids, F.arrow_udf(ids_of, "array<int>")(F.col(text)))


def decode(rows: DataFrame, vocabulary: Broadcast, ids: str = "ids", to: str = "bytes") -> DataFrame:
    """The rows with the bytes of their ids."""
    def bytes_of(lists: pa.Array) -> pa.Array:
        packed = [None if x is None else np.array(x, np.int32).tobytes() for x in lists.to_pylist()]
        found = iter(codec(vocabulary).decode([x for x in packed if x is not None]))
        return pa.array([None if x is None else next(found) for x in packed], pa.binary())
    return rows.withColumn(to, F.arrow_udf(bytes_of, "binary")(F.col(ids)))


def round_trip(
    docs: DataFrame, vocabulary: Broadcast, text: str = "text", to: str = "digest",
    with_ids: bool = False, cache: int = CACHE,
) -> DataFrame:
    """The documents with a struct of the number of ids and digests of ids and decoded bytes.

    Encodes and decodes in one pass, a slice of a batch at a time; the ids themselves leave the task
    only if asked for. ``cache`` bounds the entries of each cache of a worker, about 200 bytes each.
    """
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]

    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(vocabulary, cache)
        for texts in batches:
            for at in range(0, max(1, len(texts)), SLICE):
                yield digest(own, texts.slice(at, SLICE).to_pylist())

    def digest(own: Codec, texts: list[str | None]) -> pa.Array:
        rows, out = own.encode(texts), []
        for row, raw in zip(rows, own.decode(rows), strict=True):
            ids = np.frombuffer(row, np.int32).tolist()
            listed = ",".join([own.numerals[i] for i in ids])
            out.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                        hashlib.sha256(raw).hexdigest()))
        columns = [pa.array([row[i] for row in out], kind) for i, (_, kind) in enumerate(fields)]
        names = [name for name, _ in fields]
        if with_ids:
            columns, names = [*columns, id_lists(rows)], [*names, "ids"]
        return pa.StructArray.from_arrays(columns, names=names)
    kind = "n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + (
        ", ids: array<int>" if with_ids else "")
    return docs.withColumn(to, F.arrow_udf(digests, f"struct<{kind}>")(F.col(text)))
