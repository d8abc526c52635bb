"""Removal of repeated passages with FM-indexes.

Which windows of WINDOW words occur twice is decided by FM-indexes, one per shard, over word symbols. So that a document
need not visit every shard, windows are routed by content: runs of GRAM words are hashed, those with a small hash (and the
smallest one of a window that has none) are counted over the corpus, and a window can occur twice only if all its small
grams do. Windows that pass go, in stretches with their smallest gram, to the shard of that gram, where equal windows meet.
Windows of very frequent grams are dealt out by their first and last gram too, so that a passage that a third of all
documents quote does not crowd one shard with what stands around it. Equal stretches are counted before they are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, stored
from tremora.llm.fm_index import FMIndex, repeated_windows

WINDOW = 35
GRAM = 8
SPAN = WINDOW - GRAM + 1
SMALL = np.uint64(2**64 // 12)
HOT = 20_000
SHARD_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(hashes: np.ndarray) -> np.ndarray:
    """A mixed hash of each run of GRAM words."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def smallest(g: np.ndarray, span: int) -> np.ndarray:
    """Place of each window's smallest gram, the first one of equals."""
    if len(g) < span:
        return np.zeros(0, dtype=np.int64)
    return np.lib.stride_tricks.sliding_window_view(g, span).argmin(axis=1) + np.arange(len(g) - span + 1)


def selected(g: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Grams to be counted: the small ones, and the smallest of each window without a small one."""
    least = smallest(g, span)
    if not len(least):
        return g[:0]
    lone = np.unique(least[g[least] >= SMALL])
    return np.concatenate((g[g < SMALL], g[lone]))


def stretches(hashes: np.ndarray, known: np.ndarray, hot: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(first word, number of windows, route) of windows that may occur twice; known: the counted grams that do, sorted."""
    g, span = grams(hashes), window - GRAM + 1
    least = smallest(g, span)
    if not len(least) or not len(known):
        return
    place = np.minimum(np.searchsorted(known, g), len(known) - 1)
    twice = known[place] == g
    lost = np.concatenate(([0], np.cumsum((g < SMALL) & ~twice)))
    at = np.flatnonzero(twice[least] & (lost[span:] == lost[: len(lost) - span]))
    if not len(at):
        return
    frequent = hot[place[least[at]]]
    breaks = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]))) | frequent
    first = np.flatnonzero(breaks)
    sizes = np.diff(np.concatenate((first, [len(at)])))
    for k, n in zip(first.tolist(), sizes.tolist()):
        s = int(at[k])
        route = int(g[least[s]])
        if frequent[k]:
            route ^= (int(g[s]) * 3 ^ int(g[s + span - 1]) * 5) % 2**64
        yield s, n, route - (route >> 63 << 64)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows named by two hashes of their text: equal texts are cut once and count as often as they occur."""
    return identified(docs).select(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"), "doc_id", "text")


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("whole", pa.string()), ("grams", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in stream:
            sizes, digests, found = [], [], []
            for text in batch.column(3):
                words = (text.as_py() or b"").split()
                sizes.append(len(words))
                digests.append(_digest(words))
                found.append(selected(grams(known.of(words)), window - GRAM + 1).view(np.int64) if len(words) >= window else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(digests), pa.array(found, schema.field(5).type)], schema=schema)

    return run


def _cut(window: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("first", pa.int32()), ("route", pa.int64()), ("name", pa.binary()), ("words", pa.binary())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in stream:
            for k1, k2, text, twice, n in zip(*(batch.column(k) for k in range(5))):
                pairs = sorted((r["gram"] % 2**64, r["hot"]) for r in twice.as_py())
                hashes = known.of((text.as_py() or b"").split())
                symbols = (hashes >> np.uint64(32)).astype("<u4").tobytes()
                first, routes, words = [], [], []
                for s, m, route in stretches(hashes, np.array([p[0] for p in pairs], dtype=np.uint64), np.array([p[1] for p in pairs], dtype=bool), window):
                    first.append(s)
                    routes.append(route)
                    words.append(symbols[4 * s : 4 * (s + m + window - 1)])
                same = [[x.as_py()] * len(first) for x in (k1, k2, n)]
                if first:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((*same, first, routes, map(xxhash.xxh3_128_digest, words), words), schema)], schema=schema)

    return run


def _index_shard(window: int):
    """One FM-index over all stretches of a partition; a row (name, repeated window starts) for each."""
    schema = pa.schema([("route", pa.int64()), ("name", pa.binary()), ("starts", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes, names, weights, texts = [], [], [], []
        for batch in stream:
            for held, column in zip((routes, names, weights, texts), batch.columns):
                held += column.to_pylist()
        if not names:
            return
        parts = [np.frombuffer(t, "<u4") for t in texts]
        alphabet, symbols = np.unique(np.concatenate(parts), return_inverse=True)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        starts = np.cumsum(np.concatenate(([0], lengths[:-1])))
        # symbol 0 ends each stretch, so no window crosses from one to the next
        indexed = np.zeros(len(symbols) + len(parts), dtype=np.int64)
        indexed[np.arange(len(symbols)) + np.repeat(np.arange(len(parts)), lengths)] = symbols + 1
        marks = repeated_windows(FMIndex(indexed, len(alphabet) + 1), symbols + 1, starts, lengths, np.array(weights), window)
        found = [np.flatnonzero(marks[a : a + n]).astype(np.int32) for a, n in zip(starts.tolist(), lengths.tolist())]
        for a in range(0, len(names), 4096):
            b = slice(a, a + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(routes[b], pa.int64()), pa.array(names[b], pa.binary()), pa.array(found[b], schema.field(2).type)], schema=schema)

    return run


def _without(window: int):
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("removed", pa.int64()), ("kept", pa.string())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            counts, digests = [], []
            for text, spots in zip(batch.column(2), batch.column(3)):
                words = (text.as_py() or b"").split()
                kept = words_left(words, [r["first"] + s for r in spots.as_py() for s in r["starts"]], window)
                counts.append(len(words) - len(kept))
                digests.append(_digest(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], schema=schema)

    return run


def words_left(words: list[bytes], starts: list[int], window: int = WINDOW) -> list[bytes]:
    """Words that no window starting at one of `starts` covers."""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.array(starts, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return [w for w, covered in zip(words, np.cumsum(edge[:-1])) if not covered]


def without_repeats(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of `docs`.

    Words covered by a window that also starts anywhere else, in the same text or another, are removed. Null texts have no words;
    equal rows count as two texts. Texts are named by 128-bit hashes. `hot` and `shard_words` change where work is done, never the result.
    """
    scan = stored(_keyed(docs).mapInArrow(_scan(window), "k1 long, k2 long, doc_id long, n_words long, whole string, grams array<bigint>"), "substring-scan")
    twice = scan.select(F.explode("grams").alias("gram")).groupBy("gram").count().filter("count > 1").select("gram", (F.col("count") > hot).alias("hot"))
    own = scan.groupBy("k1", "k2").agg(F.first("grams").alias("grams")).select("k1", "k2", F.explode(F.array_distinct("grams")).alias("gram")).join(twice, "gram")
    lists = own.groupBy("k1", "k2").agg(F.collect_set(F.struct("gram", "hot")).alias("twice"))
    # copies are counted where they are read, so a text that a third of all rows share is moved once per task
    counted = _keyed(docs).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    texts = stored(counted.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "twice", "n"), "substring-texts")
    cut = stored(texts.mapInArrow(_cut(window), "k1 long, k2 long, n long, first int, route long, name binary, words binary"), "substring-cut")
    distinct = stored(cut.groupBy("route", "name").agg(F.sum("n").alias("weight"), F.first("words").alias("words")), "substring-stretches")
    words = distinct.agg(F.sum(F.length("words") / 4)).first()[0] or 0
    shards = distinct.select("route", "name", "weight", "words").repartition(max(1, int(words // shard_words) + 1), "route")
    found = stored(shards.mapInArrow(_index_shard(window), "route long, name binary, starts array<int>").filter(F.size("starts") > 0), "substring-found")
    spots = cut.select("k1", "k2", "first", "route", "name").join(found, ["route", "name"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "starts")).alias("spots"))
    removed = texts.select("k1", "k2", "text").join(spots, ["k1", "k2"]).mapInArrow(_without(window), "k1 long, k2 long, removed long, kept string")
    every = scan.drop("grams").join(removed, ["k1", "k2"], "left")
    return every.select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))
