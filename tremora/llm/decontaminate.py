"""Benchmark decontamination: passages of documents query a BM25 index of test items with block-max WAND.

The index holds units of at most PASSAGE // 2 words (longer items are cut), so that every unit that occurs in a document lies
whole in one of its passages (PASSAGE words, half overlapping). A unit's score is BM25 divided by the score of the unit
against itself: 1 means that the passage has all its words. All units that reach the threshold are retrieved; those whose
item then shares enough five-word shingles of question and answer with the text around the passage are leaks.

The index is built from the benchmark in shards of a bounded number of items and travels with the tasks; the documents are read
once per shard and never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, small_batches, stored

PASSAGE = 128
HALF = PASSAGE // 2
SHINGLE = 5
K1, B = 1.2, 0.75
BLOCK = 4
ANSWERED = 0.5  # share of the answer's shingles that a leak of question and answer has
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_DROPPED = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SENTENCE = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+")


def normal_words(text: bytes | None) -> list[bytes]:
    """Words without ASCII punctuation, A-Z lower-cased; words of punctuation alone vanish."""
    return text.translate(_LOWER, _DROPPED).split() if text else []


def shingles(words: list[bytes]) -> set[bytes]:
    """Distinct runs of five words; shorter texts count as one run."""
    return {b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))} if words else set()


@dataclass
class Item:
    item_id: int
    words: list[bytes]
    question: set[bytes]
    answer: set[bytes]


def parse_item(item_id: int, text: bytes | None) -> Item:
    """The last sentence is the answer and what precedes it the question; a question of under five words takes the whole item."""
    sentences = [s for s in _SENTENCE.split(text or b"") if normal_words(s)]
    asked = [w for s in sentences[:-1] for w in normal_words(s)]
    words = normal_words(text)
    if len(asked) < SHINGLE:
        return Item(item_id, words, shingles(words), set())
    return Item(item_id, words, shingles(asked), shingles(normal_words(sentences[-1])))


def units_of(words: list[bytes]) -> list[list[bytes]]:
    """Stretches of at most HALF words; a rest too short for a shingle counts only if it is all of the item."""
    cut = [words[a : a + HALF] for a in range(0, len(words), HALF)]
    return [u for u in cut if len(u) >= SHINGLE or len(words) <= HALF]


@dataclass
class Statistics:
    """Of all units of the benchmark, whatever the shard: their number, mean length, and how many hold each term."""

    n: int
    mean: float
    frequency: dict[bytes, int]

    @classmethod
    def of(cls, units: list[list[bytes]]) -> Statistics:
        return cls(len(units), sum(map(len, units)) / max(1, len(units)), Counter(t for u in units for t in set(u)))


class Index:
    """Postings by term in unit order, with the largest weight of each list and of each block of BLOCK units."""

    def __init__(self, items: list[Item], threshold: float, statistics: Statistics | None = None):
        self.items, self.threshold, self.shards = items, threshold, 1
        units = [(k, u) for k, it in enumerate(items) for u in units_of(it.words)]
        self.unit_item = [k for k, _ in units]
        stats = statistics or Statistics.of([u for _, u in units])
        n, mean, frequency = stats.n, stats.mean, stats.frequency
        self.term = {t: k for k, t in enumerate(sorted({t for _, u in units for t in u}))}
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for j, (_, u) in enumerate(units):
            weight = {t: math.log(1 + (n - frequency[t] + 0.5) / (frequency[t] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(u) / mean)) for t, tf in Counter(u).items()}
            own = sum(weight.values())
            for t, w in weight.items():
                self.postings[self.term[t]].append((j, w / own))
        self.most = np.array([max(w for _, w in p) for p in self.postings], dtype=np.float32)
        self.blocks: list[dict[int, float]] = []
        for p in self.postings:
            by: dict[int, float] = defaultdict(float)
            for j, w in p:
                by[j // BLOCK] = max(by[j // BLOCK], w)
            self.blocks.append(dict(by))
        self.n_blocks = len(units) // BLOCK + 1
        lengths = np.array([len(b) for b in self.blocks], dtype=np.int64)
        self.from_ = np.concatenate(([0], np.cumsum(lengths)))
        self.block_no = np.array([b for x in self.blocks for b in x], dtype=np.int64)
        self.block_most = np.array([w for x in self.blocks for w in x.values()], dtype=np.float32)
        # lists that reach over a quarter of all blocks are kept as rows of a matrix (at most four times their entries)
        self.common = np.flatnonzero(lengths * 4 > self.n_blocks)
        self.common_at = np.full(len(self.term), -1, dtype=np.int64)
        self.common_at[self.common] = np.arange(len(self.common))
        self.common_most = np.zeros((len(self.common), self.n_blocks), dtype=np.float32)
        for k, t in enumerate(self.common):
            self.common_most[k, list(self.blocks[t])] = list(self.blocks[t].values())

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """(unit, score) of all units at or above the threshold, by block-max WAND over the lists of distinct `terms`."""
        lists = [[0, self.postings[t], float(self.most[t]), self.blocks[t]] for t in terms]
        out, limit = [], self.threshold - 1e-6
        while lists:
            lists.sort(key=lambda c: c[1][c[0]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c[2]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                return out
            unit = lists[pivot][1][lists[pivot][0]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][1][lists[pivot + 1][0]][0] == unit:
                pivot += 1
            block = unit // BLOCK
            if sum(c[3].get(block, 0.0) for c in lists[: pivot + 1]) < limit:
                # no unit of this block before the next list's first one can do
                to = (block + 1) * BLOCK
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][1][lists[pivot + 1][0]][0])
            elif lists[0][1][lists[0][0]][0] == unit:
                score = sum(c[1][c[0]][1] for c in lists[: pivot + 1])
                if score >= limit:
                    out.append((unit, score))
                to = unit + 1
            else:
                to = unit
            for c in lists[: pivot + 1]:
                while c[0] < len(c[1]) and c[1][c[0]][0] < to:
                    c[0] += 1
            lists = [c for c in lists if c[0] < len(c[1])]
        return out

    def promising(self, ids: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
        """Passages (of n) in which some block can reach the threshold, for all passages at once.

        ids and passage: known words and the passage they stand in. The overall maxima of the lists rule out most passages, their
        block maxima most of the others.
        """
        at = self.common_at[ids]
        seen = np.zeros((n, len(self.common)), dtype=bool)
        frequent = at >= 0
        seen[passage[frequent], at[frequent]] = True
        base = seen @ self.most[self.common]
        ids, passage = ids[~frequent], passage[~frequent]
        total = base + np.bincount(passage, weights=self.most[ids], minlength=n)
        left = total >= self.threshold - 1e-4
        on = left[passage]
        ids, passage = ids[on], passage[on]
        number = np.cumsum(left) - 1
        counts = self.from_[ids + 1] - self.from_[ids]
        entry = np.repeat(self.from_[ids] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        cell = np.repeat(number[passage], counts) * self.n_blocks + self.block_no[entry]
        by_block = np.bincount(cell, weights=self.block_most[entry], minlength=int(left.sum()) * self.n_blocks).reshape(-1, self.n_blocks)
        kept = np.flatnonzero(left)
        return kept[(by_block + seen[kept] @ self.common_most).max(axis=1, initial=0) >= self.threshold - 1e-4]


def passages(n_words: int) -> int:
    """Passages of a text: number k covers words from k * HALF to k * HALF + PASSAGE."""
    return max(1, -(-n_words // HALF) - 1)


def overlaps(item: Item, words: list[bytes]) -> tuple[float, float, float]:
    """Shares of the question's, the answer's and all shingles of an item found among `words` (no answer: 1)."""

    def share(wanted: set[bytes]) -> float:
        if not wanted:
            return 1.0
        n = min(SHINGLE, min(x.count(b" ") for x in wanted) + 1)
        return len(wanted & {b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}) / len(wanted)

    return share(item.question), share(item.answer), share(shingles(item.words))


def verified(asked: float, answered: float, whole: float, overlap: float) -> bool:
    """Question and answer are both there: most shingles of the question and half of the answer's, or most of the whole item."""
    return whole >= overlap or (asked >= overlap and answered >= ANSWERED)


def leaks(index: Index, texts: list[bytes | None], overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item id, best score, question overlap, answer overlap) of all leaks."""
    get, words, size = index.term.get, [normal_words(t) for t in texts], [0]
    found = [np.fromiter(map(get, ws, repeat(-1)), dtype=np.int64, count=len(ws)) for ws in words]
    first = np.cumsum([0, *(passages(len(ws)) for ws in words)])
    ids, where = [], []
    for k, x in enumerate(found):
        at = np.flatnonzero(x >= 0)
        later, last = at // HALF, first[k + 1] - first[k] - 1
        ids += [x[at[later <= last]], x[at[later > 0]]]
        where += [first[k] + later[later <= last], first[k] + later[later > 0] - 1]
    hits = index.promising(np.concatenate(ids), np.concatenate(where), int(first[-1])) if ids else size[:0]
    best: dict[tuple[int, int], list] = {}
    for p in hits:
        k = int(np.searchsorted(first, p, side="right")) - 1
        a = (int(p) - int(first[k])) * HALF
        terms = np.unique(found[k][a : a + PASSAGE])
        for unit, score in index.retrieve(terms[terms >= 0].tolist()):
            item = index.unit_item[unit]
            reach = len(index.items[item].words)
            asked, answered, whole = overlaps(index.items[item], words[k][max(0, a - reach) : a + PASSAGE + reach])
            if verified(asked, answered, whole, overlap) and index.items[item].words:
                now = best.setdefault((k, item), [score, asked, answered])
                best[k, item] = [max(x, y) for x, y in zip(now, (score, asked, answered))]
    for (k, item), (score, asked, answered) in best.items():
        yield k, index.items[item].item_id, score, asked, answered


def _unit_terms(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, term) of each unit and distinct term; a unit's length comes with a null term."""
    for batch in stream:
        rows = []
        for shard, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for unit in units_of(normal_words(text)):
                rows += [(shard, t, 0) for t in set(unit)] + [(shard, None, len(unit))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["shard", "term", "length"])


def indexes(benchmark: DataFrame, threshold: float, max_items: int) -> Iterator[Index]:
    """One index per shard of about `max_items` items; a shard is what the driver and each task hold at a time.

    Weights come from all items: counted here where there is one shard, by Spark where there are more, of which a shard gets its own terms.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).distinct()
    shards = -(-items.count() // max_items)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(shards, 1))).cast("int"))
    if shards > 1:
        dealt = stored(dealt, "items")
        terms = stored(dealt.select("shard", "text").mapInArrow(_unit_terms, "shard int, term binary, length long"), "terms")
        n, mean = terms.filter("term IS NULL").agg(F.count(F.lit(1)), F.avg("length")).first()
        counted = stored(terms.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.collect_set("shard").alias("shards")), "frequencies")
    for k in range(shards):
        rows = dealt.filter(F.col("shard") == k).orderBy("item_id", "text").collect()
        parsed, stats = [parse_item(r["item_id"], None if r["text"] is None else bytes(r["text"])) for r in rows], None
        if shards > 1:
            held = counted.filter(F.array_contains("shards", k)).select("term", "n").collect()
            stats = Statistics(n, mean or 0.0, {bytes(t): c for t, c in held})
        index = Index(parsed, threshold, stats)
        index.shards = shards
        yield index


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
_FOUND_DDL = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
_AT_ONCE = 256


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, max_items: int = 20_000) -> DataFrame:
    """A row per document row and test item that it holds.

    Null and wordless texts and items match nothing; repeated rows are reported each; an empty benchmark or corpus gives no row.
    Scores are the best over passages, rounded to 6 digits.
    """

    def scan(index: Index):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for at in range(0, batch.num_rows, _AT_ONCE):
                    part = batch.slice(at, _AT_ONCE)
                    ids = part.column(0).to_pylist()
                    rows = [(ids[k], item, round(s, 6), round(q, 6), round(a, 6)) for k, item, s, q, a in leaks(index, part.column(1).to_pylist(), overlap)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

        return run

    out = docs.sparkSession.createDataFrame([], _FOUND_DDL)
    for index in indexes(benchmark, threshold, max_items):
        found = identified(docs).mapInArrow(scan(index), _FOUND_DDL)
        # of several shards, the results of one are written before the next index is made
        out = out.unionByName(found if index.shards == 1 else stored(found, "leaks"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, max_items: int = 20_000) -> DataFrame:
    """The rows of `docs` that hold no test item."""
    at, out = docs.columns.index("text"), small_batches(docs)

    def clean(index: Index):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for a in range(0, batch.num_rows, _AT_ONCE):
                    part = batch.slice(a, _AT_ONCE)
                    texts = [None if t is None else t.encode() for t in part.column(at).to_pylist()]
                    bad = {k for k, *_ in leaks(index, texts, overlap)}
                    yield part.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        return run

    for index in indexes(benchmark, threshold, max_items):
        out = out.mapInArrow(clean(index), docs.schema)
        if index.shards > 1:
            out = small_batches(stored(out, "clean"))
    return out
