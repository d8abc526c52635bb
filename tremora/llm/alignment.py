"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked id pairs.

A text is encoded by a byte-level vocabulary (A) and by a SentencePiece vocabulary (B). Byte offsets where tokens of both end cut the
text into groups; the two tokens that end a group are linked. Most groups hold one token of each kind, and these have the same
bytes, so an array computed once from the vocabularies (A id -> B id of the same bytes) names the pair: such groups are counted in
vectors as long as vocabulary A. Only the pairs of other, irregular groups are counted by a shuffle, summed per chunk of texts before.

The first pass writes one row per chunk (a megabyte of texts): links and counts of its documents, its irregular pairs
and its vector. The regular links of a document are summed where its chunk lies, as their counts are vectors as long as the
vocabularies; only irregular ones travel on. Their counts return to the chunks by a join on pairs and a join on chunks, never to
single links. A task holds a few chunks at once, whatever the size of its split.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, stored
from tremora.llm.piece_agenda import Pieces, pieces, portions

# Fixed value: how the byte-level family cuts texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and digits of these blocks have been the same since long, so both libraries cut them alike; long white space is left out.
_RECENT = re.compile("[^\0-ԯ -⁯₠-₿ぁ-ゖァ-ヺ一-龥가-힣]|\\s{500}")


class ByteLevel:
    """A byte-level vocabulary of the tokenizers library's format. Special tokens' strings count as plain text."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed value: bytes that stand for themselves
        letter = {chr(b): b for b in letters}
        letter |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(letters))}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.raw = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.raw[k] = bytes(letter[c] for c in token if c in letter)
        made = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        ranks = {self.raw[k]: k for k in [*(vocabulary[c] for c in letter), *made]}
        # the second library merges by id; it is used where ids rise with the merges
        ordered = all(a < b for a, b in zip(made, made[1:])) and len(ranks) == 256 + len(made)
        self.fast = tiktoken.Encoding("pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if self.fast is None or _RECENT.search(text):
                slow.append(k)
            else:
                out[k] = np.array(self.fast.encode_ordinary(text), dtype=np.int32)
        for k, code in zip(slow, self.library.encode_batch_fast([texts[k] for k in slow], add_special_tokens=False)):
            out[k] = np.array(code.ids, dtype=np.int32)
        return out


@lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


def same_bytes(a: ByteLevel, b: Pieces) -> np.ndarray:
    """For each A id the B id of the same bytes, a piece rather than a byte piece, or -1."""
    found: dict[bytes, int] = {}
    for k in sorted(range(len(b.raw)), key=lambda k: (b.is_byte[k], k)):
        if b.raw[k]:
            found.setdefault(b.raw[k], k)
    return np.array([found.get(x, -1) if x else -1 for x in a.raw], dtype=np.int32)


@dataclass
class Aligned:
    """Of several texts: ids that end groups, tokens by group, groups by text, and what the texts' groups look like."""

    last_a: np.ndarray
    last_b: np.ndarray
    many_a: np.ndarray
    many_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in v.raw], dtype=np.int64) for v in (a, b)]
        self.same = same_bytes(a, b)
        # what a token adds to the description of its group: A or B, last or not
        self.words = [f"{k}{end}" for v, ends in ((a, ",|"), (b, ",;")) for end in ends for k in range(len(v.raw))]
        self.at = np.cumsum([0, len(a.raw), len(a.raw), len(b.raw)])

    def align(self, texts: list[str]) -> Aligned:
        """Texts without tokens (empty, or not given back by both vocabularies) have no groups."""
        spaced = [" " + t for t in texts]
        codes = [self.a.encode(spaced), [np.frombuffer(c, dtype="<u4").astype(np.int32) for c in self.b.encode(texts, check=False)]]
        nothing = np.zeros(0, dtype=np.int32)
        for k, (text, with_space) in enumerate(zip(texts, spaced)):
            data = with_space.encode()
            if not text or any(b"".join(map(v.raw.__getitem__, c[k].tolist())) != data for v, c in zip((self.a, self.b), codes)):
                codes[0][k] = codes[1][k] = nothing
        n_a, n_b = (np.array([len(x) for x in c], dtype=np.int64) for c in codes)
        ids_a, ids_b = (np.concatenate([nothing, *c]) for c in codes)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        total = int(ends_a[-1]) + 1 if len(ends_a) else 1
        ends = np.zeros(total, dtype=np.int8)
        ends[ends_a] += 1
        ends[ends_b] += 1
        cut_a, cut_b = ends[ends_a] == 2, ends[ends_b] == 2
        close_a, close_b = np.nonzero(cut_a)[0], np.nonzero(cut_b)[0]
        # the tokens of a group: those of A, then those of B
        before_a, before_b = np.concatenate([[0], np.cumsum(cut_a)])[:-1], np.concatenate([[0], np.cumsum(cut_b)])[:-1]
        order = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        order[np.arange(len(ids_a)) + np.concatenate([[0], close_b + 1])[before_a]] = ids_a + np.where(cut_a, self.at[1], self.at[0])
        order[np.arange(len(ids_b)) + np.concatenate([close_a + 1, [0]])[before_b]] = ids_b + np.where(cut_b, self.at[3], self.at[2])
        stops, groups, start = np.cumsum(n_a + n_b).tolist(), [], 0
        word = self.words.__getitem__
        for stop in stops:
            groups.append("".join(map(word, order[start:stop].tolist()))[:-1])
            start = stop
        upto = np.concatenate([[0], np.cumsum(cut_a)])[np.concatenate([[0], np.cumsum(n_a)])]
        return Aligned(ids_a[cut_a], ids_b[cut_b], np.diff(close_a, prepend=-1), np.diff(close_b, prepend=-1), n_a, n_b, np.diff(upto), groups)


@lru_cache(maxsize=2)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(byte_level(a), pieces(b))


_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())), ("n_groups", pa.list_(pa.int64())), ("digests", pa.list_(pa.string())),
    ("regular", pa.binary()), ("n_regular", pa.list_(pa.int64())), ("irregular", pa.binary()), ("pairs", pa.list_(pa.int64())), ("pair_counts", pa.list_(pa.int64())), ("ones", pa.list_(pa.int64())), ("one_counts", pa.list_(pa.int64())),
])
_CHUNKS_DDL = "chunk long, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, digests array<string>, regular binary, n_regular array<bigint>, irregular binary, pairs array<bigint>, pair_counts array<bigint>, ones array<bigint>, one_counts array<bigint>"
_PAIR = 1 << 32
_CHUNK_BYTES = 1 << 20
_PART_BYTES = 1 << 18  # of texts aligned at once: a worker's arrays are some hundred times as long
_GROUP_CHUNKS = 4  # chunks of a row group, which the writer holds and the reader decodes at once


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.int64), *arrays])


def _chunked(a: str, b: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = aligner(a, b), TaskContext.get().partitionId() << 32
        width = _width(own.same)
        for parts in _parts(stream):
            ids, digests, totals, n_regular, regular, links = [], [], [], [], [], []
            for batches, texts in parts:
                found = own.align(texts)
                is_regular = (found.many_a == 1) & (found.many_b == 1) & (own.same[found.last_a] == found.last_b)
                links.append(found.last_a[~is_regular].astype(np.int64) * _PAIR + found.last_b[~is_regular])
                regular.append(found.last_a[is_regular].astype(width))
                n_regular.append(_by_document(is_regular, found.n_groups))
                totals.append((found.n_a, found.n_b, found.n_groups))
                ids += [i for batch in batches for i in batch.column(0).to_pylist()]
                digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups]
            pairs, places, counts = np.unique(_joined(links), return_inverse=True, return_counts=True)
            regular = np.concatenate(regular)
            ones, one_counts = np.unique(regular, return_counts=True)
            n_a, n_b, n_groups = map(_joined, zip(*totals))
            values = (chunk, ids, n_a, n_b, n_groups, digests, regular.tobytes(), _joined(n_regular), places.astype("<u4").tobytes(), pairs, counts, ones.astype(np.int64), one_counts)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNKS)], schema=_CHUNKS)
            chunk += 1

    return run


def _parts(stream: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[list[pa.RecordBatch], list[str]]]]:
    """The portions of each chunk, one after the other: a chunk is full when its texts reach `_CHUNK_BYTES`. Each must be read to its end."""
    cut = portions(stream, _PART_BYTES)

    def chunk(part):
        size = 0
        while part is not None:
            yield part
            size += sum(map(len, part[1]))
            if size >= _CHUNK_BYTES:
                return
            part = next(cut, None)

    for first in cut:
        yield chunk(first)


def _width(same: np.ndarray) -> str:
    """How ids of vocabulary A are written."""
    return "<u2" if len(same) <= 1 << 16 else "<u4"


def _by_document(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(sizes)])])


_DOCUMENTS = pa.schema([(c, pa.string() if c == "groups_sha256" else pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")])
_DOCUMENTS_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summed(a: str, b: str, ones: np.ndarray, highest: np.ndarray):
    """ones: how often the same-bytes pair of each A id is linked; highest: the largest count of a pair of each B id."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = aligner(a, b).same
        best_one = (ones > 0) & (same >= 0) & (ones == highest[np.maximum(same, 0)])
        for batch in stream:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n_regular = np.asarray(row.column("n_regular")[0].values)
                regular = np.frombuffer(row.column("regular")[0].as_py(), dtype=_width(same))
                added = {"sums": _by_document(ones[regular], n_regular), "bests": _by_document(best_one[regular], n_regular)}
                yield pa.RecordBatch.from_arrays([pa.array([added[f.name]], f.type) if f.name in added else row.column(f.name) for f in _IRREGULAR], schema=_IRREGULAR)

    return run


_CARRIED = ("chunk", "doc_ids", "n_a", "n_b", "n_groups", "digests", "n_regular", "irregular", "pairs")
_IRREGULAR = pa.schema([*[_CHUNKS.field(c) for c in _CARRIED], ("sums", pa.list_(pa.int64())), ("bests", pa.list_(pa.int64()))])
_IRREGULAR_DDL = ", ".join([x for x in _CHUNKS_DDL.split(", ") if x.split()[0] in _CARRIED] + ["sums array<bigint>", "bests array<bigint>"])


def _judged(highest: np.ndarray):
    """Adds the irregular links of each document; highest: the largest count of a pair of each B id."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                n_a, n_b, n_groups, n_regular, pairs, sums, bests = (np.asarray(row[c].values) for c in ("n_a", "n_b", "n_groups", "n_regular", "pairs", "sums", "bests"))
                counts = np.zeros(len(pairs), dtype=np.int64)
                if row["counted"].is_valid:
                    fields = row["counted"].values
                    counts[np.asarray(fields.field("place"))] = np.asarray(fields.field("n"))
                best = counts == highest[pairs % _PAIR]
                irregular, n_irregular = np.frombuffer(row["irregular"].as_py(), dtype="<u4"), n_groups - n_regular
                columns = (row["doc_ids"].values, n_a, n_b, n_groups, n_groups, bests + _by_document(best[irregular], n_irregular), sums + _by_document(counts[irregular], n_irregular), row["digests"].values)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(columns, _DOCUMENTS)], schema=_DOCUMENTS)

    return run


@dataclass
class Alignment:
    """The written chunks of a corpus and the paths of the two vocabularies."""

    chunks: DataFrame
    a: str
    b: str

    def irregular_pairs(self) -> DataFrame:
        """(pair, n): A id * 2^32 + B id, and the links of that pair in irregular groups."""
        return self.chunks.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("n"))

    def regular_counts(self) -> np.ndarray:
        """By A id, the links of its same-bytes pair; as long as the vocabulary."""
        out = np.zeros(len(byte_level(self.a).raw), dtype=np.int64)
        counted = self.chunks.select(F.explode(F.arrays_zip("ones", "one_counts")).alias("p")).groupBy("p.ones").agg(F.sum("p.one_counts"))
        for k, n in counted.collect():
            out[k] = n
        return out

    def pairs(self) -> DataFrame:
        """(a, b, n) of all linked id pairs."""
        spark, same = self.chunks.sparkSession, aligner(self.a, self.b).same
        ones = self.regular_counts()
        rows = [(int(k), int(same[k]), int(ones[k])) for k in np.nonzero(ones)[0]]
        irregular = self.irregular_pairs().select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(_PAIR - 1).alias("b"), "n")
        return irregular.unionByName(spark.createDataFrame(rows, "a long, b long, n long"))

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row aligned."""
        counted = stored(self.irregular_pairs(), "pair-counts")
        own = aligner(self.a, self.b)
        ones, highest = self.regular_counts(), np.zeros(len(own.b.raw), dtype=np.int64)
        for k, n in counted.groupBy(F.col("pair").bitwiseAND(_PAIR - 1).alias("b")).agg(F.max("n")).collect():
            highest[k] = n
        np.maximum.at(highest, own.same[ones > 0], ones[ones > 0])
        asked = self.chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
        answers = asked.join(counted, "pair").groupBy("chunk").agg(F.collect_list(F.struct("place", "n")).alias("counted"))
        summed = self.chunks.select(*_CARRIED, "regular").mapInArrow(_summed(self.a, self.b, ones, highest), _IRREGULAR_DDL)
        return summed.join(answers, "chunk", "left").mapInArrow(_judged(highest), _DOCUMENTS_DDL)


def aligned(docs: DataFrame, a: str, b: str) -> Alignment:
    """Align vocabularies `a` (byte-level) and `b` (SentencePiece) over the texts of `docs` (doc_id, text).

    Null and empty texts, and those that a vocabulary does not give back, have no tokens; equal rows count as often as they occur, null
    ids stay null, an empty table gives no rows, other columns are not read. Texts may be of any length that fits a row: a
    chunk holds one text at least. Of equal counts each is the highest.
    """
    # a row of the chunk table holds megabytes, so batches are cut by size
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 22))
    return Alignment(stored(identified(docs).mapInArrow(_chunked(a, b), _CHUNKS_DDL), "alignment", _GROUP_CHUNKS), a, b)


def groups(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, groups) with the groups of each text as `a1,a2|b1;a3|b2,b3`."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batches, texts in portions(stream, _PART_BYTES):
            ids = [i for batch in batches for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own.align(texts).groups, pa.string())], names=["doc_id", "groups"])

    return identified(docs).mapInArrow(run, "doc_id long, groups string")
