"""Token ids in bit or byte planes.

Documents in ascending id order are encoded, each ended by an end id, and cut into blocks of a fixed number of ids. A
block is transposed into planes (bit k, or byte k, of all its ids together) and each plane is compressed with
zstandard. A Parquet table in the target folder holds one row per block: the chunk index (shard, block, first id, number of
ids, document fragments) in its own columns and the planes in a binary column, so a reader of the index never
touches the planes. Spark's writer commits the files, hence a lost executor leaves no partial block.

Block payload, little-endian: `TPL1`, mode (1 byte: 1 bit planes, 8 byte planes), number of planes (1 byte), number of
ids (4 bytes), compressed size of each plane (4 bytes each), the compressed planes, least significant first.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremora.llm.common import identified

MAGIC = b"TPL1"
BIT, BYTE = 1, 8
ID_BYTES = 4
END_ID = 2
BLOCK_IDS = 1 << 16
_CACHED, _LONGEST, _PORTION, _TOGETHER = 400_000, 48, 1 << 22, 4000
_ODD_SPACE = re.compile(r"[^\S \n]")
_CUT = "\x01"
_NOT_PLAIN = (_CUT, "<|", " \n", "\n ", "\n\n", "  ")
#: Letters of these blocks have been letters since long, so the library's pattern takes them for such too; an apostrophe is no mark here.
_LETTERS_MARKS = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0523ぁ-ゖァ-ヺ一-龥가-힣]+)([.,;:!?)\\]}\"]*)")


def _letters() -> dict[int, str]:
    """Fixed value: the letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(other)}


_STANDS_FOR = _letters()
_SPACE = _STANDS_FOR[32]


def pack(ids: np.ndarray, mode: int = BYTE, level: int = 3) -> bytes:
    """One block of unsigned 32-bit ids as a payload."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, ID_BYTES)
    planes = [raw[:, k] for k in range(ID_BYTES)]
    if mode == BIT:
        planes = [np.packbits((p >> k) & 1) for p in planes for k in range(8)]
    compress = zstandard.ZstdCompressor(level=level).compress
    parts = [compress(np.ascontiguousarray(p).tobytes()) for p in planes]
    return MAGIC + struct.pack(f"<BBI{len(parts)}I", mode, len(parts), len(ids), *map(len, parts)) + b"".join(parts)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of one payload; raises ValueError if it is not one."""
    if payload[:4] != MAGIC:
        raise ValueError("not a plane block")
    mode, planes, n = struct.unpack_from("<BBI", payload, 4)
    sizes = struct.unpack_from(f"<{planes}I", payload, 10)
    at, raw = 10 + 4 * planes, np.zeros((n, ID_BYTES), dtype=np.uint8)
    expand = zstandard.ZstdDecompressor().decompress
    for k, size in enumerate(sizes):
        plane = np.frombuffer(expand(payload[at : at + size], max_output_size=max(n, 1)), dtype=np.uint8)
        at += size
        if mode == BYTE:
            raw[:, k] = plane
        else:
            raw[:, k // 8] |= np.unpackbits(plane, count=n) << (k % 8)
    return raw.reshape(-1).view("<u4")


class Encoder:
    """Encodes whole texts with the tokenizers library, remembering the ids of short pieces.

    The byte-level pattern never matches from a non-space into white space, a single space before a non-space always begins a
    new match, and a single line feed between non-spaces is a match of its own. Texts are cut there and nowhere else; other
    stretches of white space stay inside their piece. Plain texts, whose pieces are words, words after a space and single line feeds, are cut
    and numbered many at a time by Arrow, so that Python only sees distinct pieces. New pieces are encoded many at a time: those of letters
    are one match of the pattern each and go to the library's merges at once, the others one after the other in one text, and are told apart by the
    byte lengths of their tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for what is one match already
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)  # one letter stands for one byte
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def plain(text: str) -> bool:
        """Whether all pieces of a text that is not empty are words, words after a space and single line feeds."""
        if text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, _NOT_PLAIN)):
            return False
        return not _ODD_SPACE.search(text)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The pieces of any text."""
        out = []
        for k, p in enumerate(text.split(" ")):
            if k and (not p or p[0].isspace() or not out[-1] or out[-1][-1].isspace()):
                out[-1] += " " + p
            else:
                out.append(" " + p if k else p)
        return [p for p in out if p]

    def _learn_letters(self, words: list[str]) -> None:
        """Ids of words of letters, with or without a space before them."""
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            shown = [w.replace(" ", _SPACE) if w.isascii() else w.encode().decode("latin-1").translate(_STANDS_FOR) for w in some]
            code = self.merges.encode_batch_fast([shown], is_pretokenized=True, add_special_tokens=False)[0].ids
            self._tell_apart(some, code, np.fromiter(map(len, shown), dtype=np.int64, count=len(shown)))

    def _tell_apart(self, words: list[str], code: list[int], sizes: np.ndarray, skip: int = 0) -> None:
        """Remember the ids of words encoded one after the other; each takes `sizes` bytes and its first `skip` ids are left out."""
        ids = np.array(code, dtype="<u4")
        places = ((np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1) * ID_BYTES).tolist()
        data, skip = ids.tobytes(), skip * ID_BYTES
        self.known.update(zip(words, [data[a + skip : b] for a, b in zip([0, *places], places)]))

    def _learn_any(self, words: list[str], before: str = "") -> None:
        """Ids of words that begin with a space, or of words that may follow `before`, a token of its own, which is then left out."""
        for at in range(0, len(words), _TOGETHER):
            some = words[at : at + _TOGETHER]
            placed = [before + w for w in some] if before else some
            code = self.tokenizer.encode("".join(placed), add_special_tokens=False).ids
            self._tell_apart(some, code, np.fromiter(map(len, map(str.encode, placed)), dtype=np.int64, count=len(placed)), len(before))

    def _learn_alone(self, pieces: list[str]) -> None:
        self.known.update(zip(pieces, [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]))

    def _unknown(self, pieces: list[str]) -> list[str]:
        """Those of distinct pieces that neither generation holds; what the last one holds is carried over."""
        known, old = self.known, self.old
        new = [p for p in pieces if p not in known]
        known.update([(p, old[p]) for p in new if p in old])
        return [p for p in new if p not in known]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of distinct pieces of plain texts. Letters end where marks begin, so both are encoded apart."""
        cut, spaced, first, alone = [], [], [], []
        for p in self._unknown(pieces):
            found = _LETTERS_MARKS.fullmatch(p)
            if found:
                cut.append((p, found[1], found[2]))
            else:
                (alone if p == "\n" else spaced if p[0] == " " else first).append(p)
        self._learn_letters(self._unknown(list(dict.fromkeys(core for _, core, _ in cut))))
        self._learn_alone(alone + self._unknown(list({marks for _, _, marks in cut if marks})))
        self._learn_any(spaced)
        self._learn_any(first, "\n")
        known = self.known
        known.update([(p, known[core] + known[marks]) for p, core, marks in cut if marks])

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        marked = pa.array([t.replace(" ", f"{_CUT} ").replace("\n", f"{_CUT}\n{_CUT}") for t in texts], pa.large_string())
        cut = pc.split_pattern(marked, _CUT)
        numbered = cut.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = list(map(self.known.get, pieces))
        new = [p for p, code in zip(pieces, codes) if code is None]
        if new:
            self._learn(new)
            codes = [self.known[p] if code is None else code for p, code in zip(pieces, codes)]
        sizes = np.fromiter(map(len, codes), dtype=np.int64, count=len(codes)) // ID_BYTES
        at, flat = np.asarray(numbered.indices), np.frombuffer(b"".join(codes), dtype="<u4")
        n = sizes[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n) + np.arange(ends[-1])].tobytes()
        bounds = (np.concatenate([[0], ends])[np.asarray(cut.offsets)] * ID_BYTES).tolist()
        for p in new:
            if len(p) > _LONGEST:
                del self.known[p]
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > _CACHED:
            # the last generation is asked once more, so frequent pieces survive
            self.known, self.old = {}, self.known
        out = [b""] * len(texts)
        plain, odd = [], []
        for k, t in enumerate(texts):
            if t:
                (plain if self.plain(t) else odd).append(k)
        if plain:
            for k, code in zip(plain, self._encode_plain([texts[k] for k in plain])):
                out[k] = code
        if odd:
            cut = [self.pieces(texts[k]) for k in odd]
            new = self._unknown(list(set().union(*cut)))
            self._learn_alone(new)
            for k, c in zip(odd, cut):
                out[k] = b"".join(map(self.known.__getitem__, c))
            for p in [p for p in new if len(p) > _LONGEST]:
                del self.known[p]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker; a task has one core, so the library's own threads would only wait for each other."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("first_doc", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())), ("opens", pa.bool_()), ("closes", pa.bool_()), ("payload", pa.binary()),
])
_BLOCKS_DDL = "shard int, block int, first long, n_ids int, first_doc long, doc_ids array<bigint>, doc_sizes array<int>, opens boolean, closes boolean, payload binary"


def _blocks(tokenizer: str, end_id: int, block_ids: int, mode: int):
    """opens: the first fragment begins its document; closes: the last one ends its document."""

    def portions(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, texts, held = [], [], 0
        for batch in stream:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append((t.as_py() or b"").decode("utf-8", "replace"))
                held += len(texts[-1])
                if held >= _PORTION:
                    yield ids, texts
                    ids, texts, held = [], [], 0
        if ids:
            yield ids, texts

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, encode, end = TaskContext.get().partitionId(), encoder(tokenizer).encode, struct.pack("<I", end_id)
        limit = block_ids * ID_BYTES
        held, docs, sizes, opens, block, no = bytearray(), [], [], True, 0, -1

        def row(closes: bool) -> pa.RecordBatch:
            """Of the fragments held; the last of them belongs to document `no`."""
            values = (shard, block, block * block_ids, len(held) // ID_BYTES, no + 1 - len(docs), docs, sizes, opens, closes, pack(np.frombuffer(bytes(held), "<u4"), mode))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCKS)], schema=_BLOCKS)

        for ids, texts in portions(stream):
            for i, code in zip(ids, encode(texts)):
                code, at, no = code + end, 0, no + 1
                while at < len(code):
                    part = code[at : at + limit - len(held)]
                    held += part
                    at += len(part)
                    docs.append(i)
                    sizes.append(len(part) // ID_BYTES)
                    if len(held) == limit:
                        yield row(at == len(code))
                        block, opens = block + 1, at == len(code)
                        held, docs, sizes = bytearray(), [], []
        if held:
            yield row(True)

    return run


def write_planes(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, mode: int = BYTE) -> None:
    """Write all rows of `docs` in ascending doc_id order (null ids first, equal ids by a hash of the text) under `path`.

    Null texts count as empty: their document is the end id alone. Shards are range partitions, in id order; the bounds are
    drawn from ids and hashes, so no text is sampled, and rows that share an id are spread too.
    """
    keyed = identified(docs, F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer, end_id, block_ids, mode), _BLOCKS_DDL).write.option("compression", "uncompressed").parquet(path)


def _fragments(starts: dict[int, int]):
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("no", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                data, last = unpack(row["payload"]).tobytes(), len(row["doc_ids"]) - 1
                out, at, start = [], 0, starts[row["shard"]] + row["first"]
                for k, (i, n) in enumerate(zip(row["doc_ids"], row["doc_sizes"])):
                    whole = (k > 0 or row["opens"]) and (k < last or row["closes"])
                    out.append((i, row["shard"], row["first_doc"] + k, start + at, n, zlib.crc32(data[at * ID_BYTES : (at + n) * ID_BYTES]), whole))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (crc, number of bytes) of its parts.

    The checksum is linear but for its start value: of A and n bytes B it is that of A and n zeros, corrected by those of n
    zeros and of B alone.
    """
    total = 0
    for crc, n in parts:
        zeros = bytes(n)
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
    return total


def _joined(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in stream:
        rows = [(r["doc_id"], r["parts"][0]["start"], sum(p["n_tokens"] for p in r["parts"]), joined_crc([(p["crc"], p["n_tokens"] * ID_BYTES) for p in r["parts"]])) for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index: all of a block but its planes."""
    return spark.read.parquet(path).drop("payload")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files.

    Blocks are read wherever they lie. Only documents that cross blocks are gathered, as checksums of their fragments; one row
    per shard reaches the driver.
    """
    start, starts = 0, {}
    for shard, n in read_index(spark, path).groupBy("shard").agg(F.sum("n_ids")).orderBy("shard").collect():
        starts[shard], start = start, start + n
    found = spark.read.parquet(path).mapInArrow(_fragments(starts), "doc_id long, shard int, no long, start long, n_tokens long, crc long, whole boolean")
    whole = found.filter("whole").select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))
    parts = found.filter("NOT whole").groupBy("shard", "no", "doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "n_tokens", "crc"))).alias("parts"))
    return whole.unionByName(parts.select("doc_id", "parts").mapInArrow(_joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))
