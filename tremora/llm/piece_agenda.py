"""SentencePiece encoding and decoding for merge-type vocabularies by a score-ordered agenda.

A text becomes symbols, one per code point; the agenda holds every adjacent pair whose concatenation is a piece, best score
first, then the leftmost. The best pair is merged, its two new neighbour pairs enter, until the agenda is empty. Code points
without a piece end as byte pieces.

No piece of such a vocabulary has a space mark after another character (checked when it is loaded), so nothing merges across the
begin of a word: words are units of their own, and the ids of known units are remembered. New units are encoded together: the
agendas of all units of like length are rows of one matrix, each step takes the top of every agenda at once. Units longer than
`WIDEST` get a heap. The new units of an Arrow batch are also encoded by the sentencepiece library, and every decoded
text is compared with its original; a difference raises.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremora.llm.common import small_batches

SPACE = "▁"
ID_BYTES = 4
#: Widths of the agenda matrices; longer units are encoded one at a time with a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
WIDEST = WIDTHS[-1]
_CHAR = 1 << 20  # symbols from here on are code points that are no piece
_PAD = (1 << 22) - 1
_NEVER = np.iinfo(np.int32).max
_KNOWN = 80_000
_CELLS = 1 << 19  # of a matrix of agendas; each takes some forty bytes while they are worked on
_TOGETHER = 1000  # units in one call of the library
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # fixed values: piece types of the model format
_MERGES = 2  # fixed value: model type


class PairTable:
    """(left symbol, right symbol) -> (merged symbol, rank of its score), an open-addressed table for whole arrays of pairs."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([(a << 22) | b for a, b in pairs] or [-1], dtype=np.int64)
        values = np.array(list(pairs.values()) or [(0, _NEVER)], dtype=np.int32)
        self.bits = max(8, int(len(keys) * 8).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.merged = np.zeros(1 << self.bits, dtype=np.int32)
        self.rank = np.full(1 << self.bits, _NEVER, dtype=np.int32)
        slots = self._slot(keys)
        for key, slot, (merged, rank) in zip(keys.tolist(), slots.tolist(), values.tolist()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & (len(self.keys) - 1)
            self.keys[slot], self.merged[slot], self.rank[slot] = key, merged, rank
        self.pairs = pairs

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs; an empty slot (rank _NEVER) where they do not merge."""
        keys = (left.astype(np.int64) << 22) | right
        slots = self._slot(keys)
        held = self.keys[slots]
        open_ = np.nonzero((held != keys) & (held >= 0))
        while len(open_[0]):
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            held = self.keys[slots[open_]]
            still = (held != keys[open_]) & (held >= 0)
            open_ = tuple(o[still] for o in open_)
        return slots


class Pieces:
    """A merge-type vocabulary with byte pieces and identity normalisation; ValueError for any other model."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        norm, trained = model.normalizer_spec, model.trainer_spec
        if trained.model_type != _MERGES or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type vocabulary with byte pieces")
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only identity normalisation with a space before the text is supported")
        if {p.type for p in model.pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.names = [p.piece for p in model.pieces]
        normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == _NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece crosses the begin of a word")
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.byte = np.full(256, -1, dtype=np.int64)
        for k, p in enumerate(model.pieces):
            if p.type == _BYTE:
                self.byte[int(p.piece[3:5], 16)] = k
        self.symbols = np.arange(0x110000, dtype=np.int32) + _CHAR
        for p, k in normal.items():
            if len(p) == 1:
                self.symbols[ord(p)] = k
        scores = sorted({p.score for p in model.pieces}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        symbol = lambda p: normal[p] if p in normal else _CHAR + ord(p) if len(p) == 1 else None
        pairs = {}
        for p, k in normal.items():
            for at in range(1, len(p)):
                left, right = symbol(p[:at]), symbol(p[at:])
                if left is not None and right is not None:
                    pairs[left, right] = (k, rank[model.pieces[k].score])
        self.table = PairTable(pairs)
        kinds = [p.type for p in model.pieces]
        self.raw = [bytes([int(n[3:5], 16)]) if t == _BYTE else b"" if t == _CONTROL else b" \xe2\x81\x87 " if t == _UNKNOWN else n.replace(SPACE, " ").encode() for n, t in zip(self.names, kinds)]
        self.is_byte = [t == _BYTE for t in kinds]
        self.marked = [t == _NORMAL and n.startswith(SPACE) for n, t in zip(self.names, kinds)]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # -- the agenda ------------------------------------------------------------------------------------------------

    def _rows(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges each row of a padded matrix; flat symbols of all rows and their number by row."""
        table, (n, width) = self.table, symbols.shape
        slots = table.find(symbols[:, :-1], symbols[:, 1:])
        out, sizes, at = np.full_like(symbols, _PAD), np.zeros(n, dtype=np.int64), np.arange(n)
        ranks, merged = table.rank[slots], table.merged[slots]
        columns = np.arange(width)
        while len(at):
            best = ranks.argmin(axis=1)  # the first of equal ones
            rows = np.arange(len(at))
            live = ranks[rows, best] != _NEVER
            if not live.all():
                done = ~live
                out[at[done]] = symbols[done]
                at, symbols, ranks, merged, best = at[live], symbols[live], ranks[live], merged[live], best[live]
                rows = rows[: len(at)]
                if not len(at):
                    break
            symbols[rows, best] = merged[rows, best]
            moved = columns[None, :-1] > best[:, None]
            symbols[:, :-1] = np.where(moved, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = _PAD
            for pairs in (ranks, merged):
                pairs[:, :-1] = np.where(moved[:, :-1], pairs[:, 1:], pairs[:, :-1])
            ranks[:, -1] = _NEVER
            before, inside = np.maximum(best - 1, 0), np.minimum(best, width - 2)
            for pair in (before, inside):
                slots = table.find(symbols[rows, pair], symbols[rows, pair + 1])
                ranks[rows, pair], merged[rows, pair] = table.rank[slots], table.merged[slots]
        kept = out != _PAD
        return out[kept], kept.sum(axis=1)

    def _heap(self, symbols: list[int]) -> list[int]:
        """The same for one long unit."""
        pairs, n = self.table.pairs, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def enter(a: int, b: int) -> None:
            found = pairs.get((symbols[a], symbols[b]))
            if found:
                agenda.append((found[1], a, b, symbols[a], symbols[b]))

        for k in range(n - 1):
            enter(k, k + 1)
        heapq.heapify(agenda)
        while agenda:
            _, a, b, left, right = heapq.heappop(agenda)
            if symbols[a] != left or symbols[b] != right or after[a] != b:
                continue  # one of them was merged meanwhile
            symbols[a], symbols[b] = pairs[left, right][0], -1
            after[a] = c = after[b]
            if c < n:
                before[c] = a
            for x, y in ((before[a], a), (a, c)):
                if x >= 0 and y < n:
                    found = pairs.get((symbols[x], symbols[y]))
                    if found:
                        heapq.heappush(agenda, (found[1], x, y, symbols[x], symbols[y]))
        return [s for s in symbols if s >= 0]

    def _ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols, with byte pieces for code points, and the numbers of ids by unit."""
        points = symbols.astype(np.int64) - _CHAR
        odd = points >= 0
        if not odd.any():
            return symbols.astype("<u4"), sizes
        spread = np.ones(len(symbols), dtype=np.int64)
        spread[odd] += (points[odd] >= 0x80).astype(np.int64) + (points[odd] >= 0x800) + (points[odd] >= 0x10000)
        ids = np.repeat(symbols, spread).astype("<u4")
        at = np.cumsum(spread) - spread
        for k in np.nonzero(odd)[0].tolist():
            ids[at[k] : at[k] + spread[k]] = self.byte[list(chr(points[k]).encode())]
        bounds = np.concatenate([[0], np.cumsum(spread)])
        ends = bounds[np.cumsum(sizes)]
        return ids, np.diff(np.concatenate([[0], ends]))

    def units_ids(self, units: list[str]) -> list[bytes]:
        """Ids of each unit (a stretch that begins with a space mark), little-endian unsigned 32-bit."""
        out: list[bytes] = [b""] * len(units)
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        starts = np.cumsum(sizes) - sizes
        symbols = self.symbols[points]
        low = 0
        for width in WIDTHS:
            of_width = np.nonzero((sizes > low) & (sizes <= width))[0]
            low = width
            columns = np.arange(width)
            for at in range(0, len(of_width), _CELLS // width):
                group = of_width[at : at + _CELLS // width]
                inside = columns[None, :] < sizes[group][:, None]
                places = np.minimum(starts[group][:, None] + columns, len(symbols) - 1)
                flat, counts = self._rows(np.where(inside, symbols[places], np.int32(_PAD)))
                ids, counts = self._ids(flat, counts)
                code, ends = ids.tobytes(), (np.cumsum(counts) * ID_BYTES).tolist()
                for k, a, b in zip(group.tolist(), [0, *ends], ends):
                    out[k] = code[a:b]
        for k in np.nonzero(sizes > WIDEST)[0].tolist():
            flat = np.array(self._heap(symbols[starts[k] : starts[k] + sizes[k]].tolist()), dtype=np.int32)
            out[k] = self._ids(flat, np.array([len(flat)]))[0].tobytes()
        return out

    # -- texts -----------------------------------------------------------------------------------------------------

    @staticmethod
    def cut(text: str) -> list[str]:
        """The units of a text without the space mark that each begins with; an empty text has none."""
        if not text:
            return []
        if SPACE not in text:
            cut = text.split(" ")
            if all(cut):
                return cut
        return [u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str], check: bool = True) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers, without begin and end ids."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > _KNOWN:
            self.known, self.old = {}, self.known  # the last generation is asked once more
        new = set().union(*cut).difference(self.known)
        self.known.update([(u, self.old[u]) for u in new if u in self.old])
        new = list(new.difference(self.known))
        if new:
            marked = [SPACE + u for u in new]
            ids = self.units_ids(marked)
            if check:
                self._check(marked, ids)
            self.known.update(zip(new, ids))
        find = self.known.__getitem__
        out = [b"".join(map(find, c)) for c in cut]
        for u in new:
            if len(u) > WIDEST:
                del self.known[u]
        return out

    def _check(self, units: list[str], ids: list[bytes]) -> None:
        """Compare with the library. It puts a space mark before its text itself; units of marks alone would run into the next one."""
        joined = [k for k, u in enumerate(units) if u[-1] != SPACE]
        groups = [joined[k : k + _TOGETHER] for k in range(0, len(joined), _TOGETHER)] + [[k] for k, u in enumerate(units) if u[-1] == SPACE and u != SPACE]
        for group in groups:
            library = self.library.encode("".join([units[k] for k in group])[1:], num_threads=1)
            if np.array(library, dtype="<u4").tobytes() != b"".join([ids[k] for k in group]):
                raise ArithmeticError("the agenda and the sentencepiece library differ")

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: control pieces vanish, a space mark at its begin too, bytes that are no UTF-8 become U+FFFD each."""
        first = next((i for i in ids if self.raw[i]), None)
        data = b"".join(map(self.raw.__getitem__, ids))
        if first is not None and self.marked[first]:
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            pass
        out, run = [], bytearray()
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.raw[i]
                continue
            out.append(_lenient(bytes(run)))
            run.clear()
            out.append(self.raw[i].decode() if i >= 0 else "")
        text = "".join(out)
        return text[1:] if first is not None and self.marked[first] else text


def _lenient(data: bytes) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per worker."""
    return Pieces(path)


_PORTION = 1 << 21


def portions(stream: Iterator[pa.RecordBatch], most: int = _PORTION) -> Iterator[tuple[list[pa.RecordBatch], list[str]]]:
    """Record batches, cut where their texts (last column, UTF-8) reach a few megabytes."""
    held, texts, size = [], [], 0
    for batch in stream:
        start = 0
        for k, value in enumerate(batch.column(batch.num_columns - 1)):
            texts.append((value.as_py() or b"").decode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= most:
                held.append(batch.slice(start, k + 1 - start))
                start = k + 1
                yield held, texts
                held, texts, size = [], [], 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield held, texts


def encoded(docs: DataFrame, model: str, keep: list[str] | None = None, check: bool = True) -> DataFrame:
    """The columns `keep` (default: doc_id) of each row of `docs`, `piece_ids` (binary, little-endian unsigned 32-bit ids with begin and
    end id) and `decoded` (the text of those ids).

    Null and empty texts have the two ids only and decode to an empty text; repeated rows stay repeated; texts may be of
    any length that fits a row; an empty table gives none; other columns of `docs`, whatever their names, are left out. Columns to
    keep must not be called piece_ids or decoded.
    """
    kept = list(keep or ["doc_id"])
    if {c.lower() for c in kept} & {"piece_ids", "decoded"}:
        raise ValueError("a column to keep has the name of a result")
    chosen = small_batches(docs).select(*kept, F.col("text").cast("string").cast("binary").alias("_text"))
    schema = T.StructType([*[chosen.schema[c] for c in kept], T.StructField("piece_ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        first, last = (int(k).to_bytes(ID_BYTES, "little") for k in (own.begin, own.end))
        for batches, texts in portions(stream):
            ids = [first + code + last for code in own.encode(texts, check)]
            decoded = [own.decode(np.frombuffer(code, dtype="<u4").tolist()) for code in ids]
            for text, again in zip(texts, decoded):
                if again != text and again != text.replace(SPACE, " "):
                    raise ArithmeticError("a decoded text differs from its original")
            whole = pa.Table.from_batches([b.select(range(len(kept))) for b in batches]).combine_chunks()
            columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], names=[*kept, "piece_ids", "decoded"])

    return chosen.mapInArrow(run, schema)


def digests(found: DataFrame) -> list[Column]:
    """Number of ids and checksums of ids and text, computed on the JVM."""
    return [
        F.col("doc_id").cast("long").alias("doc_id"), (F.length("piece_ids") / ID_BYTES).cast("long").alias("n_tokens"),
        F.sha2("piece_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    ]
