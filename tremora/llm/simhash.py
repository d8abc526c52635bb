"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into r // 2 + 1 segments for a radius of r bits, so in any linked pair some segment
differs by one bit at most. Distinct segment values are indexed under each of their one-wildcard variants;
a variant has two possible values at most, so the equality join is an aggregate of a minimum and a maximum and
yields at most one neighbour per bit, however large a group of copies is. Fingerprints whose segments are equal
or neighbours meet in one group; there a search from one fingerprint to the next verifies the distance and emits a
spanning forest, so links within a group are found without listing pairs. Components over distinct
fingerprints give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, stored
from tremora.operators.components import connected_components

BITS = 64
SEED = 42
_BLOCK = 1 << 16


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, repeats included; shorter texts hash their whole word sequence."""
    if not words:
        return np.zeros(0, dtype="<u8")
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    last = ends[min(size, len(words)) - 1 :].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, last)], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit value; a bit is 1 if it is set in over half the hashes. No hashes: zero."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row. Null and wordless texts have fingerprint zero; a null id stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = [fingerprint(shingle_hashes((t.as_py() or b"").lower().split(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], schema=schema)

    return identified(docs).mapInArrow(run, "doc_id long, fp long")


def _segments(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment."""
    n = radius // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segment_values(fp: Column, radius: int) -> Column:
    parts = [F.struct(F.lit(k).alias("seg"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)).alias("val")) for k, (a, w) in enumerate(_segments(radius))]
    return F.explode(F.array(*parts))


def _forest(radius: int):
    """Spanning forest of the links inside each group; rows arrive sorted by group, and a group may span batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        left = np.unique(values).view(np.uint64)
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(left ^ x) <= radius
                if near.any():
                    reached, left = left[near], left[~near]
                    queue.extend(reached)
                    yield np.full(len(reached), x).view(np.int64), reached.view(np.int64)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def edges():
            for a, b in search(np.concatenate(held)):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in stream:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            fps = batch.column(3).to_numpy()
            if not len(fps):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for part, first in zip(np.split(fps, cuts), keys[np.concatenate(([0], cuts))].tolist()):
                if first != key and held:
                    yield from edges()
                    held = []
                key = first
                held.append(part)
        if held:
            yield from edges()

    return run


def links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): true links among distinct fingerprints `classes(fp)`, enough of them to connect all that are linked."""
    spark_segments = _segments(radius)
    cut = classes.select("fp", _segment_values(F.col("fp"), radius).alias("s")).select("fp", "s.seg", "s.val")
    values = cut.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n"))
    width = F.element_at(F.array(*(F.lit(w) for _, w in spark_segments)), F.col("seg") + 1)
    bit = F.expr("shiftleft(1L, pos)")
    variants = values.withColumn("pos", F.explode(F.sequence(F.lit(0), width - 1))).select("seg", "pos", F.col("val").bitwiseAND(F.bitwise_not(bit)).alias("masked"), "val")
    pairs = variants.groupBy("seg", "pos", "masked").agg(F.min("val").alias("lo"), F.max("val").alias("hi")).filter("lo < hi").select("seg", "lo", "hi")
    alone = values.filter("n > 1").select("seg", F.col("val").alias("lo"), F.col("val").alias("hi"), "val")
    wanted = pairs.withColumn("val", F.explode(F.array("lo", "hi"))).unionByName(alone)
    grouped = cut.join(wanted, ["seg", "val"]).select(F.col("seg").cast("long").alias("seg"), "lo", "hi", "fp")
    return grouped.repartition("seg", "lo", "hi").sortWithinPartitions("seg", "lo", "hi").mapInArrow(_forest(radius), "a long, b long").distinct()


def classes_of(prints: DataFrame) -> DataFrame:
    """(fp, first): distinct fingerprints with their smallest id."""
    return stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")


def components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest id reachable from each fingerprint over `edges(a, b)`."""
    joined = connected_components(edges, "a", "b").withColumnsRenamed({"node": "fp", "component": "_root"})
    rooted = classes.join(joined, "fp", "left").withColumn("_root", F.coalesce("_root", "fp"))
    least = rooted.groupBy("_root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "_root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`; fingerprints link at `radius` or fewer differing bits.

    Repeated rows and exact copies share a fingerprint; wordless and null texts have fingerprint zero and link like
    others. Rows without an id get their class, and a class without any id has a null component_id.
    """
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    classes = classes_of(prints)
    return prints.join(components(classes, links(classes, radius)), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
