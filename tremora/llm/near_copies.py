"""Groups of near copies for the pipeline: SimHash links and, beside them, similarity links.

Texts whose five-word shingles are 0.8 similar differ by about 8 of 64 fingerprint bits (measured, README), far beyond the
radius that segments can index at a tolerable number of false candidates. So banded minima of the shingle hashes propose
further pairs among the fingerprint classes, and the exact Jaccard similarity verifies them. A first round compares the members of a
band's bucket with its first and its last one, which joins most groups. A second round compares all members of a bucket that are not
joined yet: those of like size with each other, in tiles of a bounded number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm import simhash
from tremora.llm.common import identified, stored
from tremora.operators.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 5
_FACTORS = (np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, size=BANDS * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BLOCK = 1 << 13
#: Texts and bytes of one side of a tile, columns of a tile's matrix.
_TILE, _TILE_BYTES, _COLUMNS = 256, 1 << 22, 1 << 12
#: Set sizes of similar texts differ by a factor of 1.25 at most, so they are in the same size class or in neighbouring ones.
_SIZE_CLASS = 1.26


def band_keys(hashes: np.ndarray) -> list[int]:
    """One 64-bit key per band from ROWS minima of the multiplied hashes; none for a text without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].astype(np.uint64)
        for k, factor in enumerate(_FACTORS):
            least[k] = min(least[k], (block * factor).min())
    key = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64).tolist()


def _digest(docs: DataFrame) -> Column:
    """Ids may repeat, so a row is known by its id and the digest of its text; a null text counts as an empty one."""
    return F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256)


def _prints(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("shingles", pa.int64()), ("bytes", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            fps, bands, shingles, sizes = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or b""
                words = text.lower().split()
                hashes = simhash.shingle_hashes(words, SHINGLE)
                fps.append(simhash.fingerprint(simhash.shingle_hashes(words, 3)))
                bands.append(band_keys(hashes))
                shingles.append(len(np.unique(hashes)))
                sizes.append(len(text))
            columns = (pa.array(c, f.type) for c, f in zip((fps, bands, shingles, sizes), list(schema)[2:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], schema=schema)

    return identified(docs, _digest(docs).alias("digest")).mapInArrow(run, "doc_id long, digest string, fp long, bands array<bigint>, shingles long, bytes long")


def similarity(a: bytes | None, b: bytes | None) -> float:
    """Jaccard similarity of the five-word shingle sets, A-Z lower-cased; 0 if a text has no word."""

    def runs(text: bytes | None) -> set[bytes]:
        w = (text or b"").lower().split()
        return {b" ".join(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()

    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def _similar(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in stream:
        kept = pa.array([similarity(x.as_py(), y.as_py()) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(kept) for c in batch.columns[:2]], schema=schema)


def _tile(table: pa.Table) -> pa.Table:
    """(a, b): a spanning forest of the similar texts of a tile over the roots that they have."""
    roots, links = table["root"].to_pylist(), []
    if len(set(roots)) > 1:
        sets = [np.unique(simhash.shingle_hashes((t.as_py() or b"").lower().split(), SHINGLE)) for t in table["text"]]
        sizes = np.array([len(x) for x in sets])
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # only shingles of two texts and more; 0 and 1 in float32 add up exactly
        shared, owner = count[code] > 1, np.repeat(np.arange(len(sets)), sizes)[:, None]
        code, owner = (np.cumsum(count > 1) - 1)[code[shared]], owner[shared, 0]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for at in range(0, int((count > 1).sum()), _COLUMNS):
            lo, hi = np.searchsorted(code, (at, at + _COLUMNS))
            held = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
            held[owner[lo:hi], code[lo:hi] - at] = 1
            common += held @ held.T
        number = {r: k for k, r in enumerate(dict.fromkeys(roots))}
        of = np.array([number[r] for r in roots])
        alike = common / np.maximum(sizes[:, None] + sizes - common.astype(np.float64), 1) >= SIMILARITY
        known, up = list(number), list(range(len(number)))

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = k = up[up[k]]
            return k

        for i, j in np.argwhere(np.triu(alike & (of[:, None] != of), 1)).tolist():
            x, y = top(of[i]), top(of[j])
            if x != y:
                up[x] = y
                links.append((known[of[i]], known[of[j]]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _members(firsts: DataFrame) -> DataFrame:
    return firsts.filter("first IS NOT NULL").select("fp", "first", "shingles", "bytes", F.posexplode("bands").alias("band", "key"))


def end_pairs(firsts: DataFrame) -> DataFrame:
    """(a, b): each member of a band's bucket with the bucket's first and last one."""
    members = _members(firsts)
    ends = members.groupBy("band", "key").agg(F.min_by("fp", F.struct("first", "fp")).alias("lo"), F.max_by("fp", F.struct("first", "fp")).alias("hi")).filter("lo <> hi")
    pairs = members.join(ends, ["band", "key"]).select(F.explode(F.array("lo", "hi")).alias("a"), F.col("fp").alias("b")).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose texts are similar enough."""
    left = texts.select(F.col("fp").alias("a"), F.col("text").alias("_s"))
    right = texts.select(F.col("fp").alias("b"), F.col("text").alias("_t"))
    return wanted.join(left, "a").join(right, "b").select("a", "b", "_s", "_t").mapInArrow(_similar, "a long, b long")


def tiles(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, key, level, t, u, fp, root): the members of buckets that `roots(fp, root)` leaves apart, so dealt that any two that
    share a bucket, differ in root and are of like size meet in a tile (t, u).

    Buckets of three have been compared by their ends. Of buckets with the same members one is taken. A level holds the texts of a size
    class and, above them, those of the next one. The members of its largest root, and those above, aren't compared among themselves.
    """
    members = _members(firsts).join(roots, "fp").select("band", "key", "fp", "root", "shingles", "bytes")
    found = members.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), F.expr("bit_xor(fp)").alias("x"), F.expr("bit_xor(xxhash64(fp))").alias("y")
    )
    once = found.filter("n > 3 AND least <> most").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("b")).select("b.band", "b.key")
    group = ["band", "key", "level"]
    level = F.floor(F.log("shingles") / float(np.log(_SIZE_CLASS)))
    both = F.array(F.struct(level.alias("level"), F.lit(0).alias("above")), F.struct((level - 1).alias("level"), F.lit(1).alias("above")))
    dealt = stored(members.join(once, ["band", "key"]).select("band", "key", "fp", "root", "bytes", F.explode(both).alias("_l")).select("*", "_l.*").drop("_l"), "near-open")

    parts = [F.sum(F.when(F.col("above") == k, v).otherwise(0)).alias(f"{c}{k}") for k in (0, 1) for c, v in (("n", F.lit(1)), ("b", F.col("bytes")))]
    by_root = dealt.groupBy(*group, "root").agg(*parts)
    sums = by_root.groupBy(*group).agg(
        F.max(F.struct(F.expr("n0 + n1").alias("n"), "root", "n0", "n1", "b0", "b1")).alias("main"), *(F.sum(c).alias(c) for c in ("n0", "n1", "b0", "b1")), F.count(F.lit(1)).alias("roots")
    ).filter("roots > 1 AND n0 > 0")
    whole = (F.col("n0") + F.col("n1") <= _TILE) & (F.col("b0") + F.col("b1") <= _TILE_BYTES)

    def blocks(n: Column, size: Column) -> Column:
        return F.when(n > 0, F.greatest(F.ceil(n / _TILE), F.ceil(size / _TILE_BYTES))).otherwise(0).cast("long")

    # sections: at the level and apart from the main root, of the main root; above the level likewise
    sections = [(F.col(f"n{k}") - F.col(f"main.n{k}"), F.col(f"b{k}") - F.col(f"main.b{k}")) if apart else (F.col(f"main.n{k}"), F.col(f"main.b{k}")) for k in (0, 1) for apart in (True, False)]
    counts = [F.when(whole, int(s == 0)).otherwise(blocks(*x)).cast("long").alias(f"c{s}") for s, x in enumerate(sections)]
    plan = sums.select(*group, F.col("main.root").alias("main"), whole.alias("whole"), *counts)
    placed = dealt.join(plan, group)
    section = F.when(F.col("whole"), 0).otherwise(2 * F.col("above") + (F.col("root") == F.col("main")).cast("int"))
    starts = [F.lit(0).cast("long"), F.col("c0"), F.col("c0") + F.col("c1"), F.col("c0") + F.col("c1") + F.col("c2")]
    runs = [F.when(F.col(f"c{s}") > 0, F.sequence(starts[s], starts[s] + F.col(f"c{s}") - 1)).otherwise(F.array().cast("array<bigint>")) for s in range(4)]
    partners = F.element_at(F.array(F.concat(*runs), F.concat(runs[0], runs[2]), F.concat(runs[0], runs[1]), runs[0]), F.col("section") + 1)
    own = F.element_at(F.array(*starts), F.col("section") + 1) + F.pmod(F.xxhash64("fp", F.lit(5)), F.element_at(F.array("c0", "c1", "c2", "c3"), F.col("section") + 1))
    placed = placed.withColumn("section", section).select(*group, "fp", "root", own.alias("own"), F.explode(partners).alias("other"))
    return placed.select(*group, F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "fp", "root")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of `docs` from each group: the one with the smallest id, of rows with that id the one with the smallest digest.

    Unlike texts under one id are in groups of their own; of equal texts under one id one row stays. Wordless and null texts form one group.
    Rows without an id can't be told apart later and stay as they are. Texts of any length are hashed in blocks and compared in tiles
    of bounded size; an empty table gives an empty one; other columns, whatever their names, ride along.
    """
    prints = stored(_prints(docs), "near-prints")
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "digest"))
    of_first = [F.min_by(c, row).alias(c) for c in ("bands", "shingles", "bytes")]
    firsts = stored(prints.groupBy("fp").agg(F.min(row).alias("_row"), *of_first).select("fp", F.col("_row.doc_id").alias("first"), F.col("_row.digest").alias("digest"), "bands", "shingles", "bytes"), "near-classes")
    pairs = stored(end_pairs(firsts), "near-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(firsts, "fp").select("fp", F.col("first").alias("doc_id"), "digest")
    texts = stored(identified(docs, _digest(docs).alias("digest")).join(ids, ["doc_id", "digest"]).groupBy("fp").agg(F.min("text").alias("text")), "near-texts")
    edges = stored(simhash.links(firsts.select("fp")).unionByName(verified(pairs, texts)), "near-links")
    joined = connected_components(edges, "a", "b").withColumnsRenamed({"node": "fp", "component": "root"})
    roots = stored(firsts.select("fp", "first", "digest").join(joined, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near-roots")
    met = tiles(firsts, roots.select("fp", "root")).join(texts, "fp")
    more = stored(met.groupBy("band", "key", "level", "t", "u").applyInArrow(_tile, "a long, b long"), "near-more")
    least = roots.filter("first IS NOT NULL").groupBy("root").agg(F.min(F.struct("first", "digest")).alias("row"))
    last = connected_components(more, "a", "b").withColumnsRenamed({"node": "root", "component": "_last"})
    groups = least.join(last, "root", "left").groupBy(F.coalesce("_last", "root").alias("_last")).agg(F.min("row").alias("row"))
    kept = groups.select(F.col("row.first").alias("_kept"), F.col("row.digest").alias("_text"))
    # the whole row is one column, so that no name of `docs` can clash
    rows = docs.select(F.struct("*").alias("_all"), docs["doc_id"].cast("long").alias("_kept"), _digest(docs).alias("_text"))
    chosen = rows.join(kept, ["_kept", "_text"], "left_semi").dropDuplicates(["_kept", "_text"]).select("_all.*")
    return chosen.unionByName(docs.filter(docs["doc_id"].cast("long").isNull()))
