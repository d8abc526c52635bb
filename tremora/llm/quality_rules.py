"""Weak supervision of document quality.

Each rule votes good (+1), bad (-1) or abstains (0). The votes of all documents are counted by pattern, at most
3 ** len(RULES) of them; expectation-maximisation over these counts estimates how often each rule is right on good
and on bad documents and the share of good ones. A document is kept if its posterior probability of being good
reaches the threshold; base limits that need no statistics come before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, small_batches, stored

WINDOW = 5
SYMBOLS = b"[#*$%&|<>]"[1:-1]
#: Frequent words of the four languages; running text without any is a list or a table.
COMMON = frozenset("the of and to in is that for it with de la le les et des que el en y los se die der und das ist nicht ein von den zu".encode().split())
STOPS = (b".", b"!", b"?", b":", b";", b'"', b"\xe2\x80\xa6")

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_common", "n_lettered", "n_ended")
FEATURES = BASE + MORE


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words covered by windows of `size` words that occur twice or more in the text, the first one included.

    Windows are compared by a rolling product first; those with equal products are compared word by word.
    """
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    mixed ^= mixed >> np.uint64(29)
    product = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        product = product * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(product, kind="stable")
    same = product[order][1:] == product[order][:-1]
    if not same.any():
        return 0
    at = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
    _, inverse, counts = np.unique(ids[at[:, None] + np.arange(size)], axis=0, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = at[counts[inverse.ravel()] > 1]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """FEATURES of one text."""
    words = text.split()
    joined = b"".join(words)
    continued = len(joined) - len(joined.translate(None, bytes(range(0x80, 0xC0))))
    lines = [x for x in text.split(b"\n") if x.split()]
    ended = sum(x.rstrip().endswith(STOPS) for x in lines)
    lettered = sum(w[:1].isalpha() or w[0] >= 0x80 for w in words)
    return (
        len(words), len(joined) - continued, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words),
        len(lines), sum(w in COMMON for w in text.lower().split()), lettered, ended,
    )


def _vote(value: float, good: float, bad: float) -> int:
    """Below `good` speaks for the document and above `bad` against it (the other way round if good > bad)."""
    if good <= bad:
        return 1 if value <= good else -1 if value > bad else 0
    return 1 if value >= good else -1 if value < bad else 0


#: name, (numerator, denominator), limit for a good vote, limit for a bad vote
RULES = (
    ("length", ("n_words", None), 50, 10),
    ("long_words", ("word_chars", "n_words"), 10, 14),
    ("symbols", ("n_symbols", "n_words"), 0.02, 0.10),
    ("repeated_lines", ("n_dup_lines", "n_lines"), 0.10, 0.30),
    ("repeated_words", ("n_repeat_words", "n_words"), 0.05, 0.20),
    ("common_words", ("n_common", "n_words"), 0.10, 0.02),
    ("lettered_words", ("n_lettered", "n_words"), 0.85, 0.70),
    ("ended_lines", ("n_ended", "n_lines"), 0.50, 0.10),
)


def votes(features: tuple[int, ...]) -> tuple[int, ...]:
    by = dict(zip(FEATURES, features))
    return tuple(_vote(by[a] / max(by[b], 1) if b else by[a], good, bad) for _, (a, b), good, bad in RULES)


def pattern(found: tuple[int, ...]) -> int:
    """Votes as one number of base three."""
    return sum((v + 1) * 3**k for k, v in enumerate(found))


def base_failed(features: tuple[int, ...]) -> bool:
    n, repeated = features[0], features[4]
    return n < 10 or 100 * repeated > 20 * n


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-10) -> dict:
    """Expectation-maximisation on vote counts by pattern.

    Returns prior, right[class, rule] (share of right votes among those cast) and posterior per pattern. No vote may speak
    against its own claim (right on bad documents at least as often as wrong on good ones), which fixes which class is the
    good one; a rule that votes alike on both weighs nothing. Without rows the start values stay.
    """
    cast = (patterns[:, None] // 3 ** np.arange(len(RULES))) % 3 - 1
    prior, right = 0.7, np.full((2, len(RULES)), 0.8)
    good_vote, bad_vote = (cast == 1).astype(float), (cast == -1).astype(float)
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        if_good = np.log(prior) + good_vote @ np.log(right[1]) + bad_vote @ np.log(1 - right[1])
        if_bad = np.log(1 - prior) + bad_vote @ np.log(right[0]) + good_vote @ np.log(1 - right[0])
        posterior = 1 / (1 + np.exp(np.clip(if_bad - if_good, -700, 700)))
        if not len(counts):
            break
        g, b = counts * posterior, counts * (1 - posterior)
        told = np.stack([(b @ bad_vote + 4) / (b @ (good_vote + bad_vote) + 5), (g @ good_vote + 4) / (g @ (good_vote + bad_vote) + 5)])
        told = np.clip(told, 0.005, 0.995)
        told[0] = np.maximum(told[0], 1 - told[1])
        new = told, float(np.clip(g.sum() / counts.sum(), 0.02, 0.98))
        moved = max(np.abs(new[0] - right).max(), abs(new[1] - prior))
        right, prior = new
        if moved < tolerance:
            break
    return {"prior": prior, "right": right, "posterior": dict(zip(patterns.tolist(), posterior.tolist()))}


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f, pa.int64()) for f in FEATURES), ("base_failed", pa.bool_()), ("pattern", pa.int32())])
_DDL = "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES) + ", base_failed boolean, pattern int"


def _measured(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = [measure(t.as_py() or b"") for t in batch.column(1)]
        columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(FEATURES)
        failed = pa.array([base_failed(r) for r in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns, failed, pa.array([pattern(votes(r)) for r in rows], pa.int32())], schema=_SCHEMA)


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: its features, base verdict and vote pattern. Null text counts as empty."""
    return identified(docs).mapInArrow(_measured, _DDL)


def fit(rows: DataFrame) -> dict:
    """The model from the vote patterns of all rows; what reaches the driver is one count per pattern (3 ** 8 at most)."""
    found = rows.groupBy("pattern").count().orderBy("pattern").collect()
    return estimate(np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float))


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """FEATURES, base_failed, posterior and kept for each row of `docs`; ties at the threshold are kept."""
    rows = stored(measured(docs), "quality-features")
    posterior = fit(rows)["posterior"]
    known = docs.sparkSession.createDataFrame([*posterior.items()], "pattern int, posterior double")
    # 3 ** 8 rows at most
    return rows.join(F.broadcast(known), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of `docs` that pass; texts stay where they are, the model goes to them in a second pass."""
    posterior = fit(measured(docs))["posterior"]

    def passed(text: bytes | None) -> bool:
        found = measure(text or b"")
        return not base_failed(found) and posterior[pattern(votes(found))] >= threshold

    names = docs.columns

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in stream:
            texts = batch.column(at)
            yield batch.filter(pa.array([passed(None if t.as_py() is None else t.as_py().encode()) for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
