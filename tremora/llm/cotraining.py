"""Quality by co-training: a classifier of texts and one of page metadata teach each other.

Both are logistic models over sparse features. Each round both are fitted, calibrated on labelled rows that they have not
seen, and applied to all unlabelled documents; rows of which one is confident become labelled rows of the other. At the end
a small logistic model over both calibrated views scores all documents. Features of all documents are computed once
and stored; models are fitted on the driver from a bounded sample of labelled rows (`labelled`, and `pseudo` per round, view and label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, stored

DIMENSIONS = 1 << 15
PLAIN = DIMENSIONS - 512  # words fill the buckets below, properties of the text the others
CONFIDENT = 0.95


class Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) % PLAIN
        return value


def _level(share: float, steps: tuple[float, ...]) -> int:
    return sum(share > s for s in steps)


def text_features(text: bytes, known: Buckets) -> np.ndarray:
    """Distinct buckets of words (A-Z lower-cased, closing punctuation aside) and of properties of the text."""
    words = [w.strip(b".,;:!?\"'()") for w in text.lower().split()]
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(text))
    shares = (
        len(words).bit_length(), _level(sum(map(len, words)) / n, (2, 4, 6, 8, 12, 20)),
        _level((len(text) - len(text.translate(None, b"#*$%&|<>"))) / n, (0, 0.01, 0.05, 0.2, 0.5)),
        _level(1 - len(set(lines)) / max(1, len(lines)), (0, 0.1, 0.3, 0.6)), _level(1 - len(set(words)) / n, (0.2, 0.4, 0.6, 0.8)),
        _level((len(text) - len(text.translate(None, b"0123456789"))) / size, (0, 0.02, 0.1, 0.3)),
        _level((len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / size, (0.01, 0.05, 0.2, 0.5)),
        _level(sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)), (0, 0.3, 0.7)), _level(len(lines) / n, (0.01, 0.05, 0.2)),
    )
    plain = [PLAIN + 48 * k + min(v, 47) for k, v in enumerate(shares)]
    return np.unique(np.array([*map(known.__getitem__, words), *plain], dtype=np.uint16))


def metadata(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, meta): buckets of language, source, size and of the page that a document was taken from, if there is one."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = lambda c: F.floor(F.log2(c + 1))
    page = pages.select(
        F.col("page_id").cast("long").alias("doc_id"), F.col("url").cast("string").alias("url"), size(F.length(html)).alias("html"),
        size(F.regexp_count(html, F.lit("(?i)<a[ >]"))).alias("links"), size(F.regexp_count(html, F.lit("(?i)<(p|br|li|td)[ >/]"))).alias("parts"),
    ).groupBy("doc_id").agg(F.min("url").alias("url"), F.max("html").alias("html"), F.max("links").alias("links"), F.max("parts").alias("parts"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "n_chars").join(page, "doc_id", "left")
    domain = F.regexp_extract("url", "://(?:[^/?#]*[.])?([^/?#.]+[.][^/?#.]+)", 1)
    said = [F.concat(F.lit(f"{k}="), F.coalesce(c.cast("string"), F.lit("-"))) for k, c in {
        "lang": F.col("lang"), "source": F.col("source"), "chars": F.floor(2 * F.log2(F.greatest("n_chars", F.lit(0)) + 1)), "domain": domain, "host": F.regexp_extract("url", "://([^/?#]*)", 1),
        "first": F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1), "query": F.instr("url", "?") > 0, "html": F.col("html"), "links": F.col("links"), "parts": F.col("parts"),
        "dense": F.floor(4 * F.log2((F.col("n_chars") + 1) / (F.pow(2, "html") + 1))),
    }.items()]
    return rows.select("doc_id", F.transform(F.array(*said), lambda s: F.pmod(F.xxhash64(s), F.lit(DIMENSIONS)).cast("int")).alias("meta"))


def _text_rows(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("words", pa.binary())])
    known = Buckets()
    for batch in stream:
        made = [text_features(t.as_py() or b"", known).tobytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(made, pa.binary())], schema=schema)


def features(docs: DataFrame, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, words, meta, good): both views and the label, null where unknown; h orders rows by a hash for samples.

    Null texts are empty; rows of one id share metadata and label. All joins happen here, once.
    """
    rows = identified(docs, F.xxhash64("doc_id", "text").alias("h")).select("doc_id", "h", "text")
    truth = labels.filter("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").cast("int").alias("good"))
    known = metadata(docs, pages).groupBy("doc_id").agg(F.first("meta").alias("meta")).join(truth, "doc_id", "left")
    found = rows.mapInArrow(_text_rows, "doc_id long, h long, words binary")
    return stored(found.join(known, "doc_id", "left").withColumn("meta", F.coalesce("meta", F.array().cast("array<int>"))), "views")


@dataclass
class Model:
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=self.weights[np.concatenate(rows)] if len(rows) else None, minlength=len(rows))
        return self.bias + sums / np.sqrt(np.maximum(sizes, 1))

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.raw(rows) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def fit(rows: list[np.ndarray], y: np.ndarray, start: Model | None = None, steps: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Logistic model by full gradient steps of adapted size."""
    w, b = (start.weights.copy(), start.bias) if start else (np.zeros(DIMENSIONS), 0.0)
    sizes = np.array([len(r) for r in rows])
    at, row = np.concatenate(rows).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)
    scale = 1 / np.sqrt(np.maximum(sizes, 1))
    m, v = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    for k in range(1, steps + 1):
        error = (sigmoid(b + np.bincount(row, weights=w[at], minlength=len(rows)) * scale) - y) / len(rows)
        g = np.concatenate((np.bincount(at, weights=(error * scale)[row], minlength=DIMENSIONS) + decay * w / 10, [error.sum()]))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(w, b)


def plane(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients (constant first) of a logistic model of few columns, by Newton steps."""
    x, w = np.column_stack((np.ones(len(x)), x)), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = sigmoid(x @ w)
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


def calibrated(model: Model, rows: list[np.ndarray], y: np.ndarray) -> Model:
    if len(y):
        model.shift, model.slope = plane(model.raw(rows)[:, None], y)
    return model


def _views(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(b, np.uint16) for b in batch.column("words").to_pylist()], [np.array(m, dtype=np.int64) for m in batch.column("meta").to_pylist()]


def _confident(text: Model, meta: Model):
    """Rows with the label that each view is confident of (null where it is not)."""
    schema = pa.schema([("h", pa.int64()), ("words", pa.binary()), ("meta", pa.list_(pa.int32())), ("by_text", pa.int32()), ("by_meta", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                told = [[1 if x >= CONFIDENT else 0 if x <= 1 - CONFIDENT else None for x in model.probability(view)] for model, view in zip((text, meta), _views(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("words"), batch.column("meta").cast(schema.field(2).type), *(pa.array(t, pa.int32()) for t in told)], schema=schema)

    return run


def train(views: DataFrame, rounds: int = 3, labelled: int = 8000, pseudo: int = 1000) -> tuple[Model, Model, np.ndarray] | None:
    """Both models and the coefficients of their combination; None if the labels are not of two kinds."""
    known = views.filter("good IS NOT NULL").orderBy("h", "doc_id").limit(labelled).select("h", "words", "meta", "good").collect()
    words = [np.frombuffer(bytes(r["words"]), np.uint16) for r in known]
    metas = [np.array(r["meta"], dtype=np.int64) for r in known]
    y = np.array([float(r["good"]) for r in known])
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return None
    held = np.arange(len(y)) % 4 == 0  # for calibration and combination
    pick = lambda rows, mask: [r for r, m in zip(rows, mask) if m]
    sets = {"text": (pick(words, ~held), y[~held]), "meta": (pick(metas, ~held), y[~held])}
    models: dict[str, Model | None] = {"text": None, "meta": None}
    free = views.filter("good IS NULL")
    for k in range(rounds + 1):
        for name, view in (("text", words), ("meta", metas)):
            rows, target = sets[name]
            models[name] = calibrated(fit(rows, target, models[name], 150 if k == 0 else 60), pick(view, held), y[held])
        if k == rounds:
            break
        sure = free.mapInArrow(_confident(models["text"], models["meta"]), "h long, words binary, meta array<int>, by_text int, by_meta int")
        for teacher, pupil, column in (("text", "meta", "by_text"), ("meta", "text", "by_meta")):
            for label in (0, 1):
                # other rows each round: the samples follow on each other in hash order
                some = sure.filter(F.col(column) == label).orderBy(F.xxhash64("h", F.lit(k))).limit(pseudo).collect()
                rows, target = sets[pupil]
                new = [np.frombuffer(bytes(r["words"]), np.uint16) if pupil == "text" else np.array(r["meta"], dtype=np.int64) for r in some]
                sets[pupil] = (rows + new, np.concatenate((target, np.full(len(new), float(label)))))
    both = np.column_stack([logit(models[n].probability(pick(v, held))) for n, v in (("text", words), ("meta", metas))])
    return models["text"], models["meta"], plane(both, y[held])


def _scored(found: tuple[Model, Model, np.ndarray]):
    text, meta, join = found
    schema = pa.schema([("doc_id", pa.int64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("score", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                a, b = (m.probability(v) for m, v in zip((text, meta), _views(batch)))
                score = sigmoid(join[0] + join[1] * logit(a) + join[2] * logit(b))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a), pa.array(b), pa.array(score)], schema=schema)

    return run


def scored(docs: DataFrame, pages: DataFrame, labels: DataFrame, threshold: float = 0.5, **limits: int) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for each row of `docs`; labels(doc_id, good) teach.

    Of contradictory labels of a document the worse counts, null ones don't. Without labels of two kinds nothing can be learnt: scores
    are null and all rows are kept.
    """
    views = features(docs, pages, labels)
    found = train(views, **limits)
    if found is None:
        empty = F.lit(None).cast("double")
        return views.select("doc_id", empty.alias("text_score"), empty.alias("meta_score"), empty.alias("score"), F.lit(True).alias("kept"))
    return views.mapInArrow(_scored(found), "doc_id long, text_score double, meta_score double, score double").withColumn("kept", F.col("score") >= threshold)
