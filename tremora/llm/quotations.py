"""Quotation linking in conversations.

Lines that begin with `>` marks are quotes of that many levels. A quoted block, and each of its lines, is a passage: a run of words
without case, spacing and outer punctuation. A passage of n words is named by the hashes of its first and its last 2^k words, 2^k being
the largest power of two up to n, and stands in a message if both windows are there at the right distance. So sentences out of longer
lines and re-wrapped lines are found by equality joins of hashes.

A passage comes from the first earlier message of its conversation that holds it, else from its first occurrence in a smaller
conversation, else from its first one in a larger conversation that itself quotes no other. Passages of under MIN_WORDS words are only
looked up in their own conversation. The longest linked passage of the outermost level names the parent; messages without one follow the
message before them. Conversations that quote each other form a thread, told from those that quote no other one to the rest, each
in order of conversation and turn: every parent comes before its replies. Linked quotes are taken out of the text, others stay in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import small_batches, stored
from tremora.operators.components import connected_components
from tremora.operators.ranking import prefix_sums

_QUOTE = re.compile(r"^[ \t]{0,3}((?:>[ \t]?)+)")
_SAID = re.compile(r"^(?:On|Am|Le|El)\b.*\b(?:wrote|schrieb|écrit|escribió)\b.*:\s*$")
_OUTER = " .,;:!?\"'…()"
MIN_WORDS = 3
#: Lines of a text, their block (-1: own) and what the quote marks leave of them.
Lines = list[tuple[int, str, str | None]]


def read_lines(text: str) -> tuple[Lines, list[int]]:
    """(lines, level of each block); a line that introduces a quote belongs to its block and has no quoted words (None)."""
    lines: Lines = []
    levels: list[int] = []
    for line in text.split("\n"):
        mark = _QUOTE.match(line)
        if not mark:
            lines.append((-1, line, None))
            continue
        level = mark.group(1).count(">")
        if not (lines and lines[-1][0] >= 0 and levels[-1] == level):
            levels.append(level)
            if lines and lines[-1][0] < 0 and _SAID.match(lines[-1][1]):
                lines[-1] = (len(levels) - 1, lines[-1][1], None)
        lines.append((len(levels) - 1, line, line[mark.end() :]))
    return lines, levels


def split_quotes(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """(own text, [(level, lines)] of each quoted block)."""
    lines, levels = read_lines(text)
    own = "\n".join(line for block, line, _ in lines if block < 0).strip("\n")
    return own, [(level, [rest for block, _, rest in lines if block == b and rest is not None]) for b, level in enumerate(levels)]


def without(text: str, blocks: set[int], numbers: set[int]) -> str:
    """`text` without the blocks and the lines of those numbers; an introducing line goes with the last line of its block."""
    lines, _ = read_lines(text)
    stay = [block < 0 or (block not in blocks and at not in numbers) for at, (block, _, _) in enumerate(lines)]
    quoted = {block for s, (block, _, rest) in zip(stay, lines) if s and rest is not None}
    return "\n".join(line for s, (block, line, rest) in zip(stay, lines) if s and (block < 0 or block in quoted)).strip("\n")


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_OUTER) for x in text.lower().split()) if w]


def windows(words: list[str]) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, ... words."""
    found = [np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)]
    while len(words) >= 2 << (len(found) - 1):
        half, h = 1 << (len(found) - 1), found[-1]
        mixed = (h[:-half] * np.uint64(0x9E3779B97F4A7C15) ^ (h[half:] >> np.uint64(29)) ^ (h[half:] << np.uint64(35))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append(mixed ^ (mixed >> np.uint64(32)))
    return found


def passage(words: list[str]) -> dict[str, int]:
    """Power of two k, number of words n and hashes of the first and the last 2^k words."""
    last = windows(words)[-1].view(np.int64)
    return {"k": len(words).bit_length() - 1, "n": len(words), "head": int(last[0]), "tail": int(last[-1])}


_FIELDS = ("block", "line", "level", "k", "n", "head", "tail")
_PARSED = pa.schema([
    ("conv", pa.int64()), ("turn", pa.int64()), ("m", pa.int64()), ("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string()),
    ("n_quotes", pa.int64()), ("deepest", pa.int64()), ("quoted", pa.list_(pa.struct([(f, pa.int64()) for f in _FIELDS]))),
])
_PARSED_DDL = f"conv long, turn long, m long, conv_id long, role string, text string, n_quotes long, deepest long, quoted array<struct<{', '.join(f'{f}: bigint' for f in _FIELDS)}>>"


def passages(text: str) -> list[dict[str, int]]:
    """The passages of all quoted blocks: each block whole (line -1) and, if it has several, each of its lines."""
    lines, levels = read_lines(text)
    held: list[list[tuple[int, list[str]]]] = [[] for _ in levels]
    for at, (block, _, rest) in enumerate(lines):
        if rest is not None:
            held[block].append((at, words_of(rest)))
    found = []
    for b, (level, parts) in enumerate(zip(levels, held)):
        whole = [(-1, [w for _, words in parts for w in words])]
        found += [{"block": b, "line": at, "level": level} | passage(words) for at, words in whole + (parts if len(parts) > 1 else []) if words]
    return found


def _parse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        counts, deepest, quoted = [], [], []
        for text in batch.column(5).to_pylist():
            levels = read_lines(text or "")[1]
            counts.append(len(levels))
            deepest.append(max(levels, default=0))
            quoted.append(passages(text) if levels else [])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip((counts, deepest, quoted), list(_PARSED)[6:]))], schema=_PARSED)


def _said(parsed: DataFrame, powers: list[int]) -> DataFrame:
    """(conv, turn, m, k, at, h): all windows of 2^k own words of each message, k in `powers`."""
    schema = pa.schema([("conv", pa.int64()), ("turn", pa.int64()), ("m", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("h", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for conv, turn, m, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = windows(words_of(split_quotes(text)[0]))
                for k in powers:
                    if k < len(found) and len(found[k]):
                        n = len(found[k])
                        same = [np.full(n, v, dtype=np.int64) for v in (conv, turn, m, k)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, same), pa.array(np.arange(n)), pa.array(found[k].view(np.int64))], schema=schema)

    texts = parsed.filter("text IS NOT NULL").select("conv", "turn", "m", "text")
    return texts.mapInArrow(run, "conv long, turn long, m long, k long, at long, h long")


def _standing(keys: DataFrame, said: DataFrame) -> DataFrame:
    """(k, n, head, tail, conv, turn): the messages in which a passage stands."""
    ends = keys.select("k", F.explode(F.array("head", "tail")).alias("h")).distinct()
    said = stored(said.join(ends, ["k", "h"], "left_semi"), "quotes-windows")
    heads = said.withColumnRenamed("h", "head").join(keys, ["k", "head"])
    heads = heads.withColumn("at", F.expr("at + n - shiftleft(1L, int(k))"))
    return heads.join(said.withColumnRenamed("h", "tail"), ["conv", "turn", "m", "k", "at", "tail"]).select("k", "n", "head", "tail", "conv", "turn").distinct()


def _rebuilt(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        texts = [
            None if text is None else without(text, {d["block"] for d in done or () if d["line"] < 0}, {d["line"] for d in done or () if d["line"] >= 0})
            for text, done in zip(batch.column("text").to_pylist(), batch.column("done").to_pylist())
        ]
        kept = [c for c in batch.schema.names if c not in ("text", "done")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "own"])


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, thread_id, position, parent_conv, parent_turn, n_quotes, deepest, text) for each message.

    parent_conv and parent_turn are null for messages that quote nothing known; they follow the message at the position before. A null
    conv_id counts as one conversation, a null turn as the first one; null texts quote nothing and stay null. Of equal rows each has
    its position. An empty table gives an empty one; other columns are not read. Texts of any length are hashed one by one.
    """
    text = F.col("text").cast("string")
    keyed = small_batches(messages).select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(-(2**63))).alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.xxhash64(text).alias("m"), F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), text.alias("text"),
    )
    parsed = stored(keyed.mapInArrow(_parse, _PARSED_DDL), "quotes-parsed")
    row, key = ["conv", "turn", "m"], ["k", "n", "head", "tail"]
    quotes = parsed.select(*row, F.explode("quoted").alias("q")).select(*row, "q.*").distinct()
    keys = stored(quotes.select(*key).distinct(), "quotes-keys")
    # powers of two up to the longest quote: a few dozen at most
    powers = sorted(r["k"] for r in keys.select("k").distinct().collect())
    standing = stored(_standing(keys, _said(parsed, powers)), "quotes-standing")

    # one row per passage (and conversation), so a frequent line never pairs with all that quote it
    place = F.struct("conv", "turn")
    near = standing.groupBy("conv", *key).agg(F.min("turn").alias("near_turn"))
    far = standing.groupBy(*key).agg(F.min(place).alias("far"), F.max("conv").alias("most"))
    found = quotes.join(near, ["conv", *key], "left").join(far, key, "left")
    here = F.when(F.col("near_turn") < F.col("turn"), F.struct("conv", F.col("near_turn").alias("turn")))
    found = stored(found.withColumn("here", here), "quotes-found")
    crossing = found.filter(F.col("here").isNull() & (F.col("n") >= MIN_WORDS) & ((F.col("far.conv") < F.col("conv")) | (F.col("most") > F.col("conv")))).select("conv").distinct()
    later = standing.join(crossing, "conv", "left_anti").groupBy(*key).agg(F.min(place).alias("root"))
    other = F.when(F.col("far.conv") < F.col("conv"), F.col("far")).when(F.col("root.conv") > F.col("conv"), F.col("root"))
    found = found.join(later, key, "left").withColumn("parent", F.coalesce("here", F.when(F.col("n") >= MIN_WORDS, other))).filter("parent IS NOT NULL")
    best = found.groupBy(*row).agg(F.min_by("parent", F.struct("level", (-F.col("n")).alias("n"), "parent")).alias("parent"), F.collect_set(F.struct("block", "line")).alias("done"))
    best = stored(best, "quotes-parents")

    across = best.select("conv", F.col("parent.conv").alias("other")).filter("conv <> other").distinct()
    threads = connected_components(across, "conv", "other").withColumnsRenamed({"node": "conv", "component": "thread"})
    rows = parsed.drop("quoted").join(best, row, "left").join(threads, "conv", "left").withColumn("thread", F.coalesce("thread", "conv"))
    rows = rows.join(crossing.withColumn("quotes_others", F.lit(1)), "conv", "left").withColumn("quotes_others", F.coalesce("quotes_others", F.lit(0))).withColumn("one", F.lit(1))
    rows = rows.withColumns({"parent_conv": F.col("parent.conv"), "parent_turn": F.col("parent.turn")}).drop("parent", "m")
    kept = [(c, t) for c, t in rows.dtypes if c not in ("text", "done")]
    rows = stored(rows.mapInArrow(_rebuilt, ", ".join(f"{c} {t}" for c, t in [*kept, ("own", "string")])), "quotes-rebuilt")
    placed = prefix_sums(rows, ["thread"], ["quotes_others", "conv", "turn", "role", "own"], {"position": "one"})
    real = lambda c: F.when(F.col(c) != -(2**63), F.col(c))
    return placed.select(
        "conv_id", real("turn").alias("turn"), "role", real("thread").alias("thread_id"), F.col("position").cast("long").alias("position"),
        real("parent_conv").alias("parent_conv"), real("parent_turn").alias("parent_turn"), "n_quotes", "deepest", F.col("own").alias("text"),
    )
