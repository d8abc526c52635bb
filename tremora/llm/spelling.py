"""Spelling variants: pairs of words one edit apart by composing finite-state machines.

The vocabulary is an acceptor A; E is the transducer that copies a word but for one inserted, deleted or replaced code point.
A o E o A accepts exactly the near pairs. In its states (p, edits so far, q) the two acceptor states are the same until
the edit, so a partition of the composition is named by the state of A that its words have in common:

* forward: the state after the first `HEAD` code points, for pairs that share these;
* backward: the state of the reversed acceptor after the last `HEAD` ones, for pairs whose edit is among the first `HEAD`.

Each pair lies in one partition only. A task builds the minimal acceptor of one partition's words and lists the accepted pairs. Where more than
`LIMIT` words share a state, and for long words, the partition is split exactly: for words of length L and L + 1 that agree outside
code points [low, high) of the shorter one, the pairs either agree up to the middle of that range or from it on, so each half is a
partition again, with fewer words. That ends when one code point is left, hence no partition outgrows a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, stored

# Fixed values of the task.
SHORTEST, LEAST, NOISE, RATIO = 6, 5, 199, 5

HEAD = 3  # at most half of the shortest word
LIMIT = 8000  # words of a partition
LONG = 64  # pairs whose shorter word has as many code points are split by range at once
_FLUSH = 200_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % SHORTEST)
_FORWARD, _BACKWARD, _RANGE = 0, 1, 2


# -- words -----------------------------------------------------------------------------------------------------------


def words_of(doc_id: int | None, text: bytes | None) -> dict[str, int]:
    """Words of one text with their numbers; runs shorter than a word are left out."""
    found: dict[str, int] = {}
    prefix = zlib.crc32(b"%s:" % (b"" if doc_id is None else b"%d" % doc_id))
    for run, n in Counter(_RUN.findall((text or b"").translate(_LOWER).decode("utf-8", "replace"))).items():
        h = zlib.crc32(run.encode(), prefix)
        if not h % NOISE:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < SHORTEST:
                continue
        found[run] = found.get(run, 0) + n
    return found


def _counted(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        held.clear()
        return out

    for rows in stream:
        for i, text in zip(rows.column(0), rows.column(1)):
            held.update(words_of(i.as_py(), text.as_py()))
            if len(held) > _FLUSH:
                yield batch()
    if held:
        yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words with `LEAST` occurrences at least in all texts; counted in the tasks before the shuffle."""
    return identified(docs).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


# -- machines --------------------------------------------------------------------------------------------------------


class Acceptor:
    """The minimal deterministic acceptor of distinct words in ascending order.

    States are numbers; `arcs[p]` maps a code point to a state, `final[p]` says whether a word ends there, `nearest[p]` is the
    length of the shortest rest.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.nearest: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[list, dict[str, int]]] = [([False], {})]
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                (final,), arcs = open_.pop()
                key = (final, *arcs.items())
                if key not in known:
                    known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                    self.nearest.append(0 if final else 1 + min(self.nearest[q] for q in arcs.values()))
                open_[-1][1][last[len(open_) - 1]] = known[key]

        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            close(shared)
            open_.extend(([False], {}) for _ in word[shared:])
            open_[-1][0][0] = True
            last = word
        close(0)
        (final,), arcs = open_[0]
        self.start = len(self.arcs)
        self.arcs.append(arcs)
        self.final.append(final)
        self.nearest.append(0)


class OneEdit:
    """Pairs that the composition of an acceptor, the one-edit transducer and the acceptor again accepts.

    `reach`: only edits that leave a shortest rest of so many code points at most, None for all.
    """

    def __init__(self, acceptor: Acceptor, reach: int | None = None):
        self.a, self.reach = acceptor, reach
        self.shared: dict[tuple[int, int], list[str]] = {}
        self.edits: dict[int, list[tuple[str, str]]] = {}

    def both(self, p: int, q: int) -> list[str]:
        """Rests accepted from p and from q: what follows the edit."""
        key = (p, q) if p <= q else (q, p)
        found = self.shared.get(key)
        if found is None:
            left, right = self.a.arcs[p], self.a.arcs[q]
            found = [""] if self.a.final[p] and self.a.final[q] else []
            for c in left.keys() & right.keys():
                found += [c + rest for rest in self.both(left[c], right[c])]
            self.shared[key] = found
        return found

    def here(self, p: int) -> list[tuple[str, str]]:
        """Pairs of rests from p whose edit comes first: (longer or lesser one, other one)."""
        found = self.edits.get(p)
        if found is None:
            found = []
            if self.reach is None or self.a.nearest[p] <= self.reach:
                arcs = sorted(self.a.arcs[p].items())
                for k, (x, to) in enumerate(arcs):
                    for y, other in arcs[k + 1 :]:
                        found += [(x + rest, y + rest) for rest in self.both(to, other)]
                    # of equal neighbours the last is the deleted one, so that a pair is accepted once
                    found += [(x + rest, rest) for rest in self.both(to, p) if rest[:1] != x]
            self.edits[p] = found
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        held = [(self.a.start, "")]
        while held:
            p, before = held.pop()
            for u, v in self.here(p):
                yield before + u, before + v
            held += [(q, before + c) for c, q in self.a.arcs[p].items()]


# -- partitions ------------------------------------------------------------------------------------------------------

_FIELDS = ("kind", "size", "low", "high", "word", "n")


def _near(long: int, kind: int, size: int, low: int, high: int, words: dict[str, int]) -> Iterator[tuple[str, str]]:
    """Near pairs (longer or lesser word, other word) of one partition that no other partition has."""
    if kind == _RANGE:
        # size: length of the shorter word; equal lengths are paired where they are the shorter one
        some = next(iter(words))
        before, after = some[:low], some[len(some) - (size - high) :]
        for u, v in OneEdit(Acceptor(sorted(w[low : len(w) - (size - high)] for w in words))).pairs():
            if len(v) == high - low and (len(u) == len(v) or high == size or not u.startswith(v)):
                yield before + u + after, before + v + after
    elif kind == _FORWARD:
        head = next(iter(words))[:HEAD]
        for u, v in OneEdit(Acceptor(sorted(w[HEAD:] for w in words))).pairs():
            if len(v) + HEAD < long:
                yield head + u, head + v
    else:
        tail = next(iter(words))[-HEAD:]
        for u, v in OneEdit(Acceptor(sorted(w[-HEAD - 1 :: -1] for w in words)), HEAD).pairs():
            u, v = u[::-1] + tail, v[::-1] + tail
            if len(v) < long and u[:HEAD] != v[:HEAD]:
                yield u, v


def _neighbours(stream: Iterator[pa.RecordBatch], long: int) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best n, best word) of each word in each partition; the rows come sorted by partition."""

    def results(head: tuple, words: dict[str, int], out: list) -> None:
        near: dict[str, list] = defaultdict(lambda: [0, (0, "")])
        for u, v in _near(long, *head, words):
            for a, b in ((u, v), (v, u)):
                row, found = near[a], (-words[b], b)
                row[0] += 1
                row[1] = min(row[1], found)
        out += [(w, k, -best[0], best[1]) for w, (k, best) in near.items()]

    def batch(out: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["word", "n_near", "best_n", "best"])

    key, head, words, out = None, (), {}, []
    for rows in stream:
        keys, *fields = (c.to_pylist() for c in rows.columns)
        for k, row in zip(keys, zip(*fields)):
            if k != key:
                if len(words) > 1:
                    results(head, words, out)
                    if len(out) > 20_000:
                        yield batch(out)
                        out = []
                key, head, words = k, row[:4], {}
            words[row[4]] = row[5]
    if len(words) > 1:
        results(head, words, out)
    if out:
        yield batch(out)


def _partitioned(rows: DataFrame) -> DataFrame:
    """With `part`, the name of the partition: kind, range and what its words share."""
    size, low, high = F.col("size"), F.col("low"), F.col("high")
    shared = F.when(F.col("kind") == _FORWARD, F.substring("word", 1, HEAD)).when(F.col("kind") == _BACKWARD, F.substring("word", -HEAD, HEAD)).otherwise(
        F.concat(F.expr("substring(word, 1, low)"), F.lit("/"), F.expr("CASE WHEN size > high THEN right(word, size - high) ELSE '' END"))
    )
    return rows.withColumn("part", F.concat_ws(":", "kind", size, low, high, shared))


def _spread(words: DataFrame) -> DataFrame:
    """Words in their first partitions."""

    def entry(kind: int, size: Column, high: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), size.cast("int").alias("size"), F.lit(0).alias("low"), high.cast("int").alias("high")))

    length = F.char_length("word")
    entries = [entry(k, F.lit(0), F.lit(0), length <= LONG) for k in (_FORWARD, _BACKWARD)]
    entries += [entry(_RANGE, s, s, s >= LONG) for s in (length, length - 1)]
    return words.select(F.explode(F.array_compact(F.array(*entries))).alias("e"), "word", "n").select("e.*", "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """The rows of partitions that are too large, in two halves each; words of all lengths first part by length."""
    length = F.char_length("word")
    ranged = F.array(F.struct("size", "low", "high"))

    def role(size: Column) -> Column:
        low = F.when(F.col("kind") == _FORWARD, HEAD).otherwise(0).cast("int")
        high = F.when(F.col("kind") == _FORWARD, size).otherwise(HEAD).cast("int")
        return F.when((size >= SHORTEST) & (size < LONG), F.struct(size.cast("int").alias("size"), low.alias("low"), high.alias("high")))

    roles = F.when(F.col("kind") == _RANGE, ranged).otherwise(F.array_compact(F.array(role(length), role(length - 1))))
    middle = F.ceil((F.col("r.low") + F.col("r.high")) / 2).cast("int")
    halves = [F.struct(F.col("r.low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("r.high").alias("high"))]
    cut = F.when(F.col("r.high") - F.col("r.low") > 1, F.array(*halves)).otherwise(F.array(F.struct("r.low", "r.high")))
    placed = rows.withColumn("r", F.explode(roles)).withColumn("s", F.explode(cut))
    return placed.select(F.lit(_RANGE).alias("kind"), F.col("r.size").alias("size"), "s.low", "s.high", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words in `words` (word, n; distinct, of `SHORTEST` code points or more) that have near words."""
    ready, rest = [], _partitioned(_spread(words))
    while True:
        sizes = rest.groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.any_value(F.col("kind") == _RANGE).alias("ranged"), F.any_value(F.col("high") - F.col("low")).alias("width"))
        # a range of one code point holds a few words per letter at most
        wide = (F.col("members") > 1) & ~(F.col("ranged") & (F.col("width") <= 1)) & ((F.col("members") > LIMIT) | (F.col("width") > LONG))
        crowded = stored(sizes.filter(wide).select("part"), "crowded")
        if crowded.isEmpty():
            ready.append(rest)
            break
        ready.append(rest.join(crowded, "part", "left_anti"))
        rest = _partitioned(stored(_halved(rest.join(crowded, "part", "left_semi")), "halved"))
    whole = ready[0]
    for more in ready[1:]:
        whole = whole.unionByName(more)
    sorted_ = whole.select("part", *_FIELDS).repartition("part").sortWithinPartitions("part")
    near = sorted_.mapInArrow(partial(_neighbours, long=LONG), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Counts grow fivefold with each step, so doubling ends after a few rounds."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(reached.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        reached = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return reached


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of the whole texts of `docs` (doc_id, text).

    Null and empty texts have no words; a null id counts as an empty one in the digest; equal rows count as often as they occur; an empty
    table gives no rows; other columns are not read. Texts may be of any length; a word of L > 64 letters takes up about L / 32 rows while
    it is compared.
    """
    words = stored(vocabulary(docs), "words")
    near = stored(neighbours(words), "near")
    clear = F.col("best_n") >= RATIO * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best")).alias("form"), F.when(clear, F.col("best_n")).alias("form_n")
    )
    judged = stored(judged, "forms")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
