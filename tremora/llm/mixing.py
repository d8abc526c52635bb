"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern: the sources that hold the same text, each with the number of its copies. A flow
routes tokens from patterns to sources: what a source may take of a pattern is bounded by its rows, what it must take by its target,
and each further use of the same content costs more (a convex cost, one arc per doubling of uses). As all costs lie on the arcs out
of the origin, raising the flow to its maximum one cost level after the other is optimal. The contents of a pattern then lie on a circle in
a seeded order, and its sources take arcs of it one after the other, as long as their flows. So every content is used once before
any is used again, whichever source takes it; what a source takes of a content is dealt out evenly to its copies.
"""

from __future__ import annotations

from collections import defaultdict, deque
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremora.llm.common import stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)


def quotas(sizes: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> dict:
    """Target tokens per source: `share` of all tokens by weight, none above `most` times its size, the excess dealt again by weight.

    Sources by code point, null last, have the weights in turn.
    """
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(ordered)}
    limit = {s: most * n for s, n in ordered}
    left, out, open_ = share * sum(n for _, n in ordered), {}, [s for s, _ in ordered]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = limit[s]
            open_.remove(s)
        left -= sum(limit[s] for s in full)
    return out


class Flow:
    """Maximum flow by level graphs and blocking paths on integer capacities."""

    def __init__(self):
        self.to, self.room, self.of = [], [], defaultdict(list)

    def arc(self, a, b, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.of[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)
        return len(self.to) - 2

    def raise_(self, origin, end) -> None:
        while True:
            level, queue = {origin: 0}, deque([origin])
            while queue:
                x = queue.popleft()
                for e in self.of[x]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if end not in level:
                return
            tried = defaultdict(int)
            while self._push(origin, end, level, tried):
                pass

    def _push(self, origin, end, level, tried) -> bool:
        path, x = [], origin
        while x != end:
            arcs = self.of[x]
            while tried[x] < len(arcs):
                e = arcs[tried[x]]
                if self.room[e] and level.get(self.to[e]) == level[x] + 1:
                    break
                tried[x] += 1
            if tried[x] == len(arcs):
                if not path:
                    return False
                x = self.to[path.pop() ^ 1]
                tried[x] += 1
            else:
                path.append(e)
                x = self.to[e]
        least = min(self.room[e] for e in path)
        for e in path:
            self.room[e] -= least
            self.room[e ^ 1] += least
        return True


def route(content: dict, rows: dict, targets: dict, most: int = 2) -> dict:
    """{(pattern, source): tokens} from distinct tokens per pattern, row tokens per (pattern, source) and target per source."""
    flow = Flow()
    for s, target in targets.items():
        flow.arc(("source", s), "end", round(target))
    arcs = {k: flow.arc(("pattern", k[0]), ("source", k[1]), most * n) for k, n in rows.items()}
    held = defaultdict(int)
    for (p, _), n in rows.items():
        held[p] += most * n
    done, uses = 0, 1
    while any(held.values()):
        # uses 1, 2, 3-4, 5-8 ... of each content, each step dearer than all before
        for p in sorted(held):
            step = min(held[p], uses * content[p])
            if step:
                flow.arc("origin", ("pattern", p), step)
            held[p] = held[p] - step if content[p] else 0
        flow.raise_("origin", "end")
        done, uses = done + uses, done + uses
    return {k: flow.room[e ^ 1] for k, e in arcs.items()}


def _uses(contents: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """(digest, code, copies, uses) of contents(digest, pattern, words) by plan(pattern, round, arcs of code, copies, start, stop).

    A content is used by a source as often as the middle of its words falls into the source's arc, round by round.
    """
    placed = contents.withColumn("at", F.xxhash64(F.lit(seed), "digest")).withColumn("bucket", F.shiftrightunsigned("at", 48).cast("int"))
    group = Window.partitionBy("pattern").orderBy("bucket")
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("words").alias("n")).withColumn("before", F.sum("n").over(group) - F.col("n"))  # 65,536 buckets at most in each pattern
    sums = stored(sums.join(plan, "pattern"), "mix-buckets")
    inside = Window.partitionBy("pattern", "bucket").orderBy("at", "digest").rowsBetween(Window.unboundedPreceding, 0)
    # twice the middle, so that it is a whole number
    middle = 2 * (F.col("before") + F.sum("words").over(inside)) - F.col("words")
    laid = placed.join(sums, ["pattern", "bucket"]).withColumn("middle", middle).select("digest", "round", "middle", F.explode("arcs").alias("arc")).select("digest", "round", "middle", "arc.*")
    rounds = lambda end: F.ceil((2 * F.col(end) - F.col("middle")) / (2 * F.col("round")))
    return laid.select("digest", "code", "copies", F.when(F.col("round") > 0, rounds("stop") - rounds("start")).otherwise(0).cast("long").alias("uses"))


def mixed(docs: DataFrame, seed: int = 11, share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, digest, source, size, source_size, target, pattern, times, taken) for each row of `docs`.

    times is how often the mix takes a row (0 to `most`), taken its words with repeats. Null texts and wordless ones have size 0 and are
    not taken; of equal rows some may be taken once more than others. One row per source, and one per pattern, reach the driver.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"),
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("digest"),
    )
    rows = stored(rows, "mix-sizes")
    sizes = [(r["source"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    targets = quotas(sizes, share, most)
    spark = docs.sparkSession
    known = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    sources = spark.createDataFrame([(s, k, n, float(targets[s])) for k, (s, n) in enumerate(known)], "source string, code int, source_size long, target double")
    # one row per source
    coded = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).select("doc_id", rows["source"], "size", "digest", "code", "source_size", "target")
    copies = coded.groupBy("digest", "code").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("words"))
    # one entry per source
    contents = copies.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("code", "copies"))).alias("held"), F.max("words").alias("words"))
    label = F.array_join(F.transform("held", lambda h: F.concat(h["code"].cast("string"), F.lit("x"), h["copies"].cast("string"))), ",")
    contents = stored(contents.select("digest", "words", label.alias("pattern")), "mix-contents")
    content = {r["pattern"]: r["n"] for r in contents.groupBy("pattern").agg(F.sum("words").alias("n")).collect()}
    held = {p: [tuple(map(int, h.split("x"))) for h in p.split(",")] for p in sorted(content)}
    found = route(content, {(p, c): k * content[p] for p, hs in held.items() for c, k in hs}, {k: targets[s] for k, (s, _) in enumerate(known)}, most)
    plan = []
    for p, hs in held.items():
        ends = list(accumulate((found[p, c] for c, _ in hs), initial=0))
        plan.append((p, content[p], [(c, k, a, b) for (c, k), a, b in zip(hs, ends, ends[1:])]))
    plan = spark.createDataFrame(plan, "pattern string, round long, arcs array<struct<code: int, copies: long, start: long, stop: long>>")

    uses = _uses(contents, plan, seed).join(contents.select("digest", "pattern"), "digest")
    dealt = coded.join(uses, ["digest", "code"]).withColumn("passes", F.floor(F.col("uses") / F.col("copies"))).withColumn("rest", F.col("uses") % F.col("copies"))
    at = F.xxhash64(F.lit(seed), "doc_id", "digest", "source")
    dealt = stored(dealt.withColumn("at", at).withColumn("bucket", F.shiftrightunsigned("at", 48).cast("int")), "mix-dealt")
    some = dealt.filter("rest > 0")
    copy = ["digest", "code"]
    before = some.groupBy(*copy, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy(*copy).orderBy("bucket")) - F.col("n")).drop("n")  # 65,536 buckets at most of each content and source
    inside = Window.partitionBy(*copy, "bucket").orderBy("at", "doc_id")
    some = some.join(before, [*copy, "bucket"]).withColumn("extra", (F.col("before") + F.row_number().over(inside) <= F.col("rest")).cast("long")).drop("before")
    picked = dealt.filter("rest = 0").withColumn("extra", F.lit(0).cast("long")).unionByName(some)
    times = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(0).cast("long")
    return picked.select("doc_id", "digest", "source", "size", "source_size", "target", "pattern", times.alias("times")).withColumn("taken", F.col("times") * F.col("size"))


def take(docs: DataFrame, seed: int = 11, share: float = 1.5, most: int = 2) -> DataFrame:
    """The rows of `docs` in the mix, each as often as the mix takes it.

    Null and wordless texts are not taken; an empty table gives an empty one; other columns, whatever their names, ride along.
    """
    plan = mixed(docs, seed, share, most).groupBy("doc_id", "digest", "source").agg(F.sum("times").alias("uses"), F.count(F.lit(1)).alias("equal")).filter("uses > 0")
    # the whole row is one column, so that no name of `docs` can clash
    rows = docs.select(
        F.struct("*").alias("all"), docs["doc_id"].cast("long").alias("own_id"), docs["source"].cast("string").alias("own_source"),
        F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256).alias("own_digest"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_digest") == F.col("digest")) & F.col("own_source").eqNullSafe(F.col("source"))
    joined = rows.join(plan, same).withColumn("passes", F.floor(F.col("uses") / F.col("equal"))).withColumn("rest", F.col("uses") % F.col("equal"))
    # equal rows of which only some are taken, or taken once more
    inside = Window.partitionBy("doc_id", "digest", "source").orderBy(F.xxhash64("all"))
    uneven = joined.filter("rest > 0").withColumn("times", F.col("passes") + (F.row_number().over(inside) <= F.col("rest")).cast("long"))
    timed = joined.filter("rest = 0").withColumn("times", F.col("passes")).unionByName(uneven).filter("times > 0")
    return timed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("all.*")
