"""Operators on documents against brute force, with the awkward rows that every operator must stand."""

import collections
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tremora.llm import cotraining, decontaminate, mixing, near_copies, quality_rules, simhash, substrings, surrogates, token_planes
from tremora.llm.fm_index import FMIndex, suffix_order
from tremora.llm.queries import tokenizer_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, k1 int, fp string, words string, count int"


def rows_of(seed=5, n=40):
    """Prose with shared passages, copies, null and empty cells, odd white space and equal rows."""
    r = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and", "É", "naïve", "x\u00a0y", "ß"]
    passage = " ".join(r.choice(vocabulary, 60))
    out = []
    for k in range(n):
        words = list(r.choice(vocabulary, int(r.integers(20, 160))))
        text = " ".join(words) + (".\n" if k % 3 else " ")
        if k % 4 == 0:
            text = text + passage + "\t" + " ".join(r.choice(vocabulary, 10))
        out.append([k, text, ["en", "fr", None][k % 3], [f"s{k % 3}", None][k % 7 == 6], len(text)])
    out += [[100, out[1][1], "en", "s1", 3], [101, out[1][1], "fr", "s2", 3], [3, out[3][1], out[3][2], out[3][3], out[3][4]]]
    out += [[102, None, None, None, None], [103, "", "en", "s0", 0], [104, " \n\t ", None, "s0", 4], [None, "one two three", "en", "s1", None], [105, "one", "en", "s9", 3], [106, "a b " * 4000, "en", "s1", 16000]]
    return [tuple(x) + (1, "c", "w", 2) for x in out]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return WORD.findall((text or "").encode())


def same(df, wanted):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(wanted, key=repr)


def test_quality_measures(docs, rows, none):
    def brute(text):
        w, t = words(text), text or ""
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        n = len(w)
        return n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n

    found = quality_rules.judged(docs)
    same(found.select("doc_id", *quality_rules.BASE, "base_failed"), [(r[0], *brute(r[1])) for r in rows])
    assert found.filter("base_failed AND kept").isEmpty() and not found.filter("kept").isEmpty()
    assert quality_rules.judged(none).isEmpty() and quality_rules.keep_good(none).isEmpty()
    kept = collections.Counter(r["doc_id"] for r in found.filter("kept").collect())
    assert collections.Counter(r["doc_id"] for r in quality_rules.keep_good(docs).collect()) == kept
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_repeated_words_overlap_themselves():
    assert quality_rules.repeated_words([b"a"] * 6) == 6
    assert quality_rules.repeated_words([b"a"] * 5) == 0
    assert quality_rules.repeated_words([]) == 0
    assert quality_rules.measure("é# x\n\nx\nx".encode())[:4] == (4, 5, 1, 1)


def test_estimate_recovers_accuracies():
    """Votes drawn from known accuracies: the estimate finds them, and an uninformative rule weighs nothing."""
    r = np.random.default_rng(3)
    good = r.random(40_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.75, 0.9, 0.5])
    cast = np.where((r.random((len(good), 8)) < accuracy) == good[:, None], 1, -1)
    cast[r.random(cast.shape) < 0.2] = 0
    patterns, counts = np.unique(((cast + 1) * 3 ** np.arange(8)).sum(axis=1), return_counts=True)
    model = quality_rules.estimate(patterns, counts.astype(float))
    assert abs(model["prior"] - 0.8) < 0.02
    assert np.abs(model["right"][:, :7] - accuracy[:7]).max() < 0.03
    assert abs(model["right"][0, 7] + model["right"][1, 7] - 1) < 0.05


def brute_prints(rows):
    out = []
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def reached(ids, linked):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        parent[root(a)] = root(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [least.get(root(k)) for k in range(len(ids))]


def test_simhash_components(docs, rows, none):
    prints, n = brute_prints(rows), len(rows)
    linked = [(a, b) for a in range(n) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    wanted = reached([r[0] for r in rows], linked)
    found = simhash.near_duplicates(docs)
    same(found.select("doc_id", simhash.hex_digits(F.col("fp")), "component_id"), [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, wanted)])
    assert simhash.near_duplicates(none).isEmpty()


@pytest.mark.parametrize("radius", [1, 3, 5])
def test_links_connect_all_near_fingerprints(spark, radius):
    """Clouds of fingerprints a few bits apart, so that many share a segment: components equal those of all pairs."""
    r = np.random.default_rng(radius)
    centres = r.integers(-(2**63), 2**63 - 1, size=6)
    values = {int(c) for c in centres}
    for c in centres:
        for _ in range(60):
            x = int(c) & (2**64 - 1)
            for b in r.integers(0, 64, size=int(r.integers(1, 7))):
                x ^= 1 << int(b)
            values.add(x - (x >> 63 << 64))
    values = sorted(values)
    near = [(a, b) for a in range(len(values)) for b in range(a) if ((values[a] ^ values[b]) & (2**64 - 1)).bit_count() <= radius]
    classes = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "fp long, first long")
    edges = simhash.links(classes, radius)
    got = {r["fp"]: r["component_id"] for r in simhash.components(classes, edges).collect()}
    assert [got[v] for v in values] == reached(list(range(len(values))), near)
    assert all(((e["a"] ^ e["b"]) & (2**64 - 1)).bit_count() <= radius for e in edges.collect())


def test_one_of_each_near_copy(spark, docs, none):
    r = np.random.default_rng(2)
    base = [f"t{k}" for k in r.integers(0, 900, size=300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 6):  # a word changed here and there: similarity above 0.8
        w = list(base)
        for p in r.integers(0, 300, size=5):
            w[p] = f"z{k}"
        rows.append((k, " ".join(w)))
    rows += [(7, " ".join(base[:150]) + " " + " ".join(f"u{k}" for k in range(150))), (8, " ".join(base)), (8, " ".join(base)), (9, None), (10, ""), (None, "x y"), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] for r in near_copies.one_of_each(df).collect()), key=str)
    assert kept == [0, 7, 9, None, None]
    assert near_copies.one_of_each(none).isEmpty()
    assert near_copies.similarity(rows[0][1].encode(), rows[1][1].encode()) > 0.8


def test_unlike_texts_under_one_id_stay(spark):
    one, two = " ".join(f"a{k}" for k in range(80)), " ".join(f"b{k}" for k in range(80))
    rows = [(1, one, 1), (1, two, 2), (1, two, 3), (2, two.replace("b40", "c"), 4), (3, one, 5), (1, None, 6), (1, "", 7)]
    kept = near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, digest long")).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept) == [(1, ""), (1, one), (1, two)]


def test_stages_keep_columns_of_any_name(spark):
    names = ["_uses", "_rest", "_times", "_copy", "_kept", "_text", "_all", "all", "digest", "uses", "rest", "own_id", "fp", "row", "first"]
    rows = [(k, f"some words of text number {k} " + " ".join(f"w{k}x{j}" for j in range(40)), "a", *(f"{n}{k}" for n in names)) for k in range(20)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *(f"`{n}` string" for n in names)]))
    for found in (mixing.take(df), near_copies.one_of_each(df)):
        assert found.columns == df.columns
        got = {tuple(r) for r in found.collect()}
        assert got and got <= set(rows)
    assert near_copies.one_of_each(df).count() == 20


@pytest.mark.parametrize("tile", [256, 9])
def test_near_copies_of_a_text_in_the_middle(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "_TILE", tile)
    r = np.random.default_rng(3)
    rows, n = [], 80

    def changed(base, name, count):
        w = list(base)
        for p in r.choice(len(w), count, replace=False):
            w[p] = name
        return " ".join(w)

    for g, length in ((0, 200), (1, 90), (2, 260)):
        base = [f"g{g}t{k}" for k in r.integers(0, 900, size=length)]
        rows += [(1000 * g + k, " ".join(base) if k == n // 2 else changed(base, f"g{g}z{k}", 3)) for k in range(n)]
    # a shared passage puts unlike texts and two like ones in the middle in one bucket
    passage = [f"p{k}" for k in range(60)]
    rows += [(5000 + k, " ".join(passage + [f"q{k if k != 21 else 20}x{j}" for j in range(40)] + [f"e{k}"])) for k in range(40)]
    sets = [(set(zip(*(t.split()[k:] for k in range(5)))), set(enumerate(near_copies.band_keys(simhash.shingle_hashes(t.encode().split(), 5))))) for _, t in rows]
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode().split(), 3)) for _, t in rows]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            (a, p), (b, q) = sets[i], sets[j]
            if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3 or (p & q and len(a & b) / len(a | b) >= near_copies.SIMILARITY):
                x, y = up[i], up[j]
                up = [min(x, y) if v in (x, y) else v for v in up]
    kept = sorted(x["doc_id"] for x in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept == sorted(rows[k][0] for k in set(up))
    assert sum(k < 1000 for k in kept) == 1 and 5021 not in kept


def test_suffix_order_and_backward_search():
    r = np.random.default_rng(4)
    for size in (1, 2, 7, 60):
        for _ in range(8):
            text = r.integers(0, size, size=int(r.integers(1, 90)))
            assert suffix_order(text).tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
            index = FMIndex(text, size)
            for m in (1, 2, 5):
                pattern = r.integers(0, size, size=m)
                lo, hi = index.everything(1)
                for c in pattern[::-1]:
                    lo, hi = index.extend(np.array([c]), lo, hi)
                assert max(0, int(hi[0] - lo[0])) == sum((text[k : k + m] == pattern).all() for k in range(len(text) - m + 1))


@pytest.mark.parametrize("window,hot,shard", [(35, 2000, 400_000), (12, 1, 300), (20, 3, 50)])
def test_repeated_substrings(docs, rows, none, window, hot, shard):
    texts = [words(r[1]) for r in rows]
    count = collections.Counter(tuple(w[k : k + window]) for w in texts for k in range(len(w) - window + 1))
    wanted = []
    for r, w in zip(rows, texts):
        gone = {p for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        wanted.append((r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for p, x in enumerate(w) if p not in gone)).hexdigest()))
    same(substrings.without_repeats(docs, window, hot, shard), wanted)
    assert substrings.without_repeats(none).isEmpty()


def test_planes_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = r.integers(0, 2**32, size=n, dtype=np.uint32)
        for mode in (token_planes.BIT, token_planes.BYTE):
            assert (token_planes.unpack(token_planes.pack(ids, mode)) == ids).all()
    with pytest.raises(ValueError):
        token_planes.unpack(b"other file")


def test_pieces_keep_the_encoding(rows):
    tool = token_planes.Encoder(tokenizer_path())
    texts = [r[1] for r in rows if r[1]] + [" lead", "two  blanks", "tail ", "a \n b", "it's we'll  \u00a0 x", "line\r\n next\t tab", "\u3000 wide", " ", "\n \n"]
    for text, code in zip(texts, tool.encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("block,mode", [(token_planes.BLOCK_IDS, token_planes.BYTE), (64, token_planes.BIT)])
def test_token_files(spark, docs, rows, none, tmp_path, block, mode):
    encode = token_planes.Encoder(tokenizer_path()).tokenizer.encode
    wanted, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = encode(r[1] or "", add_special_tokens=False).ids + [2]
        wanted.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    path = str(tmp_path / "planes")
    token_planes.write_planes(docs, path, tokenizer_path(), block_ids=block, mode=mode)
    same(token_planes.read_documents(spark, path), wanted)
    index = token_planes.read_index(spark, path)
    assert index.agg(F.sum("n_ids")).first()[0] == start and "payload" not in index.columns
    token_planes.write_planes(none, path + "0", tokenizer_path())
    assert token_planes.read_documents(spark, path + "0").isEmpty()


def items():
    r = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"]
    out = []
    for k in range(30):
        w = list(r.choice(vocabulary, int(r.integers(12, 150))))
        w[len(w) // 2] += "."
        out.append((k, " ".join(w).capitalize() + "."))
    return out + [(50, None), (51, ""), (52, "the")]


def plain_bm25(parsed):
    """(item number, {term: share of the unit's own score}) of each unit, from the formula alone."""
    units = [(k, it.words[a : a + 64]) for k, it in enumerate(parsed) for a in range(0, len(it.words), 64)]
    units = [(k, u) for k, u in units if len(u) >= 5 or len(parsed[k].words) <= 64]
    mean = sum(len(u) for _, u in units) / len(units)
    out = []
    for k, u in units:
        weight = {}
        for t in set(u):
            df = sum(t in v for _, v in units)
            tf = u.count(t)
            weight[t] = np.log(1 + (len(units) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / mean))
        out.append((k, {t: w / sum(weight.values()) for t, w in weight.items()}))
    return out


def test_leaks_against_all_scores(spark, docs, rows, none):
    bench = items()
    planted = [(500 + k, "Lead in words here. " + t.upper() + " and more w1 w2", "en", "s0", 9, 1, "", "", 1) for k, t in bench[:12]]
    all_rows = rows + planted
    table = spark.createDataFrame(bench, "item_id long, text string")
    parsed = [decontaminate.parse_item(i, None if t is None else t.encode()) for i, t in bench]
    units, wanted = plain_bm25(parsed), []
    for r in all_rows:
        w, best = decontaminate.normal_words((r[1] or "").encode()), {}
        for a in range(decontaminate.passages(len(w))):
            held = set(w[a * 64 : a * 64 + 128])
            for number, weights in units:
                x = sum(v for t, v in weights.items() if t in held)
                item = parsed[number]
                if x < 0.6 - 1e-6:
                    continue
                at, reach = a * 64, len(item.words)
                q, s, whole = decontaminate.overlaps(item, w[max(0, at - reach) : at + 128 + reach])
                if whole >= 0.8 or (q >= 0.8 and s >= 0.5):
                    old = best.get(item.item_id, (0, 0, 0))
                    best[item.item_id] = tuple(map(max, old, (x, q, s)))
        wanted += [(r[0], i, *(round(float(v), 4) for v in x)) for i, x in best.items()]

    def found(**more):
        got = decontaminate.find_leaks(spark.createDataFrame(all_rows, COLUMNS), table, **more)
        return got.select("doc_id", "item_id", *[F.round(c, 4) for c in got.columns[2:]])

    same(found(), wanted)
    same(found(max_items=7), wanted)  # scores do not depend on the shards
    assert {r[0] for r in planted} <= {w[0] for w in wanted}
    bad = {w[0] for w in wanted}
    for more in ({}, {"max_items": 7}):
        clean = decontaminate.without_leaks(spark.createDataFrame(all_rows, COLUMNS), table, **more)
        assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((r[0] for r in all_rows if r[0] not in bad), key=str)
    assert decontaminate.find_leaks(none, table).isEmpty() and decontaminate.find_leaks(docs, table.limit(0)).isEmpty()


def test_a_question_without_its_answer_is_no_leak(spark):
    question, answer = "which river runs through the old town of the far north. ", "the slow green river runs there under nine bridges."
    table = spark.createDataFrame([(1, question + answer)], "item_id long, text string")
    texts = [(1, "so " + question + "nobody knows"), (2, "so " + question + answer), (3, "so " + answer)]
    found = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), table, threshold=0.4).collect()
    assert [(r.doc_id, r.answer_overlap) for r in found] == [(2, 1.0)]


def test_quotas_and_flow():
    sizes = [("b", 100), ("a", 300), (None, 150), ("c", 0)]
    # order a, b, c, null; weights 3, 1, 2, 3; 825 tokens: c stops at 0, then null at 300, and a and b share 525 as 3 to 1
    assert mixing.quotas(sizes) == {"c": 0, None: 300, "a": 393.75, "b": 131.25}
    # content held by both sources is used once before anything is used twice
    flow = mixing.route({"x": 10, "y": 10}, {("x", 0): 10, ("x", 1): 10, ("y", 0): 10}, {0: 12, 1: 8})
    assert sum(flow.values()) == 20 and flow["x", 0] + flow["x", 1] == 10


def test_mix(docs, rows, none):
    found = mixing.mixed(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in found) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in rows)
    total = collections.Counter()
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        total[r["source"], r["target"]] += r["taken"]
    biggest = collections.defaultdict(int)
    for r in found:
        biggest[r["source"]] = max(biggest[r["source"]], r["size"])
    patterns = len({r["pattern"] for r in found})
    for (source, target), n in total.items():
        assert abs(n - target) <= patterns * biggest[source]
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    assert mixing.mixed(none).isEmpty() and mixing.take(none).isEmpty()
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["times"] for r in found)


def test_mix_uses_contents_once_before_twice(spark):
    r = np.random.default_rng(4)
    rows, texts = [], [" ".join(f"t{k}" for k in r.integers(0, 500, int(r.integers(5, 30)))) + f" {k}" for k in range(400)]
    for k, text in enumerate(texts):
        # copies within a source, across two sources, and of both kinds
        rows += [(4 * k + j, text, s) for j, s in enumerate(("a", "a") if k < 200 else ("a", "b") if k < 300 else ("b", "c", "c"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share in (0.3, 0.8, 1.2):
        found = mixing.mixed(df, share=share).collect()
        uses, size, of, total, tokens = collections.Counter(), {}, {}, collections.Counter(), collections.Counter()
        for x in found:
            assert 0 <= x["times"] <= 2
            uses[x["digest"]] += x["times"]
            size[x["digest"]], of[x["digest"]] = x["size"], x["pattern"]
            total[x["source"], x["target"]] += x["taken"]
        for d, n in size.items():
            tokens[of[d]] += n
        for p in tokens:
            counts = {uses[d] for d in of if of[d] == p}
            assert max(counts) - min(counts) <= 1
        assert all(abs(n - target) <= 2 * 30 * len(tokens) for (_, target), n in total.items())
        # the convex cost that the flow promises, each content's words times 1, 2, 3 and 3, 4 ... for its uses
        flow = collections.Counter()
        for x in found:
            flow[x["pattern"]] += x["taken"]
        once = sum(min(flow[p], tokens[p]) for p in tokens)
        assert abs(sum(size[d] for d in size if uses[d]) - once) <= 2 * 30 * len(tokens)
        taken = collections.Counter(x["doc_id"] for x in mixing.take(df, share=share).collect())
        assert taken == {x["doc_id"]: x["times"] for x in found if x["times"]}


def test_mix_takes_some_of_equal_rows(spark):
    df = spark.createDataFrame([(k // 10, f"words of text {k // 10}", "a") for k in range(100)] + [(k, f"other {k}", "b") for k in range(100, 400)], "doc_id long, text string, source string")
    for share in (0.2, 0.7):
        assert mixing.take(df, share=share).count() == sum(r["times"] for r in mixing.mixed(df, share=share).collect())


def test_mix_keeps_wide_source_sets_apart(spark):
    # two sets of seven sources that have no source in common, and three texts in each
    rows = [(100 * g + 10 * k + t, f"g{g} text {t} of some words", f"s{g}{k}") for g in range(2) for k in range(7) for t in range(3)]
    found = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sources = collections.defaultdict(set)
    for r in found:
        sources[r["pattern"]].add(r["source"])
    assert sorted(map(sorted, sources.values())) == [[f"s{g}{k}" for k in range(7)] for g in range(2)]


def test_surrogates(spark, docs, none):
    text = "Write to Anna.Berg@mail.example.com or ANNA KRAUS, +1 (974) 555-3436; again anna kraus? no: Anna Kraus. Card 4111 1111 1111 1111, 10.0.0.7 and Frau Weber, Елена Петрова."
    df = spark.createDataFrame([(1, text), (2, "anna.berg@MAIL.example.com / 4111111111111111"), (3, None), (4, ""), (5, "Version 1.2.3 of 2024-01-01, 12345")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in surrogates.replaced(df, b"k").collect()}
    a, b = out[1]["text"], out[2]["text"]
    assert out[3]["text"] is None and out[4]["text"] == "" and out[5]["text"] == "Version 1.2.3 of 2024-01-01, 12345"
    for gone in ("Berg@", "KRAUS", "Kraus", "555-3436", "4111", "10.0.0.7", "Weber", "Петрова"):
        assert gone not in a
    card = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}),", a).group(1)
    assert surrogates.luhn(card.replace(" ", "")) == 0 and card.replace(" ", "") in b
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", a)
    mail = re.search(r"to (\S+@\S+)", a).group(1)
    assert mail.lower() == b.split(" ")[0].lower()
    shouted, plain = re.search(r"or ([A-Z]+ [A-Z]+),", a).group(1), re.search(r"no: (\w+ \w+)\.", a).group(1)
    assert shouted.lower() == plain.lower() and plain.split()[0] in surrogates.NAMES["latin", "f"]
    russian = re.search(r"([А-Я][а-я]+) [А-Я][а-я]+\.$", a).group(1)
    assert russian in surrogates.NAMES["cyrillic", "f"]
    assert surrogates.replaced(none, b"k").isEmpty()
    assert surrogates.replaced(df, b"other").filter("doc_id = 1").first()["text"] != a
    assert surrogates.replaced(docs, b"k").count() == docs.count()


def test_surrogates_stay_distinct(spark, monkeypatch):
    """A kind with few replacements: many first wishes collide, yet all entities end apart and none becomes another one."""
    monkeypatch.setattr(surrogates, "_proposed", small_space)
    entities = spark.createDataFrame([("phone", f"{k:02d}") for k in range(60)], "kind string, form string")
    found = surrogates.assign(entities, b"k").collect()
    assert len({r["replacement"] for r in found}) == 60
    assert not {r["replacement"] for r in found} & {r["form"] for r in found}


def small_space(key):
    import pyarrow as pa

    schema = pa.schema([("kind", pa.string()), ("form", pa.string()), ("attempt", pa.int32()), ("replacement", pa.string())])

    def run(stream):
        for b in stream:
            made = [f"{zlib.crc32(f'{f}/{a}'.encode()) % 160:02d}" for f, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made)], schema=schema)

    return run


def test_cotraining_on_held_out_rows(spark, none):
    """Half of the labels are hidden; the combined score recovers them, and metadata that knows the answer is used too."""
    r = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(900):
        good = bool(r.random() < 0.7)
        tail = r.choice(["fine", "lucid", "sound"] if good else ["spam", "click", "win"], 2)
        text = " ".join([*r.choice([f"w{j}" for j in range(80)], 30), *(tail if r.random() < 0.9 else [])])
        rows.append((k, text, "en", "good" if good == (r.random() < 0.9) else "bad", len(text)))
        labels.append((k, int(good)))
    rows += [(2000, None, None, None, None), (None, "", "en", "good", 0), (5, rows[5][1], "en", rows[5][3], rows[5][4])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([(1, "http://a.b/c", "<a href=x>"), (1, None, None), (None, "x", "y")], "page_id long, url string, html string")
    truth = spark.createDataFrame(labels[:300] + [(None, 1), (7, None)], "doc_id long, good int")
    out = cotraining.scored(df, pages, truth, rounds=2, pseudo=100).collect()
    assert len(out) == len(rows)
    known = dict(labels)
    right = [r["kept"] == bool(known[r["doc_id"]]) for r in out if r["doc_id"] in known and r["doc_id"] >= 300]
    assert np.mean(right) > 0.93
    assert cotraining.scored(none, pages, truth).isEmpty()
    blank = cotraining.scored(df, pages, truth.limit(0)).collect()
    assert all(r["kept"] and r["score"] is None for r in blank)


def test_pipeline_stages(spark, rows):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables absent")
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("extra", F.lit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert 0 < docs.count() == last.count() and docs.select("doc_id").distinct().count() < before
    awkward = spark.createDataFrame(rows, COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, awkward, folder).count()
        stage(spark, awkward.limit(0), folder).count()


def test_words_of_letters_skip_the_pattern():
    tool, seen = token_planes.Encoder(tokenizer_path()), []
    learn = tool._learn_any
    tool._learn_any = lambda words, *more: (seen.extend(words), learn(words, *more))
    texts = ["Abc xyzzy, (plugh) frobz.\nSecond line: \u00e9t\u00e9\u0301 \u0436\u0443\u043a? 4th don't \u4e2d\u6587, a\u00d7b end", "one\x01two three", "<|endoftext|> x", "solo", "a,b c;) d\"]", "x" * 3000 + " y"]
    for text, code in zip(texts, tool.encode(texts)):
        assert np.frombuffer(code, "<u4").tolist() == tool.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert {" xyzzy,", " frobz.", " line:", "Second", "Abc", "solo"}.isdisjoint(seen) and {" 4th", " don't"} <= set(seen)
    assert tool.encode(texts) == token_planes.Encoder(tokenizer_path()).encode(texts)


def test_words_stay_known_over_a_large_vocabulary():
    tool, seen = token_planes.Encoder(tokenizer_path()), []
    learn = tool._learn
    tool._learn = lambda pieces: (seen.append(len(pieces)), learn(pieces))
    words = ["".join(chr(97 + k // 26**j % 26) for j in range(4)) for k in range(200_000)]
    texts = [" ".join(words[k : k + 40_000]) for k in range(0, len(words), 40_000)]
    first = [tool.encode([t]) for t in texts]
    assert len(seen) == len(texts)
    assert [tool.encode([t]) for t in texts] == first and len(seen) == len(texts)
    # one of them new: only that one is learned
    assert tool.encode([texts[0] + " aaaaaz"])[0].startswith(first[0][0]) and seen[-1] == 1
