"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from tremora.llm import spelling


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    longer, shorter = (u, v) if len(u) > len(v) else (v, u)
    return any(longer[:k] + longer[k + 1 :] == shorter for k in range(len(longer)))


def counts(docs):
    n = Counter()
    for doc_id, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def wanted(docs):
    n = counts(docs)
    links = {w: [] for w in n}
    for u, v in itertools.combinations(n, 2):
        if near(u, v):
            links[u].append(v)
            links[v].append(u)
    form = {w: f for w in n if links[w] for f in [min(links[w], key=lambda x: (-n[x], x))] if n[f] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n), key=repr)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def prose(seed=1):
    r = random.Random(seed)
    stems = ["".join(r.choices("aeintrso", k=r.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "éclairs", "eclairs", "naïvely", "ÿÿÿÿÿÿ"]
    words = []
    for s in stems:
        words += [s] * r.randint(5, 60)
        for _ in range(6):
            k = r.randrange(len(s))
            c = r.choice("aeiéß")
            v = r.choice([s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :], s[:k] + c + s[k:]])
            words += [v] * r.randint(1, 12)
            words += [v + "s"] * r.randint(1, 70)
    r.shuffle(words)
    texts = [" ".join(w.upper() if r.random() < 0.1 else w for w in words[k : k + 40]) for k in range(0, len(words), 40)]
    rows = [(k, t + r.choice([".", "\n", "×x", "1", "_"]), "x", 1) for k, t in enumerate(texts)]
    return rows + [(None, texts[0], "y", 2), (7, None, None, 3), (8, "", "z", 4), (9, texts[1], "x", 5), (9, texts[1], "x", 5), (10, "Ωmega-words " * 9, "x", 6)]


DDL = "doc_id long, text string, word string, n int"


@pytest.mark.parametrize(("limit", "long"), [(8000, 64), (3, 64), (4, 8), (2, 7)])
def test_forms_and_roots(spark, monkeypatch, limit, long):
    monkeypatch.setattr(spelling, "LIMIT", limit)
    monkeypatch.setattr(spelling, "LONG", long)
    rows = prose()
    found = got(spelling.variants(spark.createDataFrame(rows, DDL).repartition(4)))
    assert found == wanted(rows) and any(f[1] for f in found) and max(f[4] for f in found) > 5


def test_composition_lists_each_pair_once():
    r = random.Random(2)
    for letters in ("ab", "abé", "abcdefgh"):
        words = sorted({"".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(200)})
        found = list(spelling.OneEdit(spelling.Acceptor(words)).pairs())
        assert len(found) == len(set(map(frozenset, found)))
        assert set(map(frozenset, found)) == {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abc" for b in "de" for c in ("ing", "ed"))
    machine = spelling.Acceptor(words)
    assert len(machine.arcs) == 7  # one state for each number of letters but for the two that part before ing and ed


def test_long_words_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIMIT", 4)
    base = "ab" * 150
    rows = [(1, " ".join([base] * 30 + [base[:77] + "x" + base[78:]] * 5 + [base + "c"] * 6 + [base[1:]] * 5), None, 0), (2, "letter letters " * 100_000, None, 0)]
    assert got(spelling.variants(spark.createDataFrame(rows, DDL))) == wanted(rows)


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], DDL)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words here")], "doc_id long, text string")).count() == 0
