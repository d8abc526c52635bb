"""URL filter and quotation linking."""

import random
from urllib.parse import urlsplit

from tremora.llm import quotations, url_filter


def test_url_filter(spark):
    urls = [
        None, "no scheme", "http://A.Example.ORG/es/1", "http://example.org/en/12", "https://x.org", "https://x.org/", "ftp://u@site.com:80/fr/?q", "https://site.com/de/a#b", "https://www.site.com/de", "http://m.site.com/de.html",
        "https://notexample.org/es/", "https://q.net/a?utm_source=x&id=1", "https://q.net/a?id=1", "://", "x://?y", "http://example.org.net/es/",
    ]
    rows = [(k, u, "", 1) for k, u in enumerate(urls)] + [(3, urls[3], None, 2)]
    rows += [
        (30, "http://mirror.net/a", '<LINK href="https://blocked.com/de/z" rel=canonical>', 3), (31, "http://mirror.net/b", '<meta http-equiv="refresh" content="0; url=http://mirror.net/a/">', 3),
        (32, "http://both.net/", "<link rel='canonical' href='https://blocked.com/de/y'>", 3), (33, "http://ok.org/p", '<link rel="canonical" href="http://both.net">', 3),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule int")
    found = url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, None))
        assert (by[k]["host"], by[k]["path"], by[k]["rule"]) == (host, path, best[1]), u
        if best[1]:
            assert by[k]["verdict"] == best[2]
    assert urlsplit(urls[2]).path == by[2]["path"]
    # blocked by what they lead to, through one and two steps; an allowed alias comes first
    assert [by[k]["verdict"] for k in (30, 31, 32, 33)] == ["block", "block", "allow", "allow"]
    assert by[0]["verdict"] == "allow"
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark, url_filter.RULES)).isEmpty()


def test_url_filter_runs_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", "")], "page_id long, url string, html string")
    plan = url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_given_redirects(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", None), (2, "http://b.com/de/1", None), (3, "http://c.net/", None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://a.net/x", "http://t.net/1"), ("http://t.net/1", "http://b.com/de/1"), (None, "x")], "url string, target string")
    found = url_filter.judged(pages, url_filter.rule_table(spark, url_filter.RULES), redirects).collect()
    assert {r["page_id"]: r["verdict"] for r in found} == {1: "block", 2: "block", 3: "allow"}


def test_split_quotes():
    own, blocks = quotations.split_quotes("Hi\nOn Monday Bob wrote:\n> one\n>> two\n>>two more\n> three\nBye\n>four")
    assert own == "Hi\nBye"
    assert blocks == [(1, ["one"]), (2, ["two", "two more"]), (1, ["three"]), (1, ["four"])]
    assert quotations.split_quotes("") == ("", [])


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Where does the river end?\nTell me quickly please.", 1), (1, 1, "assistant", "It ends in the northern sea.", 1),
        (1, 2, "user", ">> where does the RIVER end?\n> It ends in the northern sea.\nAre you sure about that?", 1),
        (4, 0, "user", "> are you sure about that?\nA question from elsewhere.", 1), (5, 0, "user", "> never said by anyone here\nText.", 1), (6, 0, "user", "> Text only\n", 1),
        (7, 0, "user", "It ends in the northern sea.", 1), (7, 1, "user", "> it ends in the northern sea\nWhy?", 1), (0, 3, "user", "> it ends in the northern sea\nToo early to know.", 1),
        (None, None, None, None, 1), (None, None, None, None, 1), (8, 0, "user", "", 1), (8, 0, "user", "", 1), (8, 1, "x", "> " * 3000 + "deep quotes go far", 1),
    ]
    found = quotations.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, thread int")).collect()
    assert len(found) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in found}
    parent = {k: (r["parent_conv"], r["parent_turn"]) for k, r in by.items()}
    assert parent[1, 2] == (1, 1) and parent[4, 0] == (1, 2) and parent[7, 1] == (7, 0)
    assert parent[5, 0] == (None, None) and parent[6, 0] == (None, None)
    # said only in a larger conversation, which quotes no other one and so is told first
    assert parent[0, 3] == (1, 1) and by[0, 3]["thread_id"] == by[1, 0]["thread_id"] == 0
    assert by[4, 0]["thread_id"] == 0 and by[1, 0]["position"] == 1 and by[0, 3]["position"] == 4 and by[4, 0]["position"] == 5 and by[7, 0]["thread_id"] == 7
    assert by[1, 2]["text"] == "Are you sure about that?" and by[1, 2]["deepest"] == 2 and by[1, 2]["n_quotes"] == 2
    # quotes without a known origin stay
    assert by[5, 0]["text"] == "> never said by anyone here\nText." and by[6, 0]["text"] == "> Text only"
    assert by[8, 1]["deepest"] == 3000 and by[8, 1]["text"] == ("> " * 3000 + "deep quotes go far")
    assert sorted(r["position"] for r in found if r["conv_id"] == 8) == [1, 2, 3]
    where = {(r["conv_id"], r["turn"]): (r["thread_id"], r["position"]) for r in found}
    for k, p in parent.items():
        if p[1] is not None:
            assert where[p][0] == where[k][0] and where[p][1] < where[k][1]
    assert quotations.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).isEmpty()


def test_quotes_of_parts_and_of_other_conversations(spark):
    rows = [
        (5, 0, "user", "> the harbour closes at nine in winter\nIs that so?"), (9, 0, "user", "We checked. The harbour closes at nine in winter. Nobody minds."),
        (2, 0, "user", "One two three four five six\nseven eight nine ten\neleven twelve thirteen"), (2, 1, "assistant", "On Monday Ann wrote:\n> four five six seven\n> eight nine ten eleven\nGood."),
        (3, 0, "user", "Not yet."), (3, 1, "assistant", "> not yet\nWhen then?"), (4, 0, "user", "Not yet."), (6, 0, "user", "> not yet\nElsewhere."),
        (7, 0, "user", "Rain is likely on Sunday."), (7, 1, "user", "Ann wrote\n> rain is likely on sunday\n> but I made this up\nHm."), (7, 2, "user", "On Monday Ann wrote:\n> no one ever said this line\nOdd."),
    ]
    by = {(r["conv_id"], r["turn"]): r for r in quotations.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    parent = {k: (r["parent_conv"], r["parent_turn"]) for k, r in by.items()}
    assert parent[5, 0] == (9, 0) and by[5, 0]["text"] == "Is that so?" and by[9, 0]["position"] < by[5, 0]["position"]
    assert parent[2, 1] == (2, 0) and by[2, 1]["text"] == "Good."
    assert parent[3, 1] == (3, 0) and by[3, 1]["text"] == "When then?" and parent[6, 0] == (None, None) and by[6, 0]["text"] == "> not yet\nElsewhere."
    assert parent[7, 1] == (7, 0) and by[7, 1]["text"] == "Ann wrote\n> but I made this up\nHm."
    assert by[7, 2]["text"] == "On Monday Ann wrote:\n> no one ever said this line\nOdd."


def test_quotations_against_brute_force(spark):
    """Whole messages, lines, and runs of words cut and wrapped anywhere, quoted within and across conversations in both directions."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(25)]
    said = {(c, t): [[rng.choice(vocabulary) for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))] for c in range(60) for t in range(rng.randint(1, 5))}
    rows = []
    for (c, t), lines in said.items():
        text = "\n".join(" ".join(x) for x in lines)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            words = [w for x in said[rng.choice([k for k in said if k[0] == c] if rng.random() < 0.6 else list(said))] for w in x]
            start = rng.randrange(len(words))
            part = words[start : start + rng.randint(1, 12)] + (["unsaid"] if rng.random() < 0.2 else [])
            wrap, marks = rng.randint(1, 6), "> " * rng.randint(1, 3)
            block = "\n".join(marks + " ".join(part[k : k + wrap]).upper() + "." * (k % 2) for k in range(0, len(part), wrap))
            text = rng.choice([f"{block}\n{text}", f"{text}\n{block}"])
        rows.append((c, t, rng.choice(["user", "assistant"]), text))
    own = {(c, t): quotations.words_of(quotations.split_quotes(text)[0]) for c, t, _, text in rows}
    holds = lambda k, p: any(own[k][i : i + len(p)] == p for i in range(len(own[k]) - len(p) + 1))
    quoted = {}  # (block, line, level, words)
    for c, t, _, text in rows:
        lines, levels = quotations.read_lines(text)
        for b, level in enumerate(levels):
            parts = [(at, quotations.words_of(rest)) for at, (block, _, rest) in enumerate(lines) if block == b and rest is not None]
            whole = [(-1, [w for _, words in parts for w in words])]
            quoted.setdefault((c, t), []).extend((b, at, level, words) for at, words in whole + (parts if len(parts) > 1 else []) if words)
    where = {tuple(p): sorted(k for k in own if holds(k, p)) for q in quoted.values() for *_, p in q}
    here = lambda k, p: next((x for x in where[tuple(p)] if x[0] == k[0] and x[1] < k[1]), None)
    crossing = {k[0] for k, q in quoted.items() for *_, p in q if len(p) >= 3 and not here(k, p) and any(x[0] != k[0] for x in where[tuple(p)])}
    want = {}
    for k, q in quoted.items():
        best, blocks, numbers = None, set(), set()
        for b, at, level, p in q:
            below = [x for x in where[tuple(p)] if x[0] < k[0]]
            roots = [x for x in where[tuple(p)] if x[0] > k[0] and x[0] not in crossing]
            origin = here(k, p) or (len(p) >= 3 and next(iter(below or roots), None)) or None
            if origin:
                best = min(best or (level, -len(p), origin), (level, -len(p), origin))
                (blocks if at < 0 else numbers).add(b if at < 0 else at)
        want[k] = (best[2] if best else (None, None), blocks, numbers)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quotations.linked(frame.repartition(3)).collect()
    place = {(r["conv_id"], r["turn"]): (r["thread_id"], r["position"]) for r in found}
    texts = {(c, t): text for c, t, _, text in rows}
    linked = 0
    for r in found:
        k = (r["conv_id"], r["turn"])
        origin, blocks, numbers = want.get(k, ((None, None), set(), set()))
        assert (r["parent_conv"], r["parent_turn"]) == origin and r["text"] == quotations.without(texts[k], blocks, numbers)
        if origin[0] is not None:
            linked += 1
            assert place[origin][0] == place[k][0] and place[origin][1] < place[k][1]
    assert linked > 20 and len({p for p in place.values()}) == len(rows)
