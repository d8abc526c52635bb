"""Alignment of the two public vocabularies against brute force with the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tremora.llm import alignment
from tremora.llm.queries import pieces_path, tokenizer_path

DDL = "doc_id long, text string, pair string, n int"


def texts(seed=4):
    r = random.Random(seed)
    letters = " \n\t abcdeéß<0x41>中文😀Ωж \x00.'s123͸"
    words = ["the", "reading", "naïve", "über", "don't", "12345", "tokenisation", "<|endoftext|>", "¿qué?", "é", "Ἀρχή", "中文字", "𝔘"]
    out = ["".join(r.choices(letters, k=r.randint(1, 40))) for _ in range(60)]
    out += [" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(60)]
    return [*out, "a▁b", "▁", " ", "\n", "x" * 700, " " * 700 + "y"]


def rows_of():
    rows = [(k, t, "x", 1) for k, t in enumerate(texts())]
    return [*rows, (500, None, None, 2), (501, "", "y", 3), (None, "no id", "z", 4), (3, rows[3][1], "x", 1), (3, rows[3][1], "x", 1)]


@pytest.fixture(scope="module")
def brute():
    """Per row its (a, b, groups), by the libraries alone, and the counts of linked pairs."""
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=pieces_path())
    own = alignment.byte_level(tokenizer_path())

    def piece(k):
        name = b.id_to_piece(k)
        return bytes([int(name[3:5], 16)]) if b.is_byte(k) else name.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text, *_ in rows_of():
        left = a.encode(" " + (text or ""), add_special_tokens=False).ids
        right = b.encode(text or "")
        data = (" " + (text or "")).encode()
        if not text or b"".join(own.raw[k] for k in left) != data or b"".join(map(piece, right)) != data:
            found.append((doc_id, [], [], []))
            continue
        ends = []
        for ids, size in ((left, lambda k: len(own.raw[k])), (right, lambda k: len(piece(k)))):
            at, e = 0, []
            for k in ids:
                at += size(k)
                e.append(at)
            ends.append(e)
        groups, low = [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            groups.append(([k for k, e in zip(left, ends[0]) if low < e <= end], [k for k, e in zip(right, ends[1]) if low < e <= end]))
            low = end
        found.append((doc_id, left, right, groups))
        counts.update((x, y) for x, ex in zip(left, ends[0]) for y, ey in zip(right, ends[1]) if ex == ey)
    return found, counts


def test_documents(spark, brute):
    found, counts = brute
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    wanted = []
    for doc_id, left, right, groups in found:
        links = [(x[-1], y[-1]) for x, y in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if said else ""
        wanted.append((doc_id, len(left), len(right), len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), digest))
    docs = spark.createDataFrame(rows_of(), DDL).repartition(3)
    got = alignment.aligned(docs, tokenizer_path(), pieces_path()).documents()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(wanted, key=repr)
    assert any(len(x) > 1 for _, _, _, groups in found for x, _ in groups)


def test_pairs(spark, brute):
    docs = spark.createDataFrame(rows_of(), DDL).repartition(2)
    got = alignment.aligned(docs, tokenizer_path(), pieces_path()).pairs()
    assert {(r.a, r.b): r.n for r in got.collect()} == brute[1]


def test_groups(spark):
    docs = spark.createDataFrame([(1, "the naïve reader"), (2, None), (3, "▁x")], "doc_id long, text string")
    got = dict(map(tuple, alignment.groups(docs, tokenizer_path(), pieces_path()).collect()))
    assert got[2] == got[3] == "" and got[1].count("|") == got[1].count(";") + 1
    own = alignment.aligner(tokenizer_path(), pieces_path())
    for side, raw in ((0, own.a.raw), (1, own.b.raw)):
        assert b"".join(raw[int(k)] for g in got[1].split(";") for k in g.split("|")[side].split(",")) == b" the na\xc3\xafve reader"


def test_same_bytes_prefers_pieces():
    own = alignment.aligner(tokenizer_path(), pieces_path())
    for k, b in enumerate(own.same.tolist()):
        assert b < 0 or own.b.raw[b] == own.a.raw[k]
    assert not own.b.is_byte[own.same[own.a.library.token_to_id("A")]]


def test_both_libraries_cut_alike():
    own = alignment.byte_level(tokenizer_path())
    assert own.fast is not None
    for text in texts(8):
        assert own.encode([text])[0].tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], DDL)
    assert alignment.aligned(docs, tokenizer_path(), pieces_path()).documents().count() == 0
    row = alignment.aligned(spark.createDataFrame([(1, "reading naïvely " * 300_000)], "doc_id long, text string"), tokenizer_path(), pieces_path()).documents().first()
    assert row.n_links == row.n_groups > 600_000 and row.n_best == row.n_links


def test_a_task_holds_few_chunks(spark):
    """A reader decodes a whole row group, so its chunks are few; no regular link travels to another task."""
    docs = spark.createDataFrame([(k, "the reader of naïve texts " * 8_000) for k in range(60)], "doc_id long, text string").coalesce(1)
    found = alignment.aligned(docs, tokenizer_path(), pieces_path())
    files = [pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")) for f in found.chunks.inputFiles()]
    assert sum(f.metadata.num_rows for f in files) > 2 * alignment._GROUP_CHUNKS
    assert max(f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)) <= alignment._GROUP_CHUNKS
    documents = found.documents()
    assert {tuple(r)[1:] for r in documents.collect()} == {tuple(documents.first())[1:]}
    assert "regular" not in alignment._IRREGULAR.names
