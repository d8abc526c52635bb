"""Agenda encoding against the sentencepiece library on awkward texts."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tremora.llm import piece_agenda
from tremora.llm.queries import pieces_path


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces_path())


@pytest.fixture(scope="module")
def own():
    return piece_agenda.Pieces(pieces_path())


def odd_texts(seed=3):
    r = random.Random(seed)
    letters = " ▁\n\t abcdeéß<0x41>中文😀Ωж \x00.́\xad</s>"
    texts = ["".join(r.choices(letters, k=r.randint(0, 90))) for _ in range(400)]
    return [*texts, "", " ", "▁", "   ", "<s> </s> <unk>", "the " * 700 + "thethe" * 900, "x" * 5000, "  " * 300, "中" * 300]


def ids(code):
    return np.frombuffer(code, dtype="<u4").tolist()


def test_any_text_has_the_ids_of_the_library(own, library):
    texts = odd_texts()
    for text, code in zip(texts, own.encode(texts)):
        assert ids(code) == library.encode(text), text[:60]
        assert own.decode(ids(code)) == library.decode(ids(code))


def test_ids_do_not_depend_on_what_was_seen_before(own, library, monkeypatch):
    texts = odd_texts(9)
    monkeypatch.setattr(piece_agenda, "_KNOWN", 50)
    small = piece_agenda.Pieces(pieces_path())
    for k in range(0, len(texts), 20):
        assert [ids(c) for c in small.encode(texts[k : k + 20])] == library.encode(texts[k : k + 20])


def test_the_heap_and_the_matrix_agree(own):
    r = random.Random(1)
    units = ["▁" + "".join(r.choices("theingouaé中", k=r.randint(1, 50))) for _ in range(300)]
    by_row = own.units_ids(units)
    for unit, code in zip(units, by_row):
        flat = np.array(own._heap([int(own.symbols[ord(c)]) for c in unit]), dtype=np.int32)
        assert own._ids(flat, np.array([len(flat)]))[0].tobytes() == code


def test_any_ids_decode_as_in_the_library(own, library):
    r = random.Random(2)
    for _ in range(2000):
        some = [r.choice((r.randrange(300), r.randrange(32000))) for _ in range(r.randint(0, 10))]
        assert own.decode(some) == library.decode(some), some


def test_a_wrong_merge_is_noticed():
    broken = piece_agenda.Pieces(pieces_path())
    broken.table.rank[:] = np.where(broken.table.rank == piece_agenda._NEVER, piece_agenda._NEVER, 100_000 - broken.table.rank)
    with pytest.raises(ArithmeticError):
        broken.encode(["the quick brown fox and another thing"])


def test_rows(spark, library):
    rows = [(k, t, "x", 1) for k, t in enumerate(odd_texts(4)[-40:])] + [(900, None, "y", 2), (901, "again", None, 3), (901, "again", None, 3), (None, "no id", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_id string, known int").repartition(3)
    found = piece_agenda.encoded(docs, pieces_path())
    got = sorted(map(tuple, found.select(*piece_agenda.digests(found)).collect()), key=repr)
    wanted = []
    for k, text, *_ in rows:
        code = [1, *library.encode(text or ""), 2]
        wanted.append((k, len(code), hashlib.sha256(np.array(code, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(code).encode()).hexdigest()))
    assert got == sorted(wanted, key=repr)


def test_kept_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    assert piece_agenda.encoded(docs, pieces_path(), ["lang", "doc_id"]).select("lang", "doc_id", "decoded").collect() == [("en", 1, "a b")]
    assert piece_agenda.encoded(docs.filter("doc_id > 5"), pieces_path()).count() == 0
    with pytest.raises(ValueError):
        piece_agenda.encoded(docs.withColumn("Decoded", F.lit(1)), pieces_path(), ["Decoded"])


def test_a_very_long_text(spark, library):
    text = "the naïve reader " * 200_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = piece_agenda.encoded(docs, pieces_path()).first()
    assert ids(row.piece_ids) == [1, *library.encode(text), 2] and row.decoded == text


def test_agendas_are_worked_on_in_bounded_matrices(own, monkeypatch):
    units = ["▁" + "".join(random.Random(k).choices("abcdeé中😀", k=1 + k % 70)) for k in range(500)]
    wanted, shapes, rows = own.units_ids(units), [], own._rows
    monkeypatch.setattr(piece_agenda, "_CELLS", 640, raising=False)
    monkeypatch.setattr(own, "_rows", lambda symbols: (shapes.append(symbols.size), rows(symbols))[1])
    assert own.units_ids(units) == wanted
    assert max(shapes) <= 640
