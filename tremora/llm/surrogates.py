"""Personal data replaced by keyed surrogates of the same kind.

Mentions are detected per text and brought to a canonical form (case, spacing and separators aside), so every mention of an
entity, in whatever document and spelling, has the same replacement: digits for digits, letters of the same script and case for
letters, a valid check digit for a card number, a name of the same gender and script for a name. Replacements derive from a
secret key; the distinct entities of the corpus then contend for them, and an entity whose replacement is taken, or is
itself an entity of the corpus, tries its next one until all differ. Each mention keeps its own format.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.llm.common import identified, stored

# Given and family names by gender and script, in natural order.
NAMES = {
    ("latin", "f"): "Alice Amelie Anna Carla Clara Elena Emma Eva Hanna Ines Julia Laura Lena Lucia Marie Martha Nora Paula Sofia Sophie".split(),
    ("latin", "m"): "Adam Alan Bruno Carlos Daniel David Felix Hugo Jonas Jorge Karl Lukas Marco Martin Oscar Pablo Paul Peter Simon Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Дмитрий Иван Максим Николай Олег Павел".split(),
    ("greek", "f"): "Άννα Δήμητρα Ελένη Ζωή Θάλεια Ιωάννα Κατερίνα Μαρία Νίκη Σοφία".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λευτέρης Μάριος Νίκος Πέτρος Στέφανος".split(),
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоу", "greek": "αεηιο"}
_GIVEN = {name.lower(): kind for kind, names in NAMES.items() for name in names}
_TITLES = {"mr": "m", "mrs": "f", "ms": "f", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "señor": "m", "señora": "f"}

_CAPITAL = r"[A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΏΑ-ΫА-ЯЁ]"
_WORD = rf"{_CAPITAL}[^\W\d_]+(?:-{_CAPITAL}[^\W\d_]+)?"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w](?:[\w.+-]*[\w+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![\d.+-])\d{4}(?:[ -]?\d{4}){3}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("name", re.compile(rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? )?{_WORD}(?: {_WORD})?(?!\w)")),
)


def script_of(text: str) -> str:
    for ch in text:
        if "Ͱ" <= ch <= "Ͽ" or "ἀ" <= ch <= "῿":
            return "greek"
        if "Ѐ" <= ch <= "ӿ":
            return "cyrillic"
    return "latin"


def _name(mention: str) -> tuple[str, int] | None:
    """(canonical form `script:gender:given family`, length of the title) of a mention that names a person."""
    words, skip, gender = mention.split(" "), 0, None
    if len(words) > 1 and words[0].rstrip(".").lower() in _TITLES:
        gender, skip = _TITLES[words[0].rstrip(".").lower()], len(words[0]) + 1
        words = words[1:]
    known = _GIVEN.get(words[0].lower())
    if known and len(words) == 2:
        return f"{known[0]}:{known[1]}:{' '.join(words).lower()}", skip
    if gender and (len(words) == 2 or not known):
        return f"{script_of(mention)}:{gender}:{' '.join(words).lower()}", skip
    return None


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), in order and without overlaps; earlier kinds win."""
    found, taken = [], []
    has_digit = any(map(text.__contains__, "0123456789"))
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text or kind in ("secret", "card", "phone", "ip") and not has_digit:
            continue
        for m in pattern.finditer(text):
            a, b, whole = m.start(), m.end(), m.group()
            if kind == "name":
                named = _name(whole)
                if not named:
                    continue
                canonical, a = named[0], a + named[1]
            elif kind in ("card", "phone"):
                canonical = "".join(c for c in whole if c.isdigit())
            else:
                canonical = whole.lower()
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                found.append((a, b, kind, canonical))
    return sorted(found)


class Stream:
    """Choices drawn from a keyed hash of an entity and the number of the attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self.key, self.label, self.block, self.bits, self.size = key, f"{kind}\0{canonical}\0{attempt}".encode(), 0, 0, 0

    def below(self, n: int) -> int:
        if self.size < 64:
            self.block += 1
            self.bits = int.from_bytes(hmac.new(self.key, self.label + b"\0%d" % self.block, hashlib.sha256).digest(), "big")
            self.size = 256
        self.bits, value = divmod(self.bits, n)
        self.size -= n.bit_length()
        return value

    def of(self, choices: str | list[str]) -> str:
        return choices[self.below(len(choices))]


def luhn(digits: str) -> int:
    """Sum of the check-digit rule modulo ten; 0 for a valid number."""
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(int(c) for c in reversed(digits))) % 10


def _alike(draw: Stream, text: str) -> str:
    """Digits for digits and letters of the same script for letters; anything else stays."""
    return "".join(draw.of("0123456789") if c.isdigit() else draw.of(ALPHABETS[script_of(c)]) if c.isalpha() else c for c in text)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int = 0) -> str:
    """Canonical form of the replacement."""
    draw = Stream(key, kind, canonical, attempt)
    if kind == "email":
        local, domain = canonical.split("@")
        site, _, top = domain.rpartition(".")
        # the domain depends on the domain alone: colleagues stay colleagues
        return f"{_alike(draw, local)}@{_alike(Stream(key, 'domain', domain, 0), site)}.{top}"
    if kind == "secret":
        return "".join(draw.of("0123456789abcdef") for _ in canonical)
    if kind == "card":
        body = canonical[0] + "".join(draw.of("0123456789") for _ in canonical[2:])
        valid = luhn(canonical) == 0
        check = -luhn(body + "0") % 10
        return body + str(check if valid else (check + 1 + draw.below(9)) % 10)
    if kind == "phone":
        return canonical[0] + "".join(draw.of("0123456789") for _ in canonical[1:])
    if kind == "ip":
        private = canonical.startswith(("10.", "192.168."))
        first = canonical.split(".")[0]
        fresh = [str(1 + draw.below(254)) for _ in range(4)]
        return ".".join([first, *("168",) * (first == "192" and private), *fresh][:4]) if private else ".".join([str(11 + draw.below(115)), *fresh[1:]])
    script, gender, names = canonical.split(":", 2)

    def family() -> str:
        consonants = [c for c in ALPHABETS[script] if c not in VOWELS[script]]
        return "".join(draw.of(consonants) + draw.of(VOWELS[script]) for _ in range(3 + attempt // 8)) + draw.of(consonants)

    parts = names.split(" ")
    new = [draw.of(NAMES.get((script, gender), NAMES["latin", "f"])).lower(), family()] if len(parts) == 2 else [family()]
    return f"{script}:{gender}:{' '.join(new)}"


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.title() if like[:1].isupper() else word


def rendered(kind: str, mention: str, replacement: str) -> str:
    """The replacement in the format of the mention: separators, case."""
    if kind in ("card", "phone"):
        digits = iter(replacement)
        return "".join(next(digits, "0") if c.isdigit() else c for c in mention)
    if kind == "name":
        return " ".join(_cased(a, b) for a, b in zip(mention.split(" "), replacement.split(":", 2)[2].split(" ")))
    if kind == "secret":
        return replacement.upper() if mention.isupper() else replacement
    return "".join(b.upper() if a.isupper() else b for a, b in zip(mention, replacement)) if len(mention) == len(replacement) else replacement


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kinds", pa.list_(pa.string())), ("forms", pa.list_(pa.string()))])


def _detect(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in stream:
        rows = []
        for k1, k2, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            entities = {m[2:] for m in mentions((text.as_py() or b"").decode("utf-8", "replace"))}
            if entities:
                rows.append((k1, k2, *map(list, zip(*sorted(entities)))))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def _proposed(key: bytes):
    schema = pa.schema([("kind", pa.string()), ("form", pa.string()), ("attempt", pa.int32()), ("replacement", pa.string())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            made = [surrogate(key, k, f, a) for k, f, a in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], schema=schema)

    return run


def assign(entities: DataFrame, key: bytes, rounds: int = 200) -> DataFrame:
    """(kind, form, replacement) of distinct `entities(kind, form)`: no two replacements of a kind are equal and none is an entity.

    Of those that want the same replacement the one with the smallest form has it; the others try again. Raises if `rounds` do not do,
    which means that a kind has more entities than replacements.
    """
    known = stored(entities, "entities")
    pending, settled = known.withColumn("attempt", F.lit(0)), None
    for _ in range(rounds):
        wished = stored(pending.mapInArrow(_proposed(key), "kind string, form string, attempt int, replacement string"), "entities-wished")
        first = wished.groupBy("kind", "replacement").agg(F.min("form").alias("_first"))
        real = known.select("kind", F.col("form").alias("replacement"), F.lit(True).alias("_real"))
        told = wished.join(first, ["kind", "replacement"]).join(real, ["kind", "replacement"], "left")
        if settled is not None:
            told = told.join(settled.select("kind", "replacement", F.lit(True).alias("_held")), ["kind", "replacement"], "left")
        else:
            told = told.withColumn("_held", F.lit(None).cast("boolean"))
        told = stored(told.withColumn("_won", (F.col("form") == F.col("_first")) & F.col("_real").isNull() & F.col("_held").isNull()), "entities-told")
        won = told.filter("_won").select("kind", "form", "replacement")
        settled = won if settled is None else settled.unionByName(won)
        pending = told.filter("NOT _won").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled
    raise RuntimeError("more entities than replacements")


def _rewrite(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_mentions", pa.int64()), ("n_entities", pa.int64())])
    for batch in stream:
        texts, counts, sizes = [], [], []
        for text, known in zip(batch.column(1), batch.column(2)):
            raw = text.as_py()
            source, by = (raw or b"").decode("utf-8", "replace"), {(r["kind"], r["form"]): r["replacement"] for r in known.as_py() or ()}
            out, at, found = [], 0, mentions(source) if by else []
            for a, b, kind, form in found:
                out += [source[at:a], rendered(kind, source[a:b], by[kind, form])]
                at = b
            texts.append(None if raw is None else "".join(out) + source[at:])
            counts.append(len(found))
            sizes.append(len(by))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], schema=schema)


def _split(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a flag that tells whether they hold any mention."""
    for batch in stream:
        some = pa.array([bool(mentions((t.as_py() or b"").decode("utf-8", "replace"))) for t in batch.column(3)], pa.bool_())
        yield pa.RecordBatch.from_arrays([*batch.columns, some], names=["k1", "k2", "doc_id", "text", "some"])


def _keyed(docs: DataFrame) -> DataFrame:
    return identified(docs).select(F.xxhash64("doc_id", "text").alias("k1"), F.coalesce("doc_id", F.lit(-1)).cast("long").alias("k2"), "doc_id", "text")


def replaced(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_mentions, n_entities) for each row of `docs`, with every detected mention replaced.

    Null texts stay null and empty ones empty; equal rows get equal texts; an empty table gives none. Only texts that hold a mention
    are moved. The entities of one document meet in one row, those of the corpus only as distinct entities.
    """
    found = stored(_keyed(docs).select("k1", "k2", "text").mapInArrow(_detect, "k1 long, k2 long, kinds array<string>, forms array<string>"), "mentions").distinct()
    each = found.select("k1", "k2", F.explode(F.arrays_zip("kinds", "forms")).alias("e")).select("k1", "k2", F.col("e.kinds").alias("kind"), F.col("e.forms").alias("form"))
    known = assign(each.select("kind", "form").distinct(), key)
    lists = each.join(known, ["kind", "form"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("kind", "form", "replacement")).alias("known"))
    rows = _keyed(docs).mapInArrow(_split, "k1 long, k2 long, doc_id long, text binary, some boolean")
    plain = rows.filter("NOT some").select("doc_id", F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_mentions"), F.lit(0).cast("long").alias("n_entities"))
    held = rows.filter("some").join(lists, ["k1", "k2"], "left").select("doc_id", "text", "known")
    return plain.unionByName(held.mapInArrow(_rewrite, "doc_id long, text string, n_mentions long, n_entities long"))
