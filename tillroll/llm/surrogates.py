"""Surrogates for personal data: each detected entity gets a keyed replacement of its own kind, script, gender and format.

Kinds: e-mail addresses, phone numbers, payment cards, IPv4 addresses, social security numbers, IBANs, and names after a title.

A replacement is a keyed *permutation* of all values of the entity's format (a Feistel network on mixed-radix numbers; values that
may not come out are walked past). So one original has one surrogate wherever it stands (coreference), two originals of a format never
share one, and formats are kept, so that two formats can't meet either (distinctness). No table of entities has to be kept or
joined, and a lost task is simply run again. Digits stay digits, letters stay in their alphabet and case, the check digit of a valid
card is made anew, addresses stay private or public, a woman's name becomes a woman's name (by the name, not by its title, so
that a name has one surrogate under all titles). ``collisions`` checks both claims over all entities of a table with a shuffle of the
distinct ones.

The text around entities is untouched. Overlapping finds: the earlier start wins, then the order of the kinds as listed.

Edge cases: a null text stays null and has no entities; empty texts, repeated rows, missing doc_id and other columns pass through;
an empty table gives an empty table. The columns ``entities`` and ``n_entities`` are added (an existing one is replaced).
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.workers import lean

KEY = b"replace this key in production"

_TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Doña"]
_TITLES_M = ["Mr", "Herr", "Monsieur", "Sr", "Señor", "Don"]
_TITLES_X = ["Dr", "Prof"]
#: Names to choose from, by gender.
FIRST_F = ["Alice", "Amélie", "Anna", "Carmen", "Chloé", "Clara", "Elena", "Emma", "Greta", "Hannah", "Inés", "Julia", "Laura",
           "Lucía", "Maria", "Marie", "Paula", "Rosa", "Sofia", "Susan"]
FIRST_M = ["Adrian", "Antonio", "Bruno", "Carlos", "Daniel", "David", "Emil", "Felix", "Hugo", "Jakob", "Jean", "John", "Jonas",
           "Louis", "Luis", "Martin", "Pablo", "Paul", "Peter", "Thomas"]
POOLS = {"f": FIRST_F, "m": FIRST_M}

_NAME = r"[^\W\d_]{2,30}"
PATTERNS = [
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}(?![\w-])")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("card", re.compile(r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\w)|(?<![\w.(-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")),
    ("name", re.compile(rf"(?<!\w)(?:{'|'.join(_TITLES_F + _TITLES_M + _TITLES_X)})\.? ({_NAME}(?:-{_NAME})?(?: {_NAME})?)")),
]
_TITLED = re.compile(rf"(?:{'|'.join(_TITLES_F + _TITLES_M + _TITLES_X)})\.? ")
_DIGIT = re.compile(r"\d")

_DIGITS = "0123456789"
_ALPHABETS = [_DIGITS, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
              "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
              "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
ALPHABET_OF = {c: a for a in _ALPHABETS for c in a}


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1 for each tweak: a Feistel network, walked until the number is in range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(8):
            seed = hashlib.blake2b(f"{tweak}|{turn}|{right}".encode(), key=key, digest_size=-(-half // 8) + 8).digest()
            left, right = right, left ^ (int.from_bytes(seed, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def same_format(text: str, key: bytes, tweak: str, fits: Callable[[str], bool] = lambda x: True) -> str:
    """Another text with letters and digits of the same alphabets at the same places, for which ``fits`` holds as it does for this one."""
    alphabets = [ALPHABET_OF.get(c, "") for c in text]
    size, value = 1, 0
    for c, a in zip(text, alphabets, strict=True):
        if a:
            size, value = size * len(a), value * len(a) + a.index(c)
    shape = "".join(a[0] if a else c for c, a in zip(text, alphabets, strict=True))
    wanted = fits(text)
    while True:
        value = rest = permuted(value, size, key, f"{tweak}|{shape}")
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                rest, i = divmod(rest, len(a))
                c = a[i]
            out.append(c)
        new = "".join(reversed(out))
        if fits(new) == wanted:
            return new


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def octets(text: str) -> list[int] | None:
    found = [int(x) for x in text.split(".")]
    return found if all(x < 256 for x in found) else None


def ip_surrogate(text: str, key: bytes) -> str:
    value = int.from_bytes(bytes(octets(text)), "big")
    # How an octet is written (with leading zeros or not) is part of the format.
    padded = [len(x) if x[0] == "0" and len(x) > 1 else 0 for x in text.split(".")]
    kind = ipaddress.ip_address(value).is_global
    while True:
        value = permuted(value, 1 << 32, key, f"ip|{padded}")
        new = list(value.to_bytes(4, "big"))
        if ipaddress.ip_address(value).is_global == kind and all(not p or len(str(x)) < p for x, p in zip(new, padded, strict=True)):
            return ".".join(str(x).zfill(p) for x, p in zip(new, padded, strict=True))


def name_word(word: str, key: bytes) -> str:
    """A name of a pool becomes one of the same pool, whatever its title says; other words skip both pools."""
    for gender, pool in POOLS.items():
        if word in pool:
            return pool[permuted(pool.index(word), len(pool), key, f"pool|{gender}")]
    return same_format(word, key, "name", lambda x: x in FIRST_F or x in FIRST_M)


def gender_of(title: str) -> str:
    title = title.rstrip(". ")
    return "f" if title in _TITLES_F else "m" if title in _TITLES_M else "x"


def surrogate(kind: str, original: str, key: bytes, gender: str = "x") -> str:
    """The title's ``gender`` doesn't count: one name has one surrogate under any title."""
    if kind == "email":
        # All addresses of a domain stay together, and those of different domains apart.
        local, _, domain = original.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{same_format(local, key, f'local|{domain}')}@{same_format(host, key, 'host')}.{top}"
    if kind == "ip":
        return ip_surrogate(original, key)
    if kind == "card":
        return same_format(original, key, "card", luhn)
    if kind == "phone":
        head = re.match(r"\+\d{1,3}(?=\D)|", original).group()  # the country stays
        return head + same_format(original[len(head) :], key, f"phone|{head}")
    if kind == "iban":
        return original[:2] + same_format(original[2:], key, f"iban|{original[:2]}")
    if kind == "name":
        return " ".join(name_word(x, key) for x in original.split(" "))
    return same_format(original, key, kind)


@lru_cache(maxsize=20_000)
def cached(kind: str, original: str, key: bytes, gender: str) -> str:
    return surrogate(kind, original, key, gender)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of the entities, without overlaps."""
    digits, at = _DIGIT.search(text) is not None, "@" in text
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        if kind == "email" and not at or kind not in ("email", "name") and not digits or kind == "name" and not _TITLED.search(text):
            continue
        for m in pattern.finditer(text):
            gender, (start, end) = "x", m.span()
            if kind == "ip" and octets(m.group()) is None or kind == "phone" and not 7 <= sum(map(str.isdigit, m.group())) <= 15:
                continue
            if kind == "name":
                gender, start = gender_of(text[m.start() : m.start(1)]), m.start(1)
                words = m.group(1).split(" ")
                if not words[0][0].isupper():
                    continue
                if len(words) > 1 and not words[1][0].isupper():
                    end = start + len(words[0])
            found.append((start, order, end, kind, gender))
    out, last = [], 0
    for start, _, end, kind, gender in sorted(found):
        if start >= last:
            out.append((start, end, kind, gender))
            last = end
    return out


def derived_key(key: bytes) -> bytes:
    return hmac.new(key, b"surrogates", hashlib.sha256).digest()


ENTITY = "array<struct<start:long,end:long,kind:string,surrogate:string>>"
ENTITY_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))


def pseudonymised(docs: DataFrame, key: bytes = KEY, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``entities``: their places in the text as it was (code points), kinds, surrogates."""
    secret = derived_key(key)
    kept = docs.drop("entities", "n_entities")
    place = kept.columns.index(text)
    schema = T.StructType([*kept.schema.fields]).add("entities", T._parse_datatype_string(ENTITY)).add("n_entities", "long")

    @lean
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, entities = [], []
            for t in batch.column(place):
                t, parts, last, own = t.as_py(), [], 0, []
                for start, end, kind, gender in detect(t or ""):
                    new = cached(kind, t[start:end], secret, gender)
                    parts += [t[last:start], new]
                    last = end
                    own.append({"start": start, "end": end, "kind": kind, "surrogate": new})
                texts.append("".join([*parts, t[last:]]) if own else t)
                entities.append(own)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            columns += [pa.array(entities, ENTITY_ARROW), pa.array([len(x) for x in entities], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "entities", "n_entities"])

    return kept.mapInArrow(replace, schema)


def clashes(found: DataFrame) -> DataFrame:
    """(kind, side, value, others) of distinct rows (kind, original, surrogate): values that go with two of the other side or more."""
    sides = [F.struct(F.lit(x).alias("side"), F.col(x).alias("value")) for x in ("original", "surrogate")]
    return found.select("kind", F.explode(F.array(*sides)).alias("at")).groupBy("kind", "at.side", "at.value").agg(
        F.count("*").alias("others")).filter("others > 1")


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, side, value, others): surrogates of two different originals and originals with two surrogates; there should be none.

    Equal pairs are counted once before the shuffle.
    """
    secret = derived_key(key)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {
                (kind, t[a:b], cached(kind, t[a:b], secret, gender))
                for t in filter(None, batch.column("text").to_pylist()) for a, b, kind, gender in detect(t)
            }
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] or [pa.array([], pa.string())] * 3,
                                  ["kind", "original", "surrogate"])

    return clashes(docs.select("text").mapInArrow(pairs, "kind string, original string, surrogate string").distinct())


def op9_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    if not collisions(docs).isEmpty():
        raise ValueError("two entities share a surrogate, or one has two")
    return pseudonymised(docs).select(
        "doc_id", "text", "n_entities", F.to_json("entities").alias("entities")
    )


def anonymous(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """The stage of the pipeline: the same documents and columns, with surrogates in the text."""
    # columns that have the names of the operator's own pass it under other ones
    aside = {c: f"{c}_of_{'_'.join(docs.columns)}" for c in ("entities", "n_entities") if c in docs.columns}
    out = pseudonymised(docs.withColumnsRenamed(aside), key)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
