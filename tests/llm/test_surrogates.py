from __future__ import annotations

from helpers import SMALL
from tillroll.llm import surrogates as s


def test_permutations_are_one_to_one():
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(s.permuted(v, size, b"key", "t") for v in range(size)) == list(range(size))


def test_formats_and_kinds_are_kept(rng):
    key = s.derived_key(b"k")
    assert s.surrogate("phone", "+49 171 1234567", key).startswith("+49 ")
    assert s.luhn(s.surrogate("card", "4111 1111 1111 1111", key))
    assert s.surrogate("ip", "192.168.0.7", key).count(".") == 3
    assert s.surrogate("name", "Anna", key, "f") in s.FIRST_F and s.surrogate("name", "David", key, "m") in s.FIRST_M
    new = s.surrogate("name", "Иван", key)
    assert len(new) == 4 and new[0].isupper() and all("а" <= c <= "я" for c in new[1:])
    a, b = s.surrogate("email", "anna@mail.org", key), s.surrogate("email", "bert@mail.org", key)
    assert a.partition("@")[2] == b.partition("@")[2] and a != b
    ssns = {f"{rng.randint(0, 999):03}-{rng.randint(0, 99):02}-{rng.randint(0, 9999):04}" for _ in range(3000)}
    assert len({s.surrogate("ssn", x, key) for x in ssns}) == len(ssns)


def test_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = s.pseudonymised(frame).collect()
    assert len(rows) == len(docs) and any(r.n_entities for r in rows)
    seen: dict[tuple, str] = {}
    for r in rows:
        old, parts, last = docs[r.doc_id], [], 0
        for e in r.entities:
            parts += [old[last : e.start], e.surrogate]
            last = e.end
            assert seen.setdefault((e.kind, old[e.start : e.end]), e.surrogate) == e.surrogate
        assert r.text == ("".join([*parts, old[last:]]) if old is not None else None)
    assert s.collisions(frame).isEmpty()
    assert s.op9_pii_surrogates(spark, SMALL).count() == len(docs)


def test_odd_tables(spark, odd_docs, no_docs):
    assert s.anonymous(odd_docs).columns == odd_docs.columns
    assert sorted(map(str, s.anonymous(odd_docs).select("doc_id", "text").collect())) == sorted(map(str, odd_docs.select("doc_id", "text").collect()))
    assert s.anonymous(no_docs).count() == 0 and s.collisions(no_docs).isEmpty()


def test_names_keep_their_surrogate_under_any_title(spark):
    names = [*s.FIRST_F, *s.FIRST_M, "Schmidt", "Otto", "Mia", "Alina"]
    titles = ["Dr", "Prof", "Mrs", "Frau", "Mr", "Herr"]
    docs = spark.createDataFrame([(i, f"{t} {n} {m}") for i, (t, n, m) in enumerate((t, n, m) for t in titles for n in names for m in ("met", "Braun"))],
                                 "doc_id long, text string")
    rows = {r.text: r.entities for r in docs.join(s.pseudonymised(docs).select("doc_id", "entities"), "doc_id").collect()}
    new = {n: {rows[f"{t} {n} met"][0].surrogate for t in titles} for n in names}
    assert all(len(x) == 1 for x in new.values())  # "Dr Anna" beside "Frau Anna"
    assert len(set.union(*new.values())) == len(names)
    assert rows["Dr Thomas met"][0].surrogate in s.FIRST_M and rows["Mrs Martin met"][0].surrogate in s.FIRST_M
    assert s.collisions(docs).isEmpty()


def test_both_kinds_of_clashes(spark):
    found = spark.createDataFrame([("name", "a", "x"), ("name", "b", "x"), ("name", "c", "y"), ("name", "c", "z"), ("ip", "a", "q")],
                                  "kind string, original string, surrogate string")
    assert sorted(map(tuple, s.clashes(found).collect())) == [("name", "original", "c", 2), ("name", "surrogate", "x", 2)]
