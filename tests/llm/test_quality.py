from __future__ import annotations

import re
from collections import Counter

from helpers import SMALL

from tillroll.llm.quality import BOILERPLATE, COUNTS, NAVIGATION, TERMINAL, op4_quality_rules, passed, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_counts_of_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op4_quality_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        found = by_hand(texts[r.doc_id])
        assert tuple(r[c] for c in COUNTS) == found
        assert r.base_failed == (found[0] < 10 or 100 * found[4] > 20 * found[0])
        assert not (r.kept and r.base_failed)


def test_edges(spark, odd_docs, no_docs):
    rows = quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert tuple(r.quality[c] for c in COUNTS) == by_hand(r.doc.text)
    assert quality(no_docs).count() == 0
    assert passed(no_docs).columns == no_docs.columns


def test_lines_go_and_documents_with_little_left(spark):
    good = "This is a plain line of eight words here.\n" "And here is another one that has enough words."
    rows = [
        (1, f"{good}\nHome | About | Contact | Search | Login\nReleased under the MIT License."),
        (2, "BUY!! THIS!! NOW!! AND!! HERE!! OR!! NEVER!! AGAIN!! YOU!! WILL!! SEE!!"),
        (3, "a###  b*** c&&& d%%% e$$$ f### g*** h&&& i%%% j$$$ k###"),
    ]
    out = {r.doc_id: r for r in passed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(out) == {1}
    assert out[1].text == good


def fails(line: str) -> bool:
    """The rules of lines, said once more."""
    low, n = line.lower(), line.count(" ") + 1
    noise = sum(len(x) for x in re.findall(r"[#*$%&|<>]{2,}", line))
    bars = sum(line.count(c) for c in "|»›•")
    tail = line.replace("\t", " ").replace("\r", " ").rstrip(" ")[-1:]
    return bool(
        noise > 0.5 * n or bars > 0.2 * n or (line.count("!") > 0.3 * n and line.count("!") >= 2)
        or (n < 4 and (not tail or tail not in TERMINAL)) or (n < 4 and re.search(NAVIGATION, line)) or any(b in low for b in BOILERPLATE)
    )


def test_verdicts_against_the_rules_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    made = [(10**6, "Plain words stand in this line.\n\n## $$ %% a\nHome | About\nshort\nshort stub!\nWOW!! SO!! GOOD!! this!! is", None, None, 1)]
    rows = quality(docs.unionByName(spark.createDataFrame(made, docs.schema))).collect()
    removed = 0
    for r in rows:
        lines = [x for x in (r.doc.text or "").split("\n") if x.replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").strip(" ")]
        stay = [x for x in dict.fromkeys(lines) if not fails(x)]
        assert r.quality.cleaned == "\n".join(stay)
        n, left = len(WORD.findall(r.doc.text or "")), len(WORD.findall("\n".join(stay)))
        assert r.quality.n_kept_words == left and r.quality.kept == (not r.quality.base_failed and n > 0 and 1 - left / n <= 0.5)
        removed += len(lines) - len(stay)
    assert removed > 20


def test_columns_of_the_caller_stay(spark):
    text = "\n".join(["Ten words and a full stop make this a sentence.", "And another one follows it with nothing bad in it."])
    names = ["doc_id", "text", "kept", "n_words", "quality", "doc", "_q_text", "cleaned", "row"]
    docs = spark.createDataFrame([(1, text, "mine", 7, "q", "d", "t", "c", 3)], names)
    out = passed(docs)
    assert out.columns == names and out.collect() == docs.collect()
    assert quality(docs).first().doc.n_words == 7


def test_labels(spark):
    kept = {r.doc_id: r.kept or r.base_failed for r in op4_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    clean = [kept[r.doc_id] for r in labels if r.quality == 1]
    assert sum(clean) / len(clean) > 0.98


def test_no_python_in_the_plan(spark, capsys):
    op4_quality_rules(spark, SMALL).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
