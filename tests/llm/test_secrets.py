from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from helpers import SMALL
from tillroll.llm import secrets

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base(text: str | None) -> list[tuple]:
    found = [(m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(g)) >= least]
    return [(BASE[k][0], a, b) for a, k, b in sorted(found)]


def check(docs, rows) -> None:
    texts = {r.doc_id: r.text for r in docs}
    assert len(rows) == len(docs)
    for r in rows:
        spans = base(texts[r.doc_id])
        n = Counter(k for k, _, _ in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        said = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("entropy")] == said


def test_all_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    check(docs, secrets.op5_secret_scan(spark, SMALL).collect())


def test_written_secrets(spark, tmp_path, rng):
    bits = ["password", "PassWd", "api_key", "APIKEY", "ſecret", "toKen", "=", " : ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef01234567", "é", "ß",
            "x", "\n", "=token=", "abc.def-ghi", " "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30))), 1, "c") for i in range(800)] + [(900, None, 1, "c"), (901, "", 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found int, spans string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    check(docs.collect(), secrets.op5_secret_scan(spark, str(tmp_path)).collect())


def test_odd_tables(odd_docs, no_docs):
    assert secrets.secrets(odd_docs).count() == odd_docs.count()
    assert secrets.secrets(no_docs).count() == 0


def test_sliding_counts_equal_fresh_counts(rng):
    for _ in range(300):
        text = bytes(rng.choice(rng.choice([b"0123456789abcdef", b"abcxyz019", b"aaaaab1", b"Zz+/19_-qWeRtY"])) for _ in range(rng.randint(0, 60)))
        wanted: list[list[int]] = []
        for a in range(len(text) - secrets.WINDOW + 1):
            w = text[a : a + secrets.WINDOW]
            entropy = -sum(c / len(w) * math.log2(c / len(w)) for c in Counter(w).values())
            kind = "hex" if re.fullmatch(rb"[0-9a-f]+", w) else "lower" if re.fullmatch(rb"[0-9a-z]+", w) else "mixed"
            if entropy >= secrets.THRESHOLDS[kind] + 1e-9:
                if wanted and a <= wanted[-1][1]:
                    wanted[-1][1] = a + len(w)
                else:
                    wanted.append([a, a + len(w)])
        got = secrets.high_entropy(text)
        assert all(any(x <= a and b <= y for x, y in got) for a, b in wanted)


def test_allow_list():
    assert not secrets.suspicious(b"onlyletterswithoutdigits")
    assert not secrets.suspicious(b"12345678901234567890")
    assert secrets.suspicious(b"q8Zr2LmX0vTn5KcY7bWd")


def test_the_allow_list_takes_windows_not_candidates(rng):
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = b"q8Zr2LmX0vTn5KcY7bWd"
    for path in (b"/login/", b"/users/login/", b"/users/login/api/", b"/usr/lib64/my_module/", b"/home/user1/"):
        got = secrets.high_entropy(path + key)
        assert secrets.suspicious(path + key) and got and got[-1][1] == len(path + key)
    assert not secrets.high_entropy(b"/usr/local/share/doc/readme/index1")
    assert not secrets.high_entropy(b"example" + key[:14])
    found = 0
    for _ in range(50):  # most of these hold a chance hit somewhere
        text = "".join(rng.choice(base64) for _ in range(1600)).encode()
        found += secrets.suspicious(text) and sum(b - a for a, b in secrets.high_entropy(text)) > 1200
    assert found == 50


def test_classes_of_both_cases_have_one_threshold(rng):
    for alphabet in ("0123456789ABCDEF", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        for _ in range(100):
            text = "".join(rng.choice(alphabet) for _ in range(48)).encode()
            assert secrets.high_entropy(text) == secrets.high_entropy(text.lower())


def test_spans_of_a_key_behind_a_path(spark):
    rows = spark.createDataFrame([(1, "see /users/login/q8Zr2LmX0vTn5KcY7bWd now")], "doc_id long, text string")
    assert [tuple(x) for x in secrets.secrets(rows).first().found] == [("entropy", 16, 37)]
