"""Secret spans, ownership counts and redaction against a plain scan."""

import hashlib
import random
import re

import pytest

from lapspark.llm import secret_scan

BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
KEY = "aB3dE5fG7hI9jK1lM3nO5"


def base_spans(text):
    found = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(odd_texts):
    rnd = random.Random(3)
    parts = [
        "token", "Token", "api_key", "APIKEY", "password", "secret", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678",
        "0123456789abcdef", "deadbeef", "é", "\n", "😀", "==", "/+", "x", "zzzzzzzzzzzz", "ſecret", "toKen",
    ]
    return odd_texts + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)] + [
        'secret="abcdefghijkl"' * 300, "AKIA" * 4 + "X" * 12, "a" * 16 + "G" + "b" * 15, "token=secret:abcdefghijklm",
    ]


def test_base_spans(make_docs, texts):
    got = {r.doc_id: r for r in secret_scan.scan_secrets(make_docs(texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        count = [sum(x[1] == k for x in want) for k in range(3)]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == count, repr(t)
        assert got[i].base_sha256 == digest(want), repr(t)
        listed = [s for s in got[i].spans.split(",") if s and not s.startswith("opaque")]
        assert listed == [f"{k}:{s}:{e}" for s, _, e, k in want]


def test_ownership_decides(make_docs):
    own, shared = KEY, KEY[::-1]
    docs = make_docs(
        [f"x {own} y", f"é {own}", f"see {shared}", f"see {shared}", "example_key_12345678901", f"token={own}"],
        sources=["a", "a", "a", "b", "a", None])
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs).collect()}
    assert rows[2].spans == rows[3].spans == "" and rows[4].spans == ""
    # A missing owner is one more, so the key of document 5 has two owners and is a copied example.
    assert rows[0].spans == "" and rows[5].spans == "assign:0:27" and (rows[5].n_live, rows[5].n_copied) == (0, 1)
    only = {r.doc_id: r for r in secret_scan.scan_secrets(docs.where("doc_id < 2")).collect()}
    assert only[0].spans == "opaque:2:23" and only[1].spans == "opaque:2:23" and only[0].n_live == 1
    counted = {(r.n_repositories, r.n_owners) for r in secret_scan.ownership(docs).collect()}
    assert counted == {(3, 2), (2, 2)}


def test_added_spans_touch_no_base_span(make_docs):
    text = f"long_name_with_1_token: {KEY}\n{KEY[::-1]}"
    row = secret_scan.scan_secrets(make_docs([text])).first()
    assert row.spans == f"assign:17:{24 + len(KEY)},opaque:{25 + len(KEY)}:{25 + 2 * len(KEY)}"


def test_redaction(make_docs):
    texts = [f"é token = {KEY} end", None, "", f"a {KEY[::-1]}", "plain", f"{KEY} {KEY[1:]}X"]
    docs = make_docs(texts, sources=["a"] * 6)
    out = secret_scan.redact_secrets(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(rows) == 6
    assert [rows[i].text for i in range(6)] == [
        "é [SECRET] end", None, "", "a [SECRET]", "plain", "[SECRET] [SECRET]"]
    assert rows[0].n_chars == len("é [SECRET] end") and rows[0]._row == "x"


def test_repeated_rows_and_empty(spark, make_docs):
    df = spark.createDataFrame([(1, f"token={KEY}", "a")] * 2 + [(None, None, None)], "doc_id long, text string, source string")
    rows = secret_scan.scan_secrets(df).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.n_live) for r in rows) == [(0, 0, 0), (1, 1, 1), (1, 1, 1)]
    assert secret_scan.scan_secrets(make_docs(["x"]).limit(0)).collect() == []
    assert secret_scan.redact_secrets(make_docs(["x"]).limit(0)).collect() == []
