"""Fill-in-the-middle against a plain reading of its rules, and its edge cases."""

import hashlib
import random
import re

import pytest

from sluice.llm import infill

SCHEMA = "doc_id long, text string, n string, form int"


def brute(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", "Z9", "naïve café — 日本語 text 😀 end", "x<P>y", "<S", "<<S>", "< P>S>M>", "line\r\nbreak\ttab\x00nul", "@[`{", "word " * 40_000, "é" * 70_000, "A" * 300_000]


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abZ <>PSM9é日😀\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(None if k == 7 else k // 2, t, "n", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in infill.transformed(docs).collect()]
    want = [brute(r[0], r[1]) for r in rows]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digested = sorted((r["output_sha256"], r["restored_sha256"]) for r in infill.digests(docs).collect())
    assert digested == sorted((digest(w[-1]), digest(r[1] or "")) for w, r in zip(want, rows))


@pytest.mark.parametrize("repeats", [0, 3])
def test_empty_tables_and_repeated_rows(spark, repeats):
    docs = spark.createDataFrame([(4, "some words, here", "n", 1)] * repeats, SCHEMA)
    found = [tuple(r) for r in infill.transformed(docs).collect()]
    assert found == [brute(4, "some words, here")] * repeats


def test_outputs_pass_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(infill, "HELD_CHARS", 10)
    docs = spark.createDataFrame([(k, "some words, here", "n", 1) for k in range(20)], SCHEMA)
    assert sorted(tuple(r) for r in infill.transformed(docs).collect()) == sorted(brute(k, "some words, here") for k in range(20))
