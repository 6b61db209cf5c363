"""Phrase collocations against brute force, with short windows, crowded bitmaps, odd rows and exact large products."""

import re
from collections import Counter

import duckdb
import pytest

from tessella.llm import collocations as co
from tessella.llm import queries
from tests.llm import common


def brute(rows, longest=5, least=100, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    out = []
    many = {p: n for p, n in counts.items() if len(p[1]) > 1 and n >= least}
    inside = Counter()
    for (lang, p), n in many.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(inside[lang, p[i : i + m]], n)
    for (lang, p), a in many.items():
        if 100 * inside[lang, p] >= 100 * a:
            continue
        cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(best)]
    return sorted(ranked)


def texts():
    rows = [("en", "The red fox runs, the red fox sleeps; The red fox runs.\nred fox\tred  fox" * 5), (None, "a b c d e f a b c d e f. a b c d e"), ("und", "a b c d e! a b"), ("de", "ÄÖ über alles über Alles ÄÖ über"), ("en", None), ("en", ""), ("en", " \n\t.,;"), ("fr", "x" * 300 + " y " + "z" * 300 + " y")]
    return rows * 3 + [("en", "of the of the of the house\r\nof the house " * 40)]


def got(spark, rows, **options):
    df = spark.createDataFrame([(t, la, "p", 1, "w") for la, t in rows], "text string, lang string, phrase string, n int, w string")
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


@pytest.mark.parametrize("window", [8 << 20, 64, 7])
def test_equals_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(co, "WINDOW_BYTES", window)
    assert got(spark, texts(), least=3, top=9) == brute(texts(), least=3, top=9)


def test_a_crowded_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(co, "BLOCK_BITS", 1 << 6)
    assert got(spark, texts(), least=2) == brute(texts(), least=2)
    monkeypatch.setattr(co, "_has", lambda bitmap, hashes: hashes == hashes)
    assert got(spark, texts(), least=4) == brute(texts(), least=4)


def test_windows_hold_every_phrase_once():
    text = b"aa b, cc\tdd " + b"e" * 50 + b" ff. g h i"
    for k in range(1, 6):
        for size in range(1, 30):
            co.WINDOW_BYTES, before = size, co.WINDOW_BYTES
            try:
                parts = list(co._windows(text, k))
            finally:
                co.WINDOW_BYTES = before
            grams = Counter()
            for p in parts:
                w = re.split(rb"[ \t.,]+", p.strip(b" \t.,"))
                grams.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if w[i])
            w = re.split(rb"[ \t.,]+", text)
            assert grams == Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)), (k, size)


def test_odd_rows_and_empty_tables(spark):
    rows = common.rows()
    found = sorted(tuple(r) for r in co.collocations(common.docs(spark), least=4).collect())
    assert found == brute([(r[2], r[1]) for r in rows], least=4)
    assert co.collocations(common.empty(spark)).collect() == []


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op12_phrase_collocations(spark, sf).collect()) == sorted(con.sql(co.ORACLE).fetchall())
