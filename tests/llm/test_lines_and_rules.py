import re
from collections import Counter

import duckdb
import pytest

from tessella.llm import line_dedup, quality_rules
from tests.llm.common import docs, empty, rows

SF = "/root/testdata/sf0.001"


def test_pages_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    rel = con.sql(line_dedup.ORACLE)
    names = list(rel.columns)
    want = sorted(rel.fetchall(), key=lambda r: r[0])
    got = sorted((tuple(r[n] for n in names) for r in line_dedup.page_lines(spark.read.parquet(f"{SF}/pages.parquet")).collect()), key=lambda r: r[0])
    assert got == want


def test_boilerplate_goes_at_its_own_site_only(spark):
    site = [(i, f"http://A.example/{i}", f"<p>menu</p><p>own {i}</p><script>menu</script>", "x") for i in range(20)]
    other = [(100 + i, f"http://b.example/{i}", f"<p>{'menu' if i == 0 else 'x'} </p>text {i}", "x") for i in range(20)]
    odd = [(200, None, "<p>menu</p>", "x"), (201, "http://a.example", None, "x"), (202, "no url", "<p>menu<br>menu</p>", "x"), (203, "http://c.example/", "<b>alone</b>", "x")]
    df = spark.createDataFrame(site + other + odd, "page_id long, url string, html string, lines string")
    got = {r.page_id: r for r in line_dedup.page_lines(df).collect()}
    assert all(got[i].text == f"own {i}" and got[i].n_dropped == 1 and got[i].host == "a.example" for i in range(20))
    assert got[100].text == "menu\ntext 0" and got[101].text == "text 1"
    assert got[200].text == "menu" and got[201].text == "" and got[202].text == "menu\nmenu" and got[203].text == "alone"
    assert line_dedup.page_lines(df.limit(0)).count() == 0


def test_texts_keep_columns_and_nulls(spark):
    out = line_dedup.text_lines(docs(spark))
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == docs(spark).columns
    assert Counter(r.text for r in out.collect()) == Counter(r[1] for r in rows())
    many = spark.createDataFrame([(i, f"head\nbody {i}\n\n", "s") for i in range(9)], "doc_id long, text string, source string")
    assert {r.text for r in line_dedup.text_lines(many).collect()} == {f"body {i}\n\n" for i in range(9)}


def test_passages_go_from_unlike_documents_of_a_hot_source(spark):
    passage = " ".join(f"planted{j}" for j in range(60))
    own = lambda i, k: " ".join(f"w{i}x{j}" for j in range(k))
    unlike = [(i, f"{own(i, 30)}\n{passage}\n{own(-i, 9)}" if i % 100 == 7 else own(i, 30) + "\nYes.", "hot") for i in range(2000)]
    shared = "\n".join(own(10**6 + k, 25) for k in range(12))
    near = [(5000 + i, shared + f"\nedit {i}", "hot") for i in range(3)] + [(6000 + i, shared, "hot") for i in range(30)]
    few = [(7000 + i, f"{own(7000 + i, 30)}\n{passage}", "cold") for i in range(4)]
    notice = " ".join(f"notice{j}" for j in range(9))
    lined = [(8000 + i, f"{own(8000 + i, 30)}\n{notice if i < 14 else 'x'}\n{'Oh my.' if i % 14 == 0 else 'y'}", "lined") for i in range(200)]
    bare = [(9000 + i, passage, "hot") for i in range(3)]
    given = unlike + near + few + lined + bare
    got = {r.doc_id: r.text for r in line_dedup.text_lines(spark.createDataFrame(given, "doc_id long, text string, source string")).collect()}
    assert [i for i, x in got.items() if i < 2000 and passage in x] == [7]
    assert all(got[i] == f"{own(i, 30)}\n{own(-i, 9)}" for i in range(107, 2000, 100)) and all("Yes." not in got[i] for i in (0, 1999))
    assert all(got[i] == x for i, x, _ in near + few + bare)
    assert not any(notice in got[8000 + i] for i in range(14)) and sum("Oh my." in x for x in got.values()) == 15


def reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, found = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            found |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(found)


@pytest.mark.parametrize("text", [None, "", "a b c a b c", "a a a a", "a b a b a", "x\n x\nx\nx #|<>\n\n\n", "a b c d a b c e\nb c d", "p q"])
def test_counts(spark, text):
    df = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    r = quality_rules.rules_digest(df).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == reference(text)
    assert r.base_failed and not r.kept


def test_rules_on_all_kinds_of_rows(spark):
    got = sorted((tuple(r) for r in quality_rules.rules_digest(docs(spark)).collect()), key=str)
    want = sorted(((r[0], *(c := reference(r[1])), c[0] < 50 or 2 * c[4] > c[0]) for r in rows()), key=str)
    assert [r[:7] for r in got] == want
    assert quality_rules.rules_digest(empty(spark)).count() == 0


def test_fences_adapt_to_their_group(spark):
    word = lambda i, k: " ".join(f"{'#' if k else ''}v{i}q{j}" for j in range(80))
    rows_ = [(i, word(i, False), "en", "prose") for i in range(300)] + [(1000, word(1000, True), "en", "prose")]
    rows_ += [(2000 + i, word(i, True), "en", "code") for i in range(300)] + [(3000, word(3000, True), "en", "tiny")]
    got = {r.doc_id: r.kept for r in quality_rules.rules_digest(spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000] and all(got[i] for i in range(300)) and all(got[2000 + i] for i in range(300))


def test_kept_is_right_on_labels(spark):
    df = quality_rules.rules_digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in df.filter("not base_failed").groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) == 0 and n[0, False] > n.get((0, True), 0)


def test_rules_equal_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    rel = con.sql(quality_rules.ORACLE)
    names = list(rel.columns)
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(rel.fetchall())
    for n in (1, 7):
        got = sorted(tuple(r[c] for c in names) for r in quality_rules.rules_digest(df.repartition(n)).collect())
        assert got == want


def test_fences_equal_exact_quantiles(spark):
    """Own fences of (lang, source) groups on the larger table against quartiles of the ratios themselves: a fence is off
    by no more than the widths of the bins that go into it."""
    import math

    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    counted = quality_rules.text_counts(df, "text").filter("n_words >= 50 and 2 * n_repeat_words <= n_words")
    measured = counted.selectExpr("lang", "source", *[f"cast({m.bin} as bigint) as {m.name}" for m in quality_rules.MEASURES], *[f"{m.part} / {m.whole} as x_{m.name}" for m in quality_rules.MEASURES])
    ratios = {}
    for r in measured.collect():
        ratios.setdefault((r.lang, r.source), []).append(r)
    own = 0
    for f in quality_rules.fences(measured, ["lang", "source"]).collect():
        held = ratios[f.lang, f.source]
        if len(held) < 200:
            continue
        own += 1
        for m, fence in zip(quality_rules.MEASURES, f._fences, strict=True):
            x = sorted(r[f"x_{m.name}"] for r in held)
            q25, q75 = x[math.ceil(len(x) / 4) - 1], x[math.ceil(3 * len(x) / 4) - 1]
            spread = max(q75 - q25, m.least / m.resolution)
            assert abs(fence.hi / m.resolution - (q75 + 4 * spread)) <= 9 / m.resolution
            assert not m.both or abs(fence.lo / m.resolution - (q25 - 4 * spread)) <= 9 / m.resolution
    assert own >= 1
