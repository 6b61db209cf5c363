"""Postings of a stored index: counted where texts are read, and equal to grouped tokens."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tessella.functions import concepts, tokenizer
from tessella.functions.text import first_line
from tessella.operators import compile as compiler
from tessella.operators import index

def fields():
    return {"title": first_line(F.col("text")), "body": F.col("text")}


def documents(spark):
    return spark.createDataFrame([(1, "Ab ab x\nsrc/a.py"), (2, "été Ab"), (3, None), (4, "настройка прокси")], "doc_id long, text string")


def test_counts_are_those_of_the_tokens():
    draw = random.Random(5)
    letters = "aAbZ09 ._:/\\-ßéÉœł’\n\x01­́½一กЖﬁİŉ"
    texts = [None, "", "a", "a-b x.y/z_1 A1B2", "foo-barß", "..//a//b", *["".join(draw.choices(letters[: draw.choice((12, 19, len(letters)))], k=draw.randint(0, 14))) for _ in range(20_000)]]
    for text in texts:
        assert tokenizer.count_tokens(text) == Counter(tokenizer.tokenize(text)), repr(text)


def test_postings_equal_grouped_tokens_without_a_shuffle(spark):
    held = index.counted(documents(spark), "doc_id", fields())
    plan = index.by_term(held)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    grouped = index.counted(documents(spark), "doc_id", fields(), tokenizer.tokens)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, grouped.select(held.columns).collect())) != []
    assert {(r.doc_id, r.term) for r in held.filter("first").collect()} == {(r.doc_id, r.term) for r in held.collect()}


def test_document_frequencies_need_no_pairs_of_terms_and_documents(spark):
    df = index.document_frequencies(index.counted(documents(spark), "doc_id", fields()))
    assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert {r.term: r.df for r in df.collect()}["ab"] == 2


def test_none_at_all(spark):
    bare = index.build(documents(spark).limit(0), "doc_id", fields())
    assert bare["postings"].count() == 0 and bare["terms"].count() == 0


def test_a_batch_without_an_index_makes_one_of_its_terms(spark, tmp_path):
    (tmp_path / "source").mkdir()
    (tmp_path / "source" / "a.txt").write_text("x")
    docs = documents(spark).unionByName(spark.range(10, 900).selectExpr("id as doc_id", "concat('ab c', id, '\\nsrc/a.py ab x', id % 7, ' 漢字') as text"))
    queries = spark.createDataFrame([(1, "Ab src/a.py"), (2, "漢字 fooBar x3"), (3, "absent")], "query_id int, query string")
    root, sources = str(tmp_path / "store"), [str(tmp_path / "source")]
    some, whole = compiler.open_for(spark, root, sources, queries, docs, "doc_id", fields()), index.build(docs, "doc_id", fields())
    terms = index.batch_terms(queries)
    assert {"ab", "src/a.py", "src", "漢字", "foo", "foobar", "x3"} <= terms
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    for name in ("postings", "terms"):
        assert rows(some[name]) == rows(whole[name].filter(F.col("term").isin(list(terms)))) != []
    assert rows(some["fields"]) == rows(whole["fields"])
    assert concepts.common_terms(some) == concepts.common_terms(whole) & terms
    assert some["postings"].count() < whole["postings"].count()
    weights = {"title": (2.5, 0.35), "body": (1.0, 0.75)}
    found = lambda tables: rows(index.top_k(index.bm25f_stored(tables, "doc_id", weights, queries), "doc_id", 1_000))
    assert found(some) == found(whole) != []
    stored = compiler.open_index(spark, root, sources, index.makers(docs, "doc_id", fields()))["postings"]
    assert rows(compiler.open_for(spark, root, sources, queries, docs, "doc_id", fields())["postings"]) == rows(stored)


def test_a_batch_of_very_many_terms_reads_the_whole_index(spark):
    assert index.batch_terms(spark.createDataFrame([(" ".join(f"w{i}" for i in range(2_000)),)], "query string")) is None
    assert index.batch_terms(spark.range(1_500).selectExpr("'ab' as query")) is None


def test_accented_words_fold_by_letters_as_by_words(monkeypatch):
    words = ["ß", "é", "éa", "1é", "a1é", "ŋa", "ħœæ", "łódź", "straße", "đ", "þ", "ijé", "éß1"]
    want = {w: Counter(tokenizer.word_tokens(w)) for w in words}
    monkeypatch.setattr(tokenizer, "word_tokens", lambda *a: 1 / 0)  # no word is looked up by itself
    for w in words:
        assert tokenizer.count_tokens(w) == want[w], w
    assert tokenizer.count_tokens(" ".join(words * 2)) == sum((c + c for c in want.values()), Counter())
