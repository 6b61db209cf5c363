"""The segmented index equals a whole build after every change, writes little, merges, and survives crashes."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.functions.text import ascii_tokens, first_line
from tessella.operators import index
from tessella.operators.segments import Conflict, SegmentedIndex



def fields():
    return {"title": first_line(F.col("text")), "body": F.col("text")}


QUERIES = [(1, "alpha beta"), (2, "gamma"), (3, "nothing here"), (4, "word7 alpha")]


def state(tables):
    return [sorted(map(tuple, tables[n].select(c).collect())) for n, c in (("postings", ["term", "doc_id", "field", "len", "tf"]), ("terms", ["term", "df", "idf"]), ("fields", ["field", "n", "avg_len"]))]


def whole(spark, docs):
    return index.build(spark.createDataFrame(sorted(docs.items()), "doc_id long, text string"), "doc_id", fields(), ascii_tokens)


def frame(spark, docs):
    return spark.createDataFrame(sorted(docs.items()), "doc_id long, text string")


def bytes_below(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_every_version_equals_a_whole_build(spark, tmp_path):
    docs = {i: f"alpha word{i % 9}\nbeta {'gamma ' * (i % 3)}" for i in range(40)} | {90: "", 91: None}
    one = SegmentedIndex(spark, f"file://{tmp_path}/i", "doc_id", fields(), ascii_tokens, fanout=3)
    one.apply(frame(spark, docs))
    steps = [({3: "changed text", 4: "gamma"}, [7, 8, 1000]), ({3: "changed again alpha"}, [4]), ({7: "back again"}, []), ({}, [90, 91]), ({100 + i: "alpha new" for i in range(5)}, [3]), ({3: "alpha"}, [3])]
    for changed, gone in steps:
        one.apply(frame(spark, changed) if changed else None, spark.createDataFrame([(i,) for i in gone], "doc_id long") if gone else None)
        docs = {i: t for i, t in docs.items() if i not in gone} | changed
        assert state(one.tables()) == state(whole(spark, docs))
        found = index.bm25f_stored(one.tables(), "doc_id", {"title": (2.0, 0.3), "body": (1.0, 0.75)}, spark.createDataFrame(QUERIES, "query_id int, query string"), ascii_tokens)
        want = index.bm25f_stored(whole(spark, docs), "doc_id", {"title": (2.0, 0.3), "body": (1.0, 0.75)}, spark.createDataFrame(QUERIES, "query_id int, query string"), ascii_tokens)
        assert sorted(map(tuple, index.top_k(found, "doc_id", 5).collect())) == sorted(map(tuple, index.top_k(want, "doc_id", 5).collect()))
    assert len(one.manifest()["segments"]) < 3 * 3  # classes have merged
    before = state(one.tables())
    kept_version = one.manifest()["version"]
    one.compact()
    assert state(one.tables()) == before and len(one.manifest()["segments"]) == 1 and not one.manifest()["tombstones"]
    assert state(one.tables(kept_version)) == before  # older versions stay readable
    assert one.collect_garbage(1) and state(one.tables()) == before


def test_one_document_of_ten_thousand_writes_under_a_hundredth(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    one = SegmentedIndex(spark, f"file://{tmp_path}/i", "doc_id", fields(), ascii_tokens)
    one.apply(docs)
    built = bytes_below(tmp_path)
    assert one.manifest()["documents"] == 10_000
    one.apply(frame(spark, {17: "a single alpha topic has changed"}))
    assert bytes_below(tmp_path) - built < built / 100
    rest = docs.where("doc_id <> 17").unionByName(frame(spark, {17: "a single alpha topic has changed"}))
    asked = spark.createDataFrame([(1, "single topic"), (2, "password token license")], "query_id int, query string")
    want = index.bm25f_stored(index.build(rest, "doc_id", fields(), ascii_tokens), "doc_id", {"body": (1.0, 0.75)}, asked, ascii_tokens)
    got = index.bm25f_stored(one.tables(), "doc_id", {"body": (1.0, 0.75)}, asked, ascii_tokens)
    assert sorted(map(tuple, index.top_k(got, "doc_id", 20).collect())) == sorted(map(tuple, index.top_k(want, "doc_id", 20).collect()))


def test_lookups_push_their_terms_to_the_scans(spark, tmp_path):
    one = SegmentedIndex(spark, f"file://{tmp_path}/i", "doc_id", fields(), ascii_tokens)
    one.apply(frame(spark, {i: f"alpha w{i}" for i in range(50)}))
    one.apply(frame(spark, {3: "beta"}))
    for name in ("postings", "terms"):
        plan = one.tables()[name].where("term = 'alpha'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(term,alpha)" in plan


def test_two_writers_and_a_dead_one(spark, tmp_path):
    one = SegmentedIndex(spark, f"file://{tmp_path}/i", "doc_id", fields(), ascii_tokens)
    one.apply(frame(spark, {1: "alpha"}))
    one._claim(2)  # another writer is at work, or died
    with pytest.raises(Conflict):
        one.apply(frame(spark, {2: "beta"}))
    assert one.manifest()["version"] == 1 and one.documents().count() == 2
    one.release()
    assert one.apply(frame(spark, {2: "beta"}))["version"] == 2 and one.documents().count() == 4


def test_odd_changes(spark, tmp_path):
    one = SegmentedIndex(spark, f"file://{tmp_path}/i", "doc_id", fields(), ascii_tokens)
    assert one.tables()["postings"].count() == 0 and one.documents().count() == 0
    one.apply(deleted=spark.createDataFrame([(1,)], "doc_id long"))
    one.apply(spark.createDataFrame([(None, "x", 1), (2, "b", 1), (2, "a", 2), (3, None, 3)], "doc_id long, text string, seq int"))
    assert sorted(map(tuple, one.tables()["postings"].where("field = 'body'").select("term", "doc_id").collect())) == [("a", 2)]
    assert one.manifest()["documents"] == 2
    one.apply(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    assert one.manifest()["documents"] == 2
    one.apply(deleted=spark.createDataFrame([(2,), (3,), (3,)], "doc_id long"))
    assert one.manifest()["documents"] == 0 and one.tables()["terms"].count() == 0


def test_segments_are_counted_where_texts_are_read(spark, tmp_path, monkeypatch):
    """Default tokens: as a whole build after changes, of documents that share a key too; nothing but terms is shuffled to count
    the documents that hold them, and segments without the mark are counted as before."""
    from tessella.operators import segments

    docs = {i: f"alpha word{i % 9} Ab-c\nbeta {'gamma ' * (i % 3)} été ab 漢字" for i in range(40)} | {90: "", 91: None}
    one = SegmentedIndex(spark, f"file://{tmp_path}/i", "doc_id", fields(), fanout=3)
    one.apply(spark.createDataFrame([*docs.items(), (5, "zz later"), (None, "lost")], "doc_id long, text string"))
    for changed, gone in (({3: "changed text", 4: "gamma"}, [7, 1000]), ({3: "alpha alpha"}, [90])):
        one.apply(frame(spark, changed), spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        docs = {i: t for i, t in docs.items() if i not in gone} | changed
        want = state(index.build(frame(spark, docs), "doc_id", fields()))
        assert state(one.tables()) == want
        assert {tuple(r) for r in one.documents().collect()} >= {(91, "title", 0), (91, "body", 0)}
        with monkeypatch.context() as m:
            m.setattr(segments, "CARRIED", 0)
            assert state(one.tables()) == want
    plan = one.tables()["terms"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(term") == 1 and "SortMergeJoin" not in plan and "distinct" not in plan
    manifest = one.manifest()
    for s in manifest["segments"]:
        s.pop("first", None)
    monkeypatch.setattr(one, "manifest", lambda version=None: manifest)
    assert state(one.tables()) == want
