import corpus_pipeline
from tessella.llm import mixing

from tests.llm import common

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == docs.columns for d in seen[:-1])
    start, good, cut, single, mixed, packed = ([r for r in d.collect()] for d in seen)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = {r.doc_id for r in start if labels.get(r.doc_id) == 1}
    assert len(clean - {r.doc_id for r in good}) <= 0.03 * len(clean) + 1  # only some forty labels to learn from
    assert {r.doc_id for r in cut} == {r.doc_id for r in good} and all(r.n_chars == len(r.text) for r in cut)
    assert len({r.text for r in single}) == len(single) and {r.doc_id for r in single} <= {r.doc_id for r in cut}
    copies = [r.doc_id for r in mixed]
    assert max(map(copies.count, set(copies))) <= 2
    words = sum(r[0] for r in seen[3].select(mixing.word_count(seen[3].text)).collect())
    taken = sum(r[0] for r in seen[4].select(mixing.word_count(seen[4].text)).collect())
    assert abs(taken - 1.5 * words) < 0.05 * words
    assert sum(r.piece == 0 for r in packed) == len(mixed)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


CLASHING = "host_lines _lines _text n_lines n_dropped n_passages _gone _of _stays _host _id _old _pages _n held c0 c1 site id whole parts site.dotted label labels score features rules quality cls class_id copies _row row taken size target pattern h a b k idx before".split()


def test_odd_rows_and_clashing_names_in_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, and further columns with names that the stages use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([r[:5] for r in common.rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])
    seen = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in CLASHING), name
        if name != "quality classifier":
            seen = out
        if name == "line dedup":
            kept = {(r.doc_id, r.text) for r in out.collect()}
            assert out.count() == docs.count() and kept == {(r[0], r[1]) for r in common.rows()}
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()


def test_empty_tables_in_every_stage(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
