"""Plans: filters and columns reach the scan, nothing crosses that should not."""

import contextlib
import io

from tessella import registry

SF = "/root/testdata/sf0.001"


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_the_columns_they_need(spark):
    plan = explained(registry.queries()["compile_digest"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in plan
    plan = explained(registry.queries()["tumbling_counts"](spark, SF))
    assert "html" not in plan and "embedding" not in plan


def test_filters_are_pushed_down(spark):
    plan = explained(registry.queries()["latency_distribution"](spark, SF))
    assert "EqualTo(event_type,view)" in plan


def test_theta_joins_became_equi_joins(spark):
    for name in ("asof_pairing", "path_suffix_join", "fuzzy_edit_join", "trigram_dice_join", "trigger_containment"):
        plan = explained(registry.queries()[name](spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_no_python_in_relational_plans(spark):
    for name in ("bm25_topk", "bm25f_two_fields", "delivery_funnel", "cohort_latency", "session_windows", "audit_rules", "query_classify"):
        plan = explained(registry.queries()[name](spark, SF))
        assert not any(node in plan for node in ("EvalPython", "InPandas", "InArrow")), name


def test_retrieval_reads_stored_postings_by_term(spark):
    for name in ("bm25_topk", "rrf_fusion", "relative_score_cut"):
        plan = explained(registry.queries()[name](spark, SF))
        assert "In(term, [" in plan, name
        assert "documents.parquet" not in plan and "text:string" not in plan, name


def test_ab_compare_expects_documents_in_other_case(spark, tmp_path):
    from tessella.functions.text import ascii_tokens
    from tessella.plans import quality

    spark.createDataFrame([(0, "One two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "x one, two THREE four five six y"), (2, "One two three four five six"), (3, "one two")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.expected for r in quality._expected(spark, str(tmp_path), ascii_tokens).collect()) == [1, 2]
    assert sorted(r.expected for r in quality._expected(spark, str(tmp_path)).collect()) == [2]
