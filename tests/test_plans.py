"""Plans: pushed filters, pruned columns, no cartesian products."""

import pytest

import __spark_entry__ as entry
from recspark.plans.bindings import Tables
from recspark.sources import tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["weighted_profiles", "trust_graph_edges", "enriched_reviews_drop", "top_shelves", "capped_reviews", "sentence_sentiment", "folded_books", "shelf_table"])
def test_no_cartesian(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    Tables(spark, FOLDER).users().write.parquet(str(tmp_path / "users"))
    text = plan(tables.pending(spark.read.parquet(str(tmp_path / "users")), "reviews_retrieved", "gid"))
    assert "Not(EqualTo(reviews_retrieved,true))" in text or "EqualTo(reviews_retrieved,false)" in text, text
    assert "ReadSchema: struct<gid:bigint,reviews_retrieved:boolean>" in text


def test_ranked_cuts_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["capped_reviews"](spark, FOLDER))
