"""Shape of the physical plans."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle.statements import statements
from voltrail.plans.catalogue import all_queries

from voltrail.operators import dedup
from voltrail.sources import testviews as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["charges_final", "slope_charges", "charge_status_spans", "overlap_pairs", "duration_histogram"])
def test_no_cross_join(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "duration_histogram":  # its range is one pre-aggregated row
        assert "SinglePartition" not in text


def test_method_s_shuffles_once(spark, small):
    text = plan(entry.queries()["charges_final"](spark, small))
    assert text.count("Exchange hashpartitioning") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text


def test_copies_are_dropped_before_the_shuffle(spark, small):
    assert plan(dedup.dedup_messages(V.resent(spark, small))).count("WindowGroupLimit") == 2


def test_queries_have_statements():
    assert set(all_queries()) == set(statements())
    assert set(all_queries()) <= set(entry.queries()) and set(statements()) <= set(entry.oracle_sql())
