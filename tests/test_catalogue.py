import pytest
from oracle import differences

from propagon import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.SQL[name], sf_dir) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", ["event_scores", "network_labels", "stratified_labels", "score_rank_labels"])
def test_rounded_scores_agree_on_more_rows(spark, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.SQL[name], "/root/testdata/sf0.01") == ""
