"""Registered queries against their SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import catalog, duck
from checks.compare import connect, difference

QUICK = [
    "clean_messages", "request_validation", "language_id", "prototype_scores", "event_type_labels", "urgency",
    "geocoded", "dedup_documents", "dedup_by_key", "analyze", "analyze_json", "running_totals", "priority_feed",
    "map_layer", "type_by_urgency", "results_table", "quality_by_language", "roc_curve", "kappa", "known_results",
]


def test_every_query_has_sql_or_is_named():
    own = list(catalog.QUERIES)
    assert set(own) - set(duck.oracles([n for n in own if n not in duck.NOT_IN_SQL])) == {"analyze_models", "relevance_model"}
    assert set(duck.oracles(own)) <= set(entry.oracle_sql()) and set(own) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_answer(spark, sf_dir, name):
    verdict, _, _ = difference(spark, connect(sf_dir), sf_dir, entry.queries()[name], entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "position"
