import pytest

from cuespan.plans.registry import ORACLES, QUERIES

from .conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(name, spark, duck):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLES:
        same_rows(found, duck.sql(ORACLES[name]).df())
    else:
        assert len(found) > 0


def test_entry_file():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship_ranks_hit_rates(spark):
    rows = {r.metric: r for r in QUERIES["q26_table_overall"](spark, SMALL).collect()}
    for c in ("transcript_only", "transcript_plus_frames"):
        assert rows["hit_rate_at_5"][c] >= rows["hit_rate_at_3"][c] >= rows["hit_rate_at_1"][c]
