"""Every registered query of the engine's own operators against its SQL on DuckDB, on the smallest tables."""

import glob
import math
import os

import pytest
from helixframe import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    return x.item() if hasattr(x, "item") else x


def rows(names, table):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(same(r[i]) for i in at) for r in table), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    res = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, res.fetchall())


def test_every_query_has_sql_or_is_known_not_to():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"syn_read"}


def test_emitted_reads(spark):
    first, again = ({r.name: r for r in catalog.queries()["syn_read"](spark, SF).collect()} for _ in range(2))
    assert first and all(len(r.seq1) == len(r.qual1) == len(r.seq2) == len(r.qual2) == 50 for r in first.values())
    assert first == again


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["syn_pair", "syn_read_seq"])
def test_tiled_fragments_come_without_broadcast_haplotypes(spark, name):
    """Small tables are where the planner would broadcast; what is joined here has a row for each event or segment, so it grows with them."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize(("name", "passes"), [("syn_pair", 1), ("syn_read_seq", 2)])
def test_tiled_fragments_meet_the_reference_once(spark, name, passes):
    """Each pass over the reference crosses part with two lists of constants, which are broadcast; bases are another pass."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 2 * passes


def test_ends_of_fragments_are_found_without_joins(spark):
    """The segments come with the fragments: one pass over the reference (two lists of constants) and no join of fragments."""
    plan = catalog.queries()["syn_hap_pair"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 2
    assert "hap_start" not in "".join(x for x in plan.splitlines() if "Join" in x) and plan.count("Generate explode(sequence(from") == 1


def test_emitted_reads_meet_the_reference_once(spark):
    """Bases come with the places of fragments, of which only both ends go to Python."""
    df = catalog.queries()["syn_read"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("BroadcastNestedLoopJoin") == 2
