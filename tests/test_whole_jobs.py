"""Queries that do their whole job, against plain Python."""

import itertools
from datetime import datetime, timedelta

import duckdb
import pytest

from factloom import catalog
from factloom.operators import governance, ledger
from factloom.plans import ops_queries

START = datetime(2024, 1, 1)
READS = "principal string, project string, occurred_at timestamp"


def test_a_name_registered_twice_is_refused():
    assert catalog.united([{"a": 1}, {"b": 2}]) == {"a": 1, "b": 2}
    with pytest.raises(ValueError, match="'a'"):
        catalog.united([{"a": 1}, {"a": 2}])


def test_coalesced_reads_have_a_row_for_the_first_read_of_every_window(spark, sf):
    """Windows of six hours of allowed reads; a window with one read has a row too."""
    sql = f"SELECT 'u' || user_id, 'p' || (user_id % 4), ts FROM '{sf}/events.parquet' WHERE coalesce(event_type, '') <> 'error' AND coalesce(event_id % 17, 1) <> 0 ORDER BY ts"
    windows: dict = {}
    for principal, project, at in duckdb.sql(sql).fetchall():
        own = windows.setdefault((principal, project), [])
        if own and at < own[-1][0] + timedelta(hours=6):
            own[-1][1] += 1
        else:
            own.append([at, 0])
    want = {(*key, at, "first", 1) for key, own in windows.items() for at, _ in own} | {(*key, at, "further", n) for key, own in windows.items() for at, n in own if n}
    got = [(*r[:2], r.window_start, r.kind, r.magnitude) for r in catalog.QUERIES["coalesced_reads"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(r[4] for r in got) == sum(1 + n for own in windows.values() for _, n in own)


def test_reads_without_a_time_or_a_caller(spark):
    """As in the SQL: no time comes last and stays in the open window; a null caller has no further reads."""
    rows = [("c", "p", START), ("c", "p", None), ("c", "p", START + timedelta(seconds=90)), ("c", "p", None), ("d", "p", None), ("d", "p", None), (None, None, START), (None, None, START + timedelta(seconds=5)), (None, None, None)]
    got = {(r.principal, (r.window_start - START).seconds if r.window_start else None, r.kind, r.magnitude) for r in ledger.coalesce_reads(spark.createDataFrame(rows, READS), 60).collect()}
    assert got == {("c", 0, "first", 1), ("c", 90, "first", 1), ("c", 90, "further", 2), ("d", None, "first", 1), ("d", None, "further", 1), (None, 0, "first", 1)}


def histories(folder, turns, extra=0):
    """Writes conversations of one subject of each scope, so many each and `extra` more in the first; gives the numbers of turns."""
    ids = [s + 33 * i for s in range(3) for i in range(turns + extra * (s == 0))]
    values = ", ".join(f"({k}::BIGINT, {t}::BIGINT, 'user', 'x')" for k in ids for t in range(2))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {values}) v(conv_id, turn, role, text)) TO '{folder}/conversations.parquet'")
    return {(f"p{s}", f"u{s}"): turns + extra * (s == 0) for s in range(3)}


def test_rollup_plan_closes_gaps_in_all_histories(spark, tmp_path):
    """Of n turns the newest two stay and the third to the fifth are summarised: the two before them are a gap, the rest are runs of three."""
    want = set()
    for key, n in histories(tmp_path, 13, 3).items():
        want |= {(*key, 0, 1, 2)} | {(*key, at, at + 2, 3) for at in range(5, n - 4, 3)}
    df = catalog.QUERIES["rollup_plan"](spark, str(tmp_path))
    assert df.columns == ["scope", "subject", "from_offset", "to_offset", "covered"]
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_long_histories_are_those_of_observations(spark, tmp_path):
    """Eight turns of two messages are kept as they are; nine are a long history."""
    want = {(*key, n) for key, n in histories(tmp_path, 8, 1).items() if n > 8}
    got = catalog.QUERIES["long_histories"](spark, str(tmp_path))
    assert got.columns == ["scope", "subject", "turns"] and set(map(tuple, got.collect())) == want == {("p0", "u0", 9)}


@pytest.mark.parametrize("name", ["recall_reach", "recall_bundle", "recall_co_derived", "recall_explain", "anchors_for_a_person"])
def test_terms_of_questions_are_not_sent_whole(spark, sf, name):
    """However small their table is, what is made of it by `explode` never goes through the driver."""
    lines = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1 :])  # noqa: B023
            assert not [x for x in below if "Generate explode" in x and "AS words" not in x and "term" in x]


def test_an_export_has_no_ceiling(spark, sf, monkeypatch):
    """More facts than any ceiling are exported; an operator that is given one still refuses."""
    n = 1_100_000
    ids = spark.range(n).selectExpr("'f:' || id as fact_id")
    facts = ids.selectExpr("fact_id", "'said' as predicate", "'s' as statement", "'user' as source_role")
    lineage = ids.selectExpr(f"'{ops_queries.SUBJECT}' as data_subject_id", "'fact' as projection_kind", "fact_id as projection_id")
    monkeypatch.setattr(ops_queries.a, "facts", lambda *_: facts)
    monkeypatch.setattr(ops_queries.a, "lineage", lambda *_: lineage)
    assert ops_queries.subject_export(spark, sf).count() == n
    with pytest.raises(ValueError, match="more than 1000 rows"):
        governance.export_sections(lineage, ops_queries.SUBJECT, {"fact": (facts, "fact_id")}, 1000)
