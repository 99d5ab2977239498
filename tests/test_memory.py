"""Rules of the memory model that the tables of the driver do not reach."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import temporal
from factloom.operators import community, compaction, formation, governance, ledger, log, recall, vectors
from factloom.plans.session import stored


def test_seven_views_of_one_superseded_fact(spark):
    rows = [("p", "", "ann", "lives_in", "c1", "Rome", "2024-03-01", "2024-03-02", 1), ("p", "", "ann", "lives_in", "c2", "Oslo", "2024-06-01", "2024-06-02", 2)]
    claims = spark.createDataFrame(rows, "scope string, account string, subject_id string, predicate string, claim_id string, object_value string, v string, l string, arrival int")
    claims = claims.withColumn("valid_from", F.col("v").cast("timestamp")).withColumn("learned_at", F.col("l").cast("timestamp"))
    facts, history = formation.fact_versions(claims)
    read = lambda v, k: sorted(r.object_value for r in temporal.read(facts, history, v, k).collect())
    assert read(None, None) == ["Oslo"]
    assert read("2024-04-01", None) == ["Rome"]
    assert read("2024-07-01", None) == ["Oslo"]
    assert read(None, "2024-04-01") == ["Rome"]
    assert read(None, "2024-07-01") == ["Oslo"]
    assert read("2024-04-01", "2024-07-01") == ["Rome"]
    assert read("2024-07-01", "2024-04-01") == ["Rome"]


def test_supersession_equals_a_row_by_row_run(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for key in range(40):
        top = None
        for i in range(rng.randint(1, 9)):
            start = rng.randint(1, 6)
            cid = f"{key}:{i}"
            rows.append(("p", "", f"s{key}", "has_status", cid, start, i))
            want[cid] = top is None or start > top
            top = start if want[cid] else top
    df = spark.createDataFrame(rows, "scope string, account string, subject_id string, predicate string, claim_id string, start int, arrival int")
    df = df.withColumn("valid_from", F.expr("timestamp'2024-01-01' + make_dt_interval(start)")).withColumn("learned_at", F.expr("timestamp'2024-01-01' + make_dt_interval(arrival)"))
    got = {r.claim_id: r.accepted for r in formation.supersede(df.repartition(3)).collect()}
    assert got == want


def test_fanout_counts_facts_without_another_end_and_flags_the_cap(spark):
    rows = [("h", f"f{i}", None if i == 0 else f"n{i}") for i in range(5)]
    facts = spark.createDataFrame([(*r, "knows") for r in rows], "subject_id string, fact_id string, object_id string, predicate string")
    edges = [(r.fact_id, r.capped) for r in recall.directed_edges(facts, 3).where("entity_id = 'h' and direction = 'out'").collect()]
    assert sorted(edges) == [("f1", True), ("f2", True)]


def test_walk_keeps_simple_paths_and_the_shortest(spark):
    rows = [("a", "f1", "b", "knows"), ("b", "f2", "c", "likes"), ("c", "f3", "a", "made"), ("b", "f4", "b", "is")]
    facts = spark.createDataFrame(rows, "subject_id string, fact_id string, object_id string, predicate string")
    starts = spark.createDataFrame([("q", "a")], "question_id string, anchor_id string")
    got = {r.fact_id: (r.hops, r.path, r.via) for r in recall.walk(starts, recall.directed_edges(facts, 64), 2).collect()}
    assert got == {"f1": (1, ["a", "b"], ["knows"]), "f3": (1, ["a", "c"], ["made"]), "f2": (2, ["a", "b", "c"], ["knows", "likes"])}


def test_refused_twin_does_not_take_the_key(spark):
    cols = "scope string, source_id string, ordinal int, subject string, object string, predicate string, quote string, content string, polarity string, tense string, subject_type string, object_type string"
    base = ("p", "o1", 0, "Ann", "Bob", "knows")
    rows = [(*base, "met Bob", "Ann met Bob", "denied", "present", "person", "person"), (*base, "met Bob", "Ann met Bob", "asserted", "present", "person", "robot"), (*base, "met  Bob", "Ann met Bob", "asserted", "present", "person", "person")]
    vocabulary = spark.sql("SELECT 'knows' AS predicate, 's' AS semantic_type, 'many' AS cardinality, 'person' AS object_kind, false AS event")
    got = formation.admit(spark.createDataFrame(rows, cols), vocabulary, ["it"]).collect()
    assert sorted((r.reason or "") for r in got) == ["", "duplicate_claim", "not_asserted"]
    assert {r.object_type for r in got} == {"person"}


def test_unattributed_lineage_protects_a_shared_fact_only(spark):
    rows = [("p", "fact", "f1", "o1", "u1"), ("p", "fact", "f1", "o2", None), ("p", "fact", "f2", "o1", "u1"), ("p", "community_report", "r1", "o1", "u1"), ("p", "community_report", "r1", "o2", "u2")]
    lineage = spark.createDataFrame(rows, "scope string, projection_kind string, projection_id string, source_id string, data_subject_id string")
    got = {r.projection_id: r.outcome for r in governance.erase_subject(lineage, "u1").collect()}
    assert got == {"f1": "kept", "f2": "deleted", "r1": "deleted"}


def test_watermark_of_no_backlog_and_of_a_backlog_from_the_start(spark):
    rows = [("a", 0, True, False), ("a", 1, True, False), ("b", 0, False, False), ("b", 1, True, False), ("c", 0, True, False), ("c", 1, False, True), ("c", 2, False, False)]
    got = {r.scope: (r.stored, r.formed) for r in log.freshness(spark.createDataFrame(rows, "scope string, log_offset int, formed boolean, parked boolean")).collect()}
    assert got == {"a": (1, 1), "b": (1, None), "c": (2, 1)}


def test_reads_coalesce_in_anchored_windows(spark):
    rows = [("c", "p", t) for t in (0, 30, 59, 60, 200)]
    df = spark.createDataFrame(rows, "principal string, project string, s int").withColumn("occurred_at", F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, s)"))
    got = sorted((r.window_start.minute * 60 + r.window_start.second, r.kind, r.magnitude) for r in ledger.coalesce_reads(df, 60).collect())
    assert got == [(0, "first", 1), (0, "further", 2), (60, "first", 1), (200, "first", 1)]


def test_two_cliques_are_two_communities_in_any_order(spark):
    pairs = [("p", *sorted(e), 1.0) for g in (["a", "b", "c", "d"], ["w", "x", "y", "z"]) for e in itertools.combinations(g, 2)] + [("p", "d", "w", 0.1)]
    got = set()
    for seed in (1, 2):
        random.Random(seed).shuffle(pairs)
        df = spark.createDataFrame(pairs, "scope string, a string, b string, weight double")
        labels = community.components(df, lambda d: stored(d, "t"))
        rows = community.hierarchy(df, labels, lambda d: stored(d, "t")).where("level = 0").collect()
        groups: dict = {}
        for r in rows:
            groups.setdefault(r.community, set()).add(r.node)
        got.add(frozenset(frozenset(g) for g in groups.values()))
    assert got == {frozenset({frozenset("abcd"), frozenset("wxyz")})}


def test_rollup_leaves_the_newest_turns_and_closes_gaps(spark):
    rows = [("p", "u", i, i in (3, 4)) for i in range(14)]
    got = sorted((r.from_offset, r.to_offset, r.covered) for r in compaction.plan_turns(spark.createDataFrame(rows, "scope string, subject string, log_offset long, summarised boolean"), 4, 2).collect())
    assert got == [(0, 2, 3), (5, 8, 4)]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_approximate_neighbours_reach_the_recall(spark, size):
    items = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").selectExpr("vec_id as item_id", "embedding")
    rows = items.orderBy("item_id").collect()
    ids, m = np.array([r.item_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = items.where("item_id % 100 = 0").withColumnRenamed("item_id", "query_id")
    got = vectors.approximate_topk(items, asked, 10, m.shape[1]).collect()
    hits, n = 0, 0
    for q in np.flatnonzero(ids % 100 == 0):
        sims = m @ m[q]
        found = {r.item_id: r.similarity for r in got if r.query_id == ids[q]}
        assert len(found) == 10 and all(abs(sims[np.searchsorted(ids, i)] - x) < 1e-9 for i, x in found.items())
        hits += len(found.keys() & set(ids[np.lexsort((ids, -np.round(sims, 9)))[:10]].tolist()))
        n += 10
    assert hits >= 0.9 * n


def test_plans_have_no_nested_loops(spark, sf):
    from factloom import catalog

    for name in ("walk_two_hops", "recall_bundle", "recall_co_derived", "erasure_by_subject", "supersession"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_terms_of_questions_take_marks_and_possessives_off(spark):
    from factloom.functions.text import question_terms, terms_of

    asked = ["Where does Ann-Marie's brother, Bob live?", "'quoted' -- words", "", "  ", "O'Neil's"]
    rows = spark.createDataFrame([(x,) for x in asked], "q string").select("q", terms_of(F.col("q")).alias("t")).collect()
    assert {r.q: r.t for r in rows if "--" not in r.q} == {x: question_terms(x) for x in asked if "--" not in x}
