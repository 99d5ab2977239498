"""Recall by meaning on hand-made neighbours: who gets semantic anchors, which reports are listed once, how roles sift, what is told as lacking."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from compare import TABLES, same
from factloom.operators import semantic as s
from factloom.plans import semantic_queries as sq


@pytest.fixture(scope="module")
def six_children(sf, tmp_path_factory):
    """The small tables with a few vectors, of which 422 is nearest to 100 and has six written reports below it."""
    folder = tmp_path_factory.mktemp("tables")
    for t in TABLES:
        (folder / f"{t}.parquet").symlink_to(Path(sf) / f"{t}.parquet")
    (folder / "embeddings.parquet").unlink()
    made = {100: [1.0, 0.0, 0.0], 422: [1.0, 0.1, 0.0], 575: [1.0, 0.5, 0.0], 58: [1.0, 1.0, 0.0], 1: [0.0, 1.0, 1.0], 4: [0.0, 0.5, 1.0]}
    rows = {"vec_id": pa.array(list(made), pa.int64()), "embedding": pa.array(list(made.values()), pa.list_(pa.float32())), "label": pa.array([0] * len(made), pa.int32())}
    pq.write_table(pa.table(rows), folder / "embeddings.parquet")
    return str(folder)


def test_all_children_of_the_best_report_are_listed_as_in_the_sql(spark, six_children):
    found = sq.report_hits(spark, six_children)
    assert found.where("question_id = 'v:100' and parent = 'k:422'").count() == 6
    same(found, six_children, sq.ORACLES["report_hits"])


def test_surfaces_count_all_children_of_the_best_report(spark, six_children):
    found = sq.recall_surfaces(spark, six_children)
    assert found.where("question_id = 'v:100' and surface = 1").first()["items"] == 8
    same(found, six_children, sq.ORACLES["recall_surfaces"])


def test_only_questions_without_a_name_get_anchors(spark):
    hits = spark.createDataFrame([("q1", f"e{i}", 0.9 - i / 10, i + 1) for i in range(7)] + [("q2", "e1", 0.5, 1)], "question_id string, entity_id string, similarity double, place int")
    entities = spark.createDataFrame([(f"e{i}", f"E{i}") for i in range(7) if i != 1], "entity_id string, canonical_name string")
    exact = spark.createDataFrame([("q2",), ("q2",)], "question_id string")
    got = s.semantic_anchors(hits, exact, entities).orderBy("similarity", ascending=False).collect()
    assert [(r.question_id, r.anchor_id, r.matched) for r in got] == [("q1", "e0", "semantic:0.90"), ("q1", "e2", "semantic:0.70"), ("q1", "e3", "semantic:0.60"), ("q1", "e4", "semantic:0.50")]


def test_a_person_is_not_told_of_what_is_somebody_elses(spark):
    pairs = "question_id string, anchor_id string"
    both, meant = spark.createDataFrame([("q", "named"), ("q", "m1"), ("q", "m2")], pairs), spark.createDataFrame([("q", "m1"), ("q", "m2")], pairs)
    kept = spark.createDataFrame([("q", "m1"), ("q", "m1"), ("other", "m2")], pairs)
    assert {r.anchor_id for r in s.of_reader(both, kept, meant, "u1").collect()} == {"named", "m1"}
    assert s.of_reader(both, kept, meant, None).count() == 3


@pytest.mark.parametrize("first", ["top", "gone", "leaf"])
def test_reports_below_the_best_are_listed_once(spark, first):
    order = {"top": ["top", "c2", "far", "more"], "gone": ["gone", "top", "c2", "far"], "leaf": ["leaf", "top", "far", "more"]}[first]
    hits = spark.createDataFrame([("q", c, 0.9 - i / 10, i + 1) for i, c in enumerate(order)], "question_id string, community string, similarity double, place int")
    reports = spark.createDataFrame([(c, "t", "words") for c in ("top", "leaf", "far", "more", *[f"c{i}" for i in range(2, 9)])], "community string, title string, summary string")
    tree = spark.createDataFrame([("top", None, 0), *[(f"c{i}", "top", 1) for i in range(1, 9)]], "community string, parent string, level int")
    got = [(r.community, r.parent) for r in s.report_hits(hits, reports, tree).orderBy("place").collect()]
    kids = [(f"c{i}", "top") for i in range(2, 7)]  # c1 has no report; five at most
    far = [("far", None)]
    assert got == {"top": [("top", None), *kids, *far], "gone": [("top", None), *kids, *far], "leaf": [("leaf", None), ("top", None), *far]}[first]


def test_roles_are_sought_or_sifted(spark):
    rows = spark.createDataFrame([("q", f"m{i}", "user" if i % 3 else "tool", i) for i in range(20)], "question_id string, item_id string, role string, place int")
    search = lambda role, k: (rows if role is None else rows.where(f"role = '{role}'")).orderBy("place").limit(k)
    of = lambda roles: [r.item_id for r in s.passage_hits(search, roles).orderBy("place").collect()]
    assert of(["tool"]) == ["m0", "m3", "m6", "m9", "m12", "m15", "m18"] and of(["tool", "assistant"]) == ["m0", "m3", "m6"]
    assert of(["user", "assistant", "tool", "system"]) == [f"m{i}" for i in range(8)] and of([]) == []


def test_what_an_answer_lacks_is_named(spark):
    one = lambda *q: spark.createDataFrame([(x,) for x in q], "question_id string")
    of = lambda subject, missing: {r.question_id: r.degraded for r in s.degraded(one("a", "b", "c"), one("b", "c"), one("a", "b"), subject, missing).collect()}
    assert of(None, []) == {"a": ["citation_context"], "b": ["citation_context"], "c": []}
    assert of("u", ["reports"]) == {"a": ["citation_context"], "b": ["citation_context", "reports_withheld_for_subject"], "c": ["reports_withheld_for_subject"]}
    assert of(None, ["semantic_anchors", "reports", "passages"]) == {"a": ["citation_context", "passages"], "b": ["semantic_anchors", "reports", "passages"], "c": ["semantic_anchors", "reports", "passages"]}
