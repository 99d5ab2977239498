"""Generations of vectors: requests in order, builds that go on from what they lack, and folders that go as a whole."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import generations as g

MESSAGES = "scope string, source_id string, ordinal int, content string, log_offset long"
ASKED = "scope string, seq long, operation_key string, model string"
VECTORS = "generation_id string, scope string, source_id string, ordinal int, digest string, embedding array<float>"
ACTIVE = "scope string, generation_id string"


def test_requests_count_what_is_kept(spark):
    builds = spark.createDataFrame([("p", "p-x", "x", "m", "ready", 3), ("p", "p-y", "y", "m", "discarded", 3), ("q", "q-x", "x", "m", "ready", 1), ("q", "q-y", "y", "m", "ready", 1)], g.BUILDS)
    asked = [("p", 1, "x", "m"), ("p", 2, "x", "n"), ("p", 3, "a", "m"), ("p", 4, "b", "m"), ("p", 5, "a", "m"), ("p", 6, "b", "m"), ("q", 1, "a", "m"), ("q", 2, "y", "m"), ("r", 1, "a", "m")]
    messages = spark.createDataFrame([("p", "o", 0, "t", 9), ("q", "o", 0, "t", 4)], MESSAGES)
    said, after = g.start(builds, spark.createDataFrame(asked, ASKED), messages)
    got = {(r.scope, r.seq): r.outcome for r in said.collect()}
    assert got == {
        ("p", 1): "replayed", ("p", 2): "conflict", ("p", 3): "started", ("p", 4): "capacity", ("p", 5): "replayed", ("p", 6): "capacity", ("q", 1): "capacity", ("q", 2): "replayed",
        ("r", 1): "started",
    }
    assert {(r.generation_id, r.through_offset) for r in after.collect() if r.state == "building"} == {("p-a", 9), ("r-a", -1)}


def test_build_commit_activate_drop(spark, tmp_path):
    def provider(texts):
        return [[float(len(t)), 1.0] for t in texts]

    then = spark.createDataFrame([("p", f"o{i}", 0, "same" if i < 4 else f"text {i}", i) for i in range(8)] + [("p", "late", 0, "x", 99)], MESSAGES)
    now = then.where("source_id <> 'o1'").withColumn("content", F.when(F.col("source_id") == "o6", "edited").otherwise(F.col("content")))
    builds = spark.createDataFrame([("p", "p-a", "a", "m", "building", 7), ("p", "p-b", "b", "m", "building", 7)], g.BUILDS)
    none, store = spark.createDataFrame([], VECTORS), f"file://{tmp_path}/store"
    made = g.build(then, none, builds, provider, 2)
    assert made.count() == 16
    g.write(g.commit(made, now), store)
    have = lambda: spark.read.parquet(store)
    assert {(r.source_id, r.embedding[0]) for r in have().where("generation_id = 'p-a'").collect()} == {("o0", 4.0), ("o2", 4.0), ("o3", 4.0), ("o4", 6.0), ("o5", 6.0), ("o7", 6.0)}
    assert {(r.generation_id, r.source_id) for r in g.lacking(now, have(), builds).collect()} == {("p-a", "o6"), ("p-b", "o6")}
    g.write(g.commit(g.build(now, have(), builds.where("generation_id = 'p-a'"), provider, 2), now), store)
    ready, active = builds.withColumn("state", F.lit("ready")), spark.createDataFrame([("p", "p-old")], ACTIVE)
    asked = lambda *names: spark.createDataFrame([("p", n) for n in names], ACTIVE)
    said, after = g.activate(ready, active, asked("p-b"), now, have())
    assert said.first().outcome == "incomplete" and after.first().generation_id == "p-old"
    assert g.activate(builds, active, asked("p-a"), now, have())[0].first().outcome == "incomplete"
    assert g.activate(ready, active, asked("p-z"), now, have())[0].first().outcome == "not_found"
    said, after = g.activate(ready, active, asked("p-a"), now, have())
    assert said.first().outcome == "activated" and [r.generation_id for r in after.collect()] == ["p-a"]
    assert g.activate(ready, after, asked("p-a"), now, have())[0].first().outcome == "active"
    for bad in ("p-a", "p-z"):
        with pytest.raises(ValueError):
            g.drop(spark, store, ready, after, bad)
    left = g.drop(spark, store, ready, after, "p-b")
    assert {r.generation_id: r.state for r in left.collect()} == {"p-a": "ready", "p-b": "discarded"}
    assert [p.name for p in Path(tmp_path, "store").iterdir() if p.is_dir()] == ["generation_id=p-a"]
