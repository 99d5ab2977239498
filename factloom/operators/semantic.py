"""Recall by meaning: anchors for questions that name nothing, reports with the children of the best, passages by role.

Each surface starts from the nearest items of many questions (`query_id, item_id, similarity, place`, as `vectors.exact_topk` gives them),
so what is joined here is a few rows a question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import ROLES

# How many of each a question gets.
ANCHORS, REPORTS, CHILDREN, PASSAGES = 4, 3, 5, 8


def semantic_anchors(hits: DataFrame, exact: DataFrame, entities: DataFrame, most: int = ANCHORS) -> DataFrame:
    """`question_id, anchor_id, canonical_name, similarity, matched`: where a walk starts for questions that no name anchors.

    `hits`: `question_id, entity_id, similarity, place`, nearest entities. An entity that is gone is none; a question with an exact anchor
    (`exact`: question_id) gets none."""
    rows = hits.join(exact.select("question_id").distinct(), "question_id", "left_anti").join(entities.select("entity_id", "canonical_name"), "entity_id")
    order = Window.partitionBy("question_id").orderBy("place", "entity_id")
    rows = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    matched = F.format_string("semantic:%.2f", "similarity")
    return rows.select("question_id", F.col("entity_id").alias("anchor_id"), "canonical_name", "similarity", matched.alias("matched"))


def of_reader(anchors: DataFrame, kept: DataFrame, semantic: DataFrame, data_subject: str | None) -> DataFrame:
    """Anchors that a reader may be told of. In a recall narrowed to one person a semantic anchor without a kept fact is somebody else's."""
    if data_subject is None:
        return anchors
    own = kept.select("question_id", "anchor_id").distinct().withColumn("_kept", F.lit(True))
    meant = semantic.select("question_id", "anchor_id").distinct().withColumn("_meant", F.lit(True))
    rows = anchors.join(own, ["question_id", "anchor_id"], "left").join(meant, ["question_id", "anchor_id"], "left")
    return rows.where(F.col("_meant").isNull() | F.col("_kept")).drop("_kept", "_meant")


def report_hits(hits: DataFrame, reports: DataFrame, hierarchy: DataFrame, most: int = REPORTS, children: int | None = CHILDREN) -> DataFrame:
    """`question_id, place, community, parent, level, similarity, size`: the nearest reports, the best one followed by reports below it.

    `hits`: `question_id, community, similarity, place`, of which those without a report are passed over. `reports`: `community, title,
    summary`. `hierarchy`: `community, parent, level`. Only the first of the `most` nearest brings its children, in the order of their names,
    all of them if `children` is None. A report listed as a child is not listed again."""
    written = reports.select("community", (F.char_length("title") + F.char_length("summary")).alias("size"))
    near = hits.join(written, "community").withColumn("a", F.row_number().over(Window.partitionBy("question_id").orderBy("place", "community")))
    none = {"parent": F.lit(None).cast("string"), "level": F.lit(None).cast("int"), "b": F.lit(0)}
    direct = near.where(F.col("a") <= most).withColumns(none).select("question_id", "community", "parent", "level", "similarity", "size", "a", "b")
    best = direct.where("a = 1").select("question_id", F.col("community").alias("parent"))
    below = hierarchy.where("parent is not null").join(best, "parent").join(written, "community")
    order = Window.partitionBy("question_id").orderBy("community")
    below = below.withColumn("b", F.row_number().over(order))
    if children is not None:
        below = below.where(F.col("b") <= children)
    below = below.select("question_id", "community", "parent", "level", F.lit(None).cast("double").alias("similarity"), "size", F.lit(1).alias("a"), "b")
    rows = direct.unionByName(below)
    first = Window.partitionBy("question_id", "community").orderBy("a", "b")
    rows = rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("a", "b"))
    return rows.select("question_id", place.alias("place"), "community", "parent", "level", "similarity", "size")


def passage_hits(search, roles: list[str], most: int = PASSAGES) -> DataFrame:
    """`question_id, item_id, role, similarity, place` of messages. `search(role, k)` gives the k nearest, of one role or of all.

    One role is looked for among its own messages; several are sifted out of the nearest of all, so fewer may be left; no role gives none."""
    if len(roles) == 1:
        return search(roles[0], most)
    rows = search(None, most)
    return rows if set(roles) == set(ROLES) else rows.where(F.col("role").isin(roles))


def degraded(questions: DataFrame, unanchored: DataFrame, bare: DataFrame, data_subject: str | None, missing: list[str]) -> DataFrame:
    """`question_id, degraded`: the surfaces that a question's answer lacks, in order. `bare` names questions with a fact that no context
    surrounds; `missing` the surfaces that this instance has not (semantic_anchors, reports, passages)."""
    away = unanchored.select("question_id").distinct().withColumn("_free", F.lit(True))
    rows = questions.select("question_id").distinct().join(away, "question_id", "left")
    rows = rows.join(bare.select("question_id").distinct().withColumn("_bare", F.lit(True)), "question_id", "left")
    free = F.coalesce("_free", F.lit(False))
    told = [F.when(free, "semantic_anchors") if "semantic_anchors" in missing else F.lit(None).cast("string"), F.when(F.col("_bare"), "citation_context")]
    if data_subject is not None:
        told.append(F.when(free, "reports_withheld_for_subject"))
    elif "reports" in missing:
        told.append(F.when(free, "reports"))
    if "passages" in missing:
        told.append(F.lit("passages"))
    # A context is told of only where nothing was before it.
    told[1] = F.when(told[0].isNull(), told[1])
    return rows.select("question_id", F.filter(F.array(*told), lambda x: x.isNotNull()).alias("degraded"))
