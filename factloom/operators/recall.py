"""Answers to questions: anchors, a bounded walk, evidence, a budget, and what explains them. Many questions run as one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import question_terms
from factloom.schemas import BUDGET_CHARACTERS, BUDGET_ROWS, FANOUT, MAX_ANCHORS, MAX_TERMS


def term_table(spark: SparkSession, questions: dict[str, str]) -> DataFrame:
    """`question_id, term`: bounded, as a question has at most MAX_TERMS terms."""
    rows = [(q, t) for q, text in questions.items() for t in question_terms(text)[:MAX_TERMS]]
    return spark.createDataFrame(rows, "question_id string, term string")


def anchors(terms: DataFrame, entities: DataFrame, scopes: list[str], most: int = MAX_ANCHORS) -> DataFrame:
    """`question_id, anchor_id, term, canonical_name`: entities whose name is a term, longest terms first. No scope, no anchor.

    A question with more than `most` anchors is refused as a whole.
    """
    # Terms are many times the questions that they were made of, which an estimate of their size does not see: neither side is to be sent whole.
    named = entities.where(F.col("scope").isin(scopes)) if scopes else entities.limit(0)
    found = terms.join(named.hint("merge"), F.col("term") == F.col("normalized_name")).select("question_id", F.col("entity_id").alias("anchor_id"), "term", "canonical_name")
    order = Window.partitionBy("question_id").orderBy(F.desc(F.char_length("term")), "canonical_name", "anchor_id")
    size = F.count("*").over(Window.partitionBy("question_id"))
    return found.select("*", F.row_number().over(order).alias("place"), size.alias("_n")).where(F.col("_n") <= most).drop("_n")


def of_subject(found: DataFrame, lineage: DataFrame, data_subject: str, kind: str = "entity") -> DataFrame:
    """Anchors that one data subject's sources support."""
    own = lineage.where((F.col("projection_kind") == kind) & (F.col("data_subject_id") == data_subject)).select(F.col("projection_id").alias("anchor_id"))
    return found.join(own, "anchor_id", "left_semi")


def visible(facts: DataFrame, scope: str, roles: list[str], now: str, data_subject: str | None = None) -> DataFrame:
    """Facts that a reader may see: one scope, some roles, retained, perhaps of one data subject."""
    out = facts.where(F.col("scope") == scope).where(F.col("source_role").isin(roles)).where(F.col("retention_until").isNull() | (F.col("retention_until") > F.lit(now).cast("timestamp")))
    return out.where(F.col("data_subject_id") == data_subject) if data_subject else out


def directed_edges(facts: DataFrame, cap: int = FANOUT) -> DataFrame:
    """`entity_id, direction, fact_id, predicate, other_id, capped`: each end's first `cap` facts by id in each direction.

    Ranks count facts without another end too, and every path that reaches an entity sees the same rows, so ranking once is enough.
    """
    # Both ends of one scan, so that what makes the facts runs once.
    ends = F.array(F.struct(F.col("subject_id").alias("entity_id"), F.lit("out").alias("direction"), F.col("object_id").alias("other_id")), F.struct(F.col("object_id").alias("entity_id"), F.lit("in").alias("direction"), F.col("subject_id").alias("other_id")))
    rank = F.row_number().over(Window.partitionBy("entity_id", "direction").orderBy("fact_id"))
    near = facts.select("fact_id", "predicate", F.inline(ends)).where("entity_id is not null").withColumn("rn", rank).where(F.col("rn") <= cap + 1)
    over = F.max("rn").over(Window.partitionBy("entity_id", "direction")) > cap
    return near.withColumn("capped", over).where((F.col("rn") <= cap) & F.col("other_id").isNotNull()).drop("rn")


def walk(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """`question_id, fact_id, anchor_id, hops, path, via, capped`: facts within `hops` steps of an anchor on simple paths.

    A fact keeps its shortest path; of equals, the first by anchor and path. `via` holds the predicates along the path. Hops are 1 or 2
    and unrolled.
    """
    at = starts.select("question_id", "anchor_id", F.col("anchor_id").alias("node"), F.array("anchor_id").alias("path"), F.array().cast("array<string>").alias("via"), F.lit(False).alias("was"))
    levels = []
    for hop in range(1, min(max(hops, 1), 2) + 1):
        at = (
            at.join(edges, F.col("node") == F.col("entity_id"))
            .where(~F.array_contains("path", F.col("other_id")))
            .select("question_id", "anchor_id", F.col("other_id").alias("node"), F.array_append("path", F.col("other_id")).alias("path"), F.array_append("via", F.col("predicate")).alias("via"), (F.col("was") | F.col("capped")).alias("was"), "fact_id")
        )
        levels.append(at.select("question_id", "fact_id", "anchor_id", F.lit(hop).alias("hops"), "path", "via", F.col("was").alias("capped")))
        at = at.drop("fact_id")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    # The least of a struct is the first by hops, anchor and path; grouping combines before the shuffle, where a rank would sort all.
    best = F.min(F.struct("hops", "anchor_id", "path", "via", "capped"))
    return out.groupBy("question_id", "fact_id").agg(best.alias("x")).select("question_id", "fact_id", "x.*")


def attach_evidence(found: DataFrame, facts: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with their names and earliest evidence; a fact without evidence is left out, an end without a name stays."""
    first = F.min(F.struct(F.col("log_offset").isNull().alias("unknown"), "log_offset", "source_ordinal", "byte_start", "source_id", "quote"))
    earliest = evidence.groupBy("fact_id").agg(first.alias("e")).select("fact_id", "e.source_id", "e.source_ordinal", "e.quote")
    label = lambda c: names.select(F.col("entity_id").alias(c), F.col("canonical_name").alias(c.replace("_id", "_name")))
    rows = found.join(facts, "fact_id").join(earliest, "fact_id")
    return rows.join(label("subject_id"), "subject_id", "left").join(label("object_id"), "object_id", "left")


def named_paths(rows: DataFrame, names: DataFrame) -> DataFrame:
    """`rows` with `path_names`: the names of each path's entities in order, empty where an entity has none."""
    each = rows.select("question_id", "fact_id", F.posexplode("path").alias("at", "entity_id")).join(names, "entity_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("at", F.coalesce("canonical_name", F.lit("")).alias("name"))))
    return rows.join(each.groupBy("question_id", "fact_id").agg(F.transform(ordered, lambda x: x["name"]).alias("path_names")), ["question_id", "fact_id"])


def fact_size(context: Column) -> Column:
    """Characters that a recalled fact takes: its ends, predicate, statement, role, quote, context, and the words of its path."""
    listed = F.aggregate(F.concat("path_names", "via"), F.lit(0), lambda n, x: n + F.char_length(x))
    return characters(*[F.col(c) for c in ("subject_name", "predicate", "object_name", "statement", "source_role", "quote")], context) + listed


def characters(*texts: Column) -> Column:
    out = F.lit(0)
    for t in texts:
        out = out + F.coalesce(F.char_length(t), F.lit(0))
    return out


def cut(rows: DataFrame, by: list[str], order: list, size: Column, budget: int = BUDGET_CHARACTERS, most: int = BUDGET_ROWS) -> DataFrame:
    """Rows with their place and whether they are kept: the first `most` in order, up to the first that overflows the budget."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    ranked = rows.withColumn("size", size).withColumn("place", F.row_number().over(ordered)).withColumn("total", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    reason = F.when(F.col("place") > most, "rows").when(F.col("total") > budget, "characters")
    return ranked.withColumn("cut", reason)


def co_derived(rows: DataFrame) -> DataFrame:
    """Facts said in the same message of the same subject name each other."""
    key = ["question_id", "source_id", "source_ordinal", "subject_norm"]
    named = rows.where("subject_norm <> ''")
    left, right = named.select(*key, "fact_id"), named.select(*key, F.col("fact_id").alias("other"))
    return left.join(right, key).where("fact_id <> other").groupBy("question_id", "fact_id").agg(F.array_sort(F.collect_set("other")).alias("co_derived"))


def reach(terms: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """For each question its terms, anchors, facts by anchor and whether a fanout was capped."""
    t = terms.groupBy("question_id").agg(F.count("*").alias("terms"))
    a = found.groupBy("question_id").agg(F.count_distinct("anchor_id").alias("anchors"))
    per = kept.groupBy("question_id", "anchor_id").agg(F.count("*").alias("n"), F.bool_or("capped").alias("capped"))
    f = per.groupBy("question_id").agg(F.sum("n").alias("facts"), F.max("n").alias("most_from_one"), F.bool_or("capped").alias("capped"))
    return t.join(a, "question_id", "left").join(f, "question_id", "left").select("question_id", "terms", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("anchors", "facts", "most_from_one")], F.coalesce("capped", F.lit(False)).alias("capped"))


def compose(surfaces: list[DataFrame], budget: int = BUDGET_CHARACTERS) -> DataFrame:
    """Facts, reports and passages under one budget: each surface takes what the ones before it leave, and stops at its first overflow."""
    ranked = [s.select("question_id", F.lit(i).alias("surface"), "item_id", "place", "size") for i, s in enumerate(surfaces)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    spent = None
    out = None
    for i in range(len(surfaces)):
        own = rows.where(F.col("surface") == i)
        own = own.join(spent, "question_id", "left") if spent is not None else own.withColumn("spent", F.lit(0))
        run = F.sum("size").over(Window.partitionBy("question_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        own = own.withColumn("total", run + F.coalesce("spent", F.lit(0))).where(F.col("total") <= budget).select("question_id", "surface", "item_id", "place", "size")
        used = own.groupBy("question_id").agg(F.sum("size").alias("spent"))
        spent = used if spent is None else spent.unionByName(used).groupBy("question_id").agg(F.sum("spent").alias("spent"))
        out = own if out is None else out.unionByName(own)
    return out


def explain(rows: DataFrame) -> DataFrame:
    """For each question how many facts were offered, kept and cut, and why."""
    return rows.groupBy("question_id").agg(F.count("*").alias("offered"), F.count_if(F.col("cut").isNull()).alias("kept"), F.count_if(F.col("cut") == "rows").alias("cut_rows"), F.count_if(F.col("cut") == "characters").alias("cut_characters"))
