"""History roll-up: which turns and segments to summarise next, and the context that they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.schemas import BRANCH, MAX_LEVEL, MIN_GAP_RUN, VERBATIM

SUBJECT = ["scope", "subject"]


def _covered(rows: DataFrame, at: str, segments: DataFrame) -> DataFrame:
    """`rows` with `covered`: whether a segment (`from_offset, to_offset`, none overlaps another) lies over the offset in column `at`.

    Rows and segments are read in one order, so the last segment that has begun is known without a range join."""
    marks = segments.select(*SUBJECT, F.col("from_offset").alias("_at"), F.lit(0).alias("_kind"), F.col("to_offset").alias("_end"), F.lit(None).cast(rows.select(F.struct(*rows.columns)).schema[0].dataType).alias("_row"))
    both = rows.select(*SUBJECT, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.struct(*rows.columns).alias("_row")).unionByName(marks)
    order = Window.partitionBy(*SUBJECT).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_end", F.max("_end").over(order)).where("_kind = 1")
    return both.select("_row.*", F.coalesce(F.col("_end") >= F.col("_at"), F.lit(False)).alias("covered"))


def _runs(rows: DataFrame, first: str, breaks: Column, branch: int) -> DataFrame:
    """`rows` that are not covered, with `island` and `part`, the run of at most `branch` of its island, and `closed`: whether the row after
    its island is a covered one. `breaks` says where an island ends without that."""
    order = Window.partitionBy(*SUBJECT).orderBy(first)
    rows = rows.withColumn("_next", F.lead("covered").over(order)).withColumn("island", F.sum((F.col("covered") | breaks).cast("int")).over(order))
    rows = rows.where("not covered")
    part = F.floor((F.row_number().over(Window.partitionBy(*SUBJECT, "island").orderBy(first)) - 1) / branch)
    return rows.withColumn("part", part).withColumn("closed", F.coalesce("_next", F.lit(False)))


def _old(turns: DataFrame, verbatim: int) -> DataFrame:
    """Turns that may be summarised: all but the newest."""
    newest = Window.partitionBy(*SUBJECT).orderBy(F.desc("log_offset"))
    return turns.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") > verbatim)


def compactable(turns: DataFrame, verbatim: int = VERBATIM) -> DataFrame:
    return _old(turns, verbatim).select(*SUBJECT, "log_offset")


def _first_level(rows: DataFrame, branch: int) -> DataFrame:
    """Runs of turns that are not `covered`, as `scope, subject, from_offset, to_offset, covered`: those of `branch` turns, and shorter ones of
    at least MIN_GAP_RUN where they end at a covered turn."""
    runs = _runs(rows, "log_offset", F.lit(False), branch).groupBy(*SUBJECT, "island", "part")
    found = runs.agg(F.min("log_offset").alias("from_offset"), F.max("log_offset").alias("to_offset"), F.count("*").alias("covered"), F.bool_or("closed").alias("closed"))
    found = found.where((F.col("covered") == branch) | (F.col("closed") & (F.col("covered") >= MIN_GAP_RUN)))
    return found.select(*SUBJECT, "from_offset", "to_offset", "covered")


def plan_turns(turns: DataFrame, branch: int = BRANCH, verbatim: int = VERBATIM) -> DataFrame:
    """First-level segments to write, `scope, subject, from_offset, to_offset, covered`: runs of `branch` uncovered turns (`summarised` flag).

    The newest `verbatim` turns are never summarised. A summarised turn ends a run, and what is left before it makes a segment if it is at
    least MIN_GAP_RUN long; what is left at the end waits for more turns.
    """
    return _first_level(_old(turns, verbatim).select(*SUBJECT, "log_offset", F.col("summarised").alias("covered")), branch)


def roll_up_turns(old: DataFrame, segments: DataFrame, branch: int = BRANCH) -> DataFrame:
    """First-level segments to write over turns that may be summarised: `scope, subject, level, from_offset, to_offset, covered`.

    Runs of `branch` turns under no first-level segment; a shorter one of at least MIN_GAP_RUN where it ends at a segment, as a gap does that
    an erasure left. What is left at the end waits."""
    found = _first_level(_covered(old, "log_offset", segments.where("level = 1")), branch)
    return found.select(*SUBJECT, F.lit(1).alias("level"), "from_offset", "to_offset", "covered")


def roll_up_segments(old: DataFrame, segments: DataFrame, level: int, branch: int = BRANCH) -> DataFrame:
    """Segments of `level` (2 and up) to write over those of the level below, by the same rule.

    Two segments are neighbours if no turn that may be summarised lies between them: turns that were erased part nothing. What ends at a
    segment of this level closes, be it an old one or one that is written now."""
    below = _covered(segments.where(F.col("level") == level - 1), "from_offset", segments.where(F.col("level") == level))
    # How many turns lie before each segment and up to its end: neighbours have the same number between them.
    ends = below.select(*SUBJECT, F.explode(F.array(F.struct(F.col("from_offset").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("to_offset").alias("at"), F.lit(2).alias("kind")))).alias("x"), "from_offset")
    marks = ends.select(*SUBJECT, "x.at", "x.kind", "from_offset").unionByName(old.select(*SUBJECT, F.col("log_offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("from_offset")))
    upto = Window.partitionBy(*SUBJECT).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("n", F.sum((F.col("kind") == 1).cast("int")).over(upto)).where("kind <> 1")
    counts = marks.groupBy(*SUBJECT, "from_offset").agg(F.min("n").alias("before"), F.max("n").alias("upto"))
    rows = below.join(counts, [*SUBJECT, "from_offset"])
    order = Window.partitionBy(*SUBJECT).orderBy("from_offset")
    gap = F.coalesce(F.lag("upto").over(order) != F.col("before"), F.lit(False))
    rows = rows.withColumn("_gap", gap)
    rows = _runs(rows, "from_offset", F.col("_gap"), branch)
    # A short run before a gap closes too, once what follows the gap is covered by a segment written now: its island's first run is if it has
    # `branch` segments, or two and closes itself. So it goes from the right, up to an island that is decided by itself.
    islands = rows.groupBy(*SUBJECT, "island").agg(F.min("from_offset").alias("start"), F.count("*").alias("size"), F.max_by("closed", "from_offset").alias("ends"))
    own = F.when(F.col("size") >= branch, True).when(F.col("size") < MIN_GAP_RUN, False).when(F.col("ends"), True)
    following = Window.partitionBy(*SUBJECT).orderBy("start")
    islands = islands.withColumn("own", own)
    written = F.coalesce(F.first("own", ignorenulls=True).over(following.rowsBetween(0, Window.unboundedFollowing)), F.lit(False))
    islands = islands.withColumn("written", written)
    shut = F.col("ends") | F.coalesce(F.lead("written").over(following), F.lit(False))
    islands = islands.select(*SUBJECT, "island", shut.alias("shut"))
    found = rows.groupBy(*SUBJECT, "island", "part").agg(
        F.min("from_offset").alias("from_offset"), F.max("to_offset").alias("to_offset"), F.count("*").alias("parts"), F.sum("covered_turns").alias("covered")
    )
    found = found.join(islands, [*SUBJECT, "island"]).where((F.col("parts") == branch) | (F.col("shut") & (F.col("parts") >= MIN_GAP_RUN)))
    return found.select(*SUBJECT, F.lit(level).alias("level"), "from_offset", "to_offset", "covered")


def roll_up(turns: DataFrame, segments: DataFrame, write, branch: int = BRANCH, verbatim: int = VERBATIM, most: int = MAX_LEVEL) -> DataFrame:
    """All segments that a history gets until nothing is left to write, level by level: the new ones, as `scope, subject, level, from_offset,
    to_offset, covered`. `write` stores a DataFrame and reads it back. Segments of one level must not overlap; an empty history gets none.

    A level is written whole before the next is planned over it, old and new segments alike, which is the order of one plan at a time."""
    columns = [*SUBJECT, "level", "from_offset", "to_offset", "covered"]
    old = write(compactable(turns, verbatim))
    held = segments.select(*SUBJECT, F.col("level").cast("int").alias("level"), "from_offset", "to_offset", F.col("covered").cast("long").alias("covered"))
    made = None
    for level in range(1, most + 1):
        if level == 1:
            fresh = roll_up_turns(old, held, branch)
        else:
            fresh = roll_up_segments(old, held.withColumnRenamed("covered", "covered_turns"), level, branch)
        fresh = write(fresh.select(*columns))
        held = held.unionByName(fresh)
        made = fresh if made is None else made.unionByName(fresh)
        if not held.where(F.col("level") == level).take(1):
            break
    return made


def after_loss(segments: DataFrame, lost: DataFrame) -> DataFrame:
    """Segments that stay when some turns (`scope, subject, log_offset`) are erased: a summary of an erased turn goes, at every level."""
    marks = lost.select(*SUBJECT, F.col("log_offset").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast("int").alias("level"))
    ends = segments.select(*SUBJECT, F.explode(F.array(F.struct(F.col("from_offset").alias("_at"), F.lit(0).alias("_kind")), F.struct(F.col("to_offset").alias("_at"), F.lit(2).alias("_kind")))).alias("x"), "from_offset", "level")
    rows = ends.select(*SUBJECT, "x._at", "x._kind", F.col("from_offset").alias("_end"), "level").unionByName(marks)
    upto = Window.partitionBy(*SUBJECT).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("_n", F.sum((F.col("_kind") == 1).cast("int")).over(upto)).where("_kind <> 1")
    whole = counted.groupBy(*SUBJECT, "level", F.col("_end").alias("from_offset")).agg((F.max("_n") - F.min("_n")).alias("_n")).where("_n = 0")
    return segments.join(whole.drop("_n"), [*SUBJECT, "level", "from_offset"], "left_semi").select(*segments.columns)


def assemble(turns: DataFrame, segments: DataFrame, budget: int, verbatim: int = VERBATIM) -> DataFrame:
    """Context of each subject: the newest turns as they are, older ones by the highest segment over them, cut from the oldest end.

    `scope, subject, kind, from_offset, to_offset, size`: items in place of turns, while their sizes in characters, newest first, fit.
    """
    newest = Window.partitionBy("scope", "subject").orderBy(F.desc("log_offset"))
    aged = turns.withColumn("age", F.row_number().over(newest))
    old = aged.where((F.col("age") > verbatim) & F.col("summarised"))
    # Segments are laid out turn by turn, so that the range join is an equi-join.
    laid = segments.select("scope", "subject", "level", "from_offset", "to_offset", F.col("size").alias("segment_size"), F.explode(F.sequence("from_offset", "to_offset")).alias("log_offset"))
    best = old.join(laid, ["scope", "subject", "log_offset"]).groupBy("scope", "subject", "log_offset").agg(F.max(F.struct("level", "from_offset", "to_offset", "segment_size")).alias("s"))
    summaries = best.select("scope", "subject", F.lit("segment").alias("kind"), "s.from_offset", "s.to_offset", F.col("s.segment_size").alias("size")).distinct()
    covered = best.select("scope", "subject", "log_offset")
    loose = aged.join(covered, ["scope", "subject", "log_offset"], "left_anti").select("scope", "subject", F.lit("turn").alias("kind"), F.col("log_offset").alias("from_offset"), F.col("log_offset").alias("to_offset"), "size")
    run = F.sum("size").over(Window.partitionBy("scope", "subject").orderBy(F.desc("to_offset")).rowsBetween(Window.unboundedPreceding, 0))
    return summaries.unionByName(loose).withColumn("total", run).where(F.col("total") <= budget).drop("total")


def segment_lineage(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """A lineage row for every turn that a segment covers, and whether they are as many as the segment claims."""
    laid = segments.select("scope", "subject", "segment_id", "covered", F.explode(F.sequence("from_offset", "to_offset")).alias("log_offset"))
    found = laid.join(turns.select("scope", "subject", "log_offset", "source_id"), ["scope", "subject", "log_offset"], "left")
    return found.groupBy("scope", "subject", "segment_id", "covered").agg(F.count("source_id").alias("linked")).withColumn("complete", F.col("linked") == F.col("covered"))


def long_histories(turns: DataFrame, verbatim: int = VERBATIM) -> DataFrame:
    """Subjects with more formed turns than are kept verbatim."""
    return turns.groupBy("scope", "subject").agg(F.count("*").alias("turns")).where(F.col("turns") > verbatim)
