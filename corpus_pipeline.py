"""A corpus pipeline of the training-data operators: each stage works on what the one before it kept, written and read again.

What holds for all stages: a null text counts as an empty one, which is neither toxic, contaminated nor like another, has no tokens and
stays; texts of any length are read whole; rows are judged each by itself, so repeated rows share their fate (near-duplicates aside, which
are what `jaccard_join` removes); an empty table gives an empty one; columns beside `doc_id` and `text` are carried through whatever
their names. All but the last stage return the columns of their input.

A stage keeps what it writes for itself in a folder of its own, which goes when the next stage is called: the result of a stage is to be
written before that, as `run` does. Pipelines in different threads don't touch each other's.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import queries as q
from factloom.llm.decontamination import drop_contaminated
from factloom.llm.jaccard_join import keep_one
from factloom.llm.mixing import mixed_documents
from factloom.llm.shared import delete, kept_in, new_path
from factloom.llm.token_output import token_output
from factloom.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left: ContextVar[str | None] = ContextVar("left", default=None)


def staged(stage: Stage) -> Stage:
    """The stage with a folder of its own, after that of the stage before is deleted."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if before := _left.get():
            delete(spark, before)
        folder = new_path(spark, f"stage-{stage.__name__}")
        _left.set(folder)
        with kept_in(folder):
            return stage(spark, docs, sf_dir)

    return run


@staged
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A null text scores as an empty one does; of ties in score both go or stay."""
    return drop_toxic(docs, q.toxicity_model(spark, docs, sf_dir))


@staged
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id; of that id's rows alike, one. Rows without id,
    null and empty texts link with nothing and stay."""
    return keep_one(docs)


@staged
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none and stay."""
    return drop_contaminated(docs, q.table(spark, sf_dir, "benchmark"))


@staged
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains are brought to their target shares beside a whole clean domain: those above their share are thinned, nothing is repeated.
    A hash of id and text decides who stays, so rows alike stay or go together."""
    return mixed_documents(docs, q.domain_labels(q.table(spark, sf_dir, "labels")), q.MIXTURE, whole="clean")


@staged
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards are written, and what reading them back says of each document is the result. Null texts are empty ones, of which only
    the end id is written; rows of one id come in the order of their texts."""
    return token_output(docs, q.tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's table is deleted when the next one's is written."""
    docs, before = q.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    found = STAGES[-1][1](spark, docs, sf_dir)
    delete(spark, before)  # the shards are written
    return found
