"""A training corpus in five stages over ``documents``.

Toxic documents go, one document of each group of near-copies stays, documents with
benchmark passages go, personal data is generalised, and the rest is mixed to target
weights. Each stage takes ``(spark, docs, sf_dir)``; its result is written and read again as
the next one's ``docs``. All but the last return the columns of ``documents``; the last adds
the domain, the fitted rate and the number of copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import fathomline
from fathomline.llm import decontaminate, minhash, mixing, sanitise, toxicity
from fathomline.storage import materialise

# ship the package with the tasks, wherever Spark was started
cloudpickle.register_pickle_by_value(fathomline)

#: domains of the ``labels`` table and their shares of the tokens in the result
TARGETS = {"prose": 0.9, "junk": 0.1}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise.sanitise(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(_table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, labelled, TARGETS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal_data", remove_personal_data),
    ("mixing", mix_domains),
]

#: the models of the first and last stage are trained, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
