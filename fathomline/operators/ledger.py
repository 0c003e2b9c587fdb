"""A ledger of model calls: every prompt is paid for once, also over restarts.

Replies are kept by the digest of their prompt. A task writes each batch to the ledger
as soon as its replies are there, so a run that is stopped loses the calls in flight
and nothing else; the next run asks only what the ledger does not know.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.generation import ATTEMPTS, BATCH_SIZE, Model, answered, model_column
from fathomline.storage import broadcast_if_small, file_store

_ENTRY = pa.schema([("digest", pa.string()), ("output", pa.string()), ("error", pa.string())])
_KINDS = "digest string, output string, error string"
_ENTRY_BYTES = 96


def prompt_digest(prompt: Column, tag: str = "") -> Column:
    """What a prompt is kept under; ``tag`` names the model and its settings."""
    return F.sha2(F.concat(F.lit(f"{len(tag)}:{tag}"), prompt), 256)


class Ledger:
    """Replies below ``path``, a folder that all executors and later runs share.

    Tasks write there themselves, so the path must be one that ``pyarrow.fs`` can open:
    a mounted folder, or a store that it has a client for. Prompts of another ``tag`` are
    other prompts.
    """

    def __init__(self, spark: SparkSession, path: str, tag: str = "") -> None:
        self.spark, self.path, self.tag = spark, path.rstrip("/"), tag

    def replies(self) -> DataFrame:
        """``(digest, output, error)``: of each prompt a reply if there is one, else an error."""
        store, root = file_store(self.path)
        store.create_dir(root, recursive=True)
        entries = self.spark.read.schema(_KINDS).option("recursiveFileLookup", True).parquet(self.path)
        best = F.max(F.struct(F.col("error").isNull().alias("told"), "output", "error")).alias("b")
        return entries.groupBy("digest").agg(best).select("digest", "b.output", "b.error")

    def ask(
        self,
        prompts: DataFrame,
        prompt: str = "prompt",
        model: Model | None = None,
        make_model: Callable[[], Model] | None = None,
        attempts: int = ATTEMPTS,
        batch_size: int = BATCH_SIZE,
        pause: float = 0.0,
        in_flight: int = 1,
    ) -> int:
        """Ask the model every different prompt that has no reply yet; the number asked.

        Prompts whose last call failed are asked again. Null prompts are not sent.
        """
        if (model is None) == (make_model is None):
            raise ValueError("give either model or make_model")
        known = self.replies().where("error is null").select("digest")
        wanted = prompts.select(prompt_digest(F.col(prompt), self.tag).alias("digest"), F.col(prompt).alias("prompt"))
        new = wanted.where("prompt is not null").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
        run, path = uuid.uuid4().hex, self.path

        def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = make_model() if make_model is not None else model
            folder = _Folder(path, run, TaskContext.get().partitionId())
            done = folder.digests()
            sent: list[list[str]] = []

            def waiting() -> Iterator[list[str]]:
                rows: list[tuple[str, str]] = []
                for batch in batches:
                    rows += [r for r in zip(*(batch.column(c).to_pylist() for c in ("digest", "prompt"))) if r[0] not in done]
                    while len(rows) >= batch_size:
                        yield taken(rows)
                while rows:
                    yield taken(rows)

            def taken(rows: list[tuple[str, str]]) -> list[str]:
                part = rows[:batch_size]
                del rows[:batch_size]
                sent.append([digest for digest, _ in part])
                return [text for _, text in part]

            for outputs, errors in answered(client, waiting(), attempts, pause, in_flight):
                digests = sent.pop(0)
                folder.write(digests, outputs, errors)
                yield pa.RecordBatch.from_arrays([pa.array([len(digests)], pa.int64())], ["n"])

        asked = new.select("digest", "prompt").mapInArrow(call, "n long")
        return asked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


class _Folder:
    """What one task of one run writes; a task that is run again goes on from it."""

    def __init__(self, path: str, run: str, task: int) -> None:
        self.store, root = file_store(path)
        self.path = f"{root}/run-{run}/task-{task:06d}"
        self.store.create_dir(self.path, recursive=True)

    def digests(self) -> set[str]:
        files = self.store.get_file_info(fs.FileSelector(self.path))
        whole = [f.path for f in files if f.base_name.startswith("calls-")]
        return {d for f in whole for d in pq.read_table(f, filesystem=self.store, columns=["digest"]).column(0).to_pylist()}

    def write(self, digests: list[str], outputs: list, errors: list) -> None:
        name = uuid.uuid4().hex
        # readers skip names with a dot in front, so half a file is never read
        hidden, whole = f"{self.path}/.{name}", f"{self.path}/calls-{name}.parquet"
        pq.write_table(pa.table([digests, outputs, errors], schema=_ENTRY), hidden, filesystem=self.store)
        self.store.move(hidden, whole)


def generate_once(
    df: DataFrame,
    ledger: Ledger,
    prompt: str = "prompt",
    output: str = "output",
    error: str = "error",
    **calls,
) -> DataFrame:
    """``generate`` through a ledger: equal prompts are one call, and known ones none.

    ``calls`` are the options of ``Ledger.ask``. A null prompt gives a null output.
    """
    ledger.ask(df, prompt, **calls)
    key = "_digest"
    told = ledger.replies().withColumnRenamed("digest", key)
    keyed = df.drop(output, error).withColumn(key, prompt_digest(F.col(prompt), ledger.tag))
    told = told.select(key, F.col("output").alias(output), F.col("error").alias(error))
    size = F.lit(_ENTRY_BYTES) + F.coalesce(F.octet_length(output), F.octet_length(error), F.lit(0))
    # without a bound on the replies, a shuffle in which adaptive execution splits hot prompts
    return keyed.join(broadcast_if_small(told, size), key, "left").drop(key)


def replied(
    df: DataFrame,
    name: str,
    prompt: Column,
    model: Model | None = None,
    make_model: Callable[[], Model] | None = None,
    calls: dict | None = None,
) -> DataFrame:
    """Add ``name``, the ``struct<output, error>`` of a model call on ``prompt``.

    ``calls`` has options of ``model_column``, and may name a ``ledger``. Through a ledger
    ``df`` is read once to ask and once to join, so it should be a written or cheap frame.
    """
    options = dict(calls or {})
    ledger = options.pop("ledger", None)
    if ledger is None:
        return df.withColumn(name, model_column(prompt, model, make_model, **options))
    asked = df.withColumn("_prompt", prompt)
    told = generate_once(asked, ledger, "_prompt", "_told", "_problem", model=model, make_model=make_model, **options)
    reply = F.struct(F.col("_told").alias("output"), F.col("_problem").alias("error"))
    return told.withColumn(name, reply).drop("_prompt", "_told", "_problem")
