"""Running a text model over prompts, in batches inside the tasks."""

from __future__ import annotations

import asyncio
import inspect
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: attempts per batch.
ATTEMPTS = 3
BATCH_SIZE = 256

#: from prompts to replies; may be a coroutine function
Model = Callable[[list[str]], list]


def normalise_output(reply: object) -> str:
    """Text of a reply: its ``content`` if it has one, else its string form."""
    if reply is None:
        return ""
    return str(getattr(reply, "content", reply))


def with_retries(call: Callable[[], list], attempts: int = ATTEMPTS, pause: float = 0.0) -> list:
    """The first result of up to ``attempts`` calls, with a pause in seconds that doubles
    after every failure; the last failure is raised."""
    if attempts < 1:
        raise ValueError("attempts must be positive")
    for left in range(attempts - 1, -1, -1):
        try:
            return call()
        except Exception:
            if not left:
                raise
            time.sleep(pause)
            pause *= 2


def _answer_batch(
    model: Model, prompts: list[str], attempts: int, pause: float = 0.0
) -> tuple[list, list]:
    """Outputs and errors. A batch that keeps failing is halved, and so on down to
    single prompts: a bad prompt fails alone, after about ``2 log2 n`` more batches."""

    def ask() -> list:
        told = model(prompts)
        replies = list(asyncio.run(told) if inspect.isawaitable(told) else told)
        if len(replies) != len(prompts):
            raise ValueError(f"the model gave {len(replies)} replies to {len(prompts)} prompts")
        return [normalise_output(r) for r in replies]

    try:
        return with_retries(ask, attempts, pause), [None] * len(prompts)
    except Exception as error:
        if len(prompts) == 1:
            return [None], [f"{type(error).__name__}: {error}"]
    middle = len(prompts) // 2
    halves = [_answer_batch(model, part, attempts, pause) for part in (prompts[:middle], prompts[middle:])]
    return halves[0][0] + halves[1][0], halves[0][1] + halves[1][1]


def answered(
    model: Model,
    batches: Iterable[list[str]],
    attempts: int = ATTEMPTS,
    pause: float = 0.0,
    in_flight: int = 1,
) -> Iterator[tuple[list, list]]:
    """Outputs and errors of every batch, in the order of the batches.

    Up to ``in_flight`` batches wait for the model at a time, in threads of this task; no
    more are drawn from ``batches`` ahead of the results. ``model`` must then bear
    calls from several threads.
    """
    if in_flight < 1:
        raise ValueError("in_flight must be positive")
    if in_flight == 1:
        for batch in batches:
            yield _answer_batch(model, batch, attempts, pause)
        return
    with ThreadPoolExecutor(in_flight) as pool:
        waiting: deque = deque()
        for batch in batches:
            waiting.append(pool.submit(_answer_batch, model, batch, attempts, pause))
            if len(waiting) == in_flight:
                yield waiting.popleft().result()
        while waiting:
            yield waiting.popleft().result()


def model_column(
    prompt: Column,
    model: Model | None = None,
    make_model: Callable[[], Model] | None = None,
    attempts: int = ATTEMPTS,
    batch_size: int = BATCH_SIZE,
    pause: float = 0.0,
    in_flight: int = 1,
) -> Column:
    """``struct<output, error>`` of a model call on ``prompt``.

    Only the prompt crosses to Python, ``batch_size`` prompts per call; a null prompt is
    not sent and gives a null output. ``make_model``
    builds a client once per task; otherwise ``model`` must be picklable. A task keeps up
    to ``in_flight`` calls waiting at a time (see ``answered``). The
    call is marked non-deterministic, so Spark never duplicates it; write the
    result before several jobs read it.
    """
    if (model is None) == (make_model is None):
        raise ValueError("give either model or make_model")

    @F.pandas_udf("output string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_model() if make_model is not None else model
        for prompts in batches:
            replies = pd.DataFrame(None, prompts.index, ["output", "error"], dtype=object)
            asked = prompts.notna()
            if asked.any():
                waiting, outputs, errors = prompts[asked].tolist(), [], []
                parts = (waiting[at : at + batch_size] for at in range(0, len(waiting), batch_size))
                for told in answered(client, parts, attempts, pause, in_flight):
                    outputs += told[0]
                    errors += told[1]
                replies.loc[asked, "output"] = outputs
                replies.loc[asked, "error"] = errors
            yield replies.where(replies.notna(), None)

    return call.asNondeterministic()(prompt)


def generate(
    df: DataFrame,
    model: Model | None = None,
    prompt: str = "prompt",
    output: str = "output",
    error: str = "error",
    make_model: Callable[[], Model] | None = None,
    attempts: int = ATTEMPTS,
    batch_size: int = BATCH_SIZE,
    pause: float = 0.0,
    in_flight: int = 1,
) -> DataFrame:
    """Add the model output and an error column; an output is null on error."""
    reply = model_column(F.col(prompt), model, make_model, attempts, batch_size, pause, in_flight)
    called = df.withColumn("_reply", reply)
    return called.withColumns(
        {output: F.col("_reply.output"), error: F.col("_reply.error")}
    ).drop("_reply")


def error_to_empty(
    df: DataFrame, output: str = "output", retrieved: str = "retrieval_context", error: str = "error"
) -> DataFrame:
    """A failed row gets an empty answer and an empty retrieval list, and keeps
    its error."""
    failed = F.col(error).isNotNull()
    return df.withColumns(
        {
            output: F.when(failed, F.lit("")).otherwise(F.coalesce(F.col(output), F.lit(""))),
            retrieved: F.when(failed, F.array().cast("array<string>")).otherwise(F.col(retrieved)),
        }
    )
