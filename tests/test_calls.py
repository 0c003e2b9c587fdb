"""Calls in flight, and calls that are paid for once."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fathomline.operators.generation import answered, generate
from fathomline.operators.ledger import Ledger, generate_once, prompt_digest


def logged(folder, fail=None, die=None):
    """A model that writes every prompt it answers to a file; it fails on some prompts and
    ends its process on others."""

    def model(prompts):
        import os
        import uuid

        if die is not None and any(die in p for p in prompts):
            os._exit(1)
        if fail is not None and any(fail in p for p in prompts):
            raise ValueError("refused")
        Path(folder, uuid.uuid4().hex).write_text("\n".join(prompts))
        return [p.upper() for p in prompts]

    return model


def seen(folder):
    return sorted(line for f in Path(folder).iterdir() for line in f.read_text().split("\n"))


def settled(folder):
    """What was asked once the other tasks of a stopped job have ended too."""
    found = None
    while found != (found := seen(folder)):
        time.sleep(2)
    return found


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, prompt string")


@pytest.mark.parametrize("in_flight", [1, 2, 5, 50])
def test_replies_keep_their_order(in_flight):
    drawn = []

    def batches():
        for i in range(20):
            drawn.append(i)
            yield [f"{i}a", f"{i}b"]

    def slow_first(prompts):
        time.sleep(0.05 if int(prompts[0][:-1]) % 3 == 0 else 0.0)
        return [p * 2 for p in prompts]

    found = answered(slow_first, batches(), in_flight=in_flight)
    assert next(found) == (["0a0a", "0b0b"], [None, None])
    assert len(drawn) <= in_flight
    assert [out for out, _ in found] == [[f"{i}a" * 2, f"{i}b" * 2] for i in range(1, 20)]
    with pytest.raises(ValueError):
        list(answered(slow_first, [], in_flight=0))


def test_waiting_calls_overlap():
    def sleeping(prompts):
        time.sleep(0.1)
        return prompts

    def seconds(in_flight):
        started = time.perf_counter()
        assert [o for o, _ in answered(sleeping, [[str(i)] for i in range(16)], in_flight=in_flight)] == [[str(i)] for i in range(16)]
        return time.perf_counter() - started

    one, eight = seconds(1), seconds(8)
    assert one >= 1.6 and eight < one / 3


def test_errors_and_coroutines_in_flight(spark):
    async def model(prompts):
        if any(p.startswith("bad") for p in prompts):
            raise ValueError("no")
        return [p + "!" for p in prompts]

    texts = [f"{'bad' if i % 9 == 4 else 'good'}{i}" for i in range(60)] + [None]
    rows = generate(table(spark, texts).coalesce(1), model, batch_size=4, in_flight=6).orderBy("id").collect()
    assert [r.output for r in rows] == [None if t is None or t[0] == "b" else t + "!" for t in texts]
    assert [r.error is not None for r in rows] == [t is not None and t[0] == "b" for t in texts]


def test_equal_and_known_prompts_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = generate_once(table(spark, ["a", "b", "a", None, ""]), ledger, model=logged(log), batch_size=2)
    assert {r.id: (r.output, r.error) for r in first.collect()} == {
        0: ("A", None), 1: ("B", None), 2: ("A", None), 3: (None, None), 4: ("", None),
    }
    again = generate_once(table(spark, ["c", "a", "b"]), ledger, model=logged(log), in_flight=3)
    assert {r.id: r.output for r in again.collect()} == {0: "C", 1: "A", 2: "B"}
    assert seen(log) == ["", "a", "b", "c"]
    # another model is asked again
    other = Ledger(spark, str(tmp_path / "ledger"), tag="other")
    assert other.ask(table(spark, ["a", "new"]), model=logged(log)) == 2


def test_failed_prompts_are_asked_again(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    ledger, prompts = Ledger(spark, f"file://{tmp_path}/ledger"), table(spark, ["one", "two bad", "three"])
    broken = generate_once(prompts, ledger, model=logged(log, fail="bad"), attempts=1).orderBy("id").collect()
    assert [r.output for r in broken] == ["ONE", None, "THREE"] and "refused" in broken[1].error
    mended = generate_once(prompts, ledger, model=logged(log)).orderBy("id").collect()
    assert [(r.output, r.error) for r in mended] == [("ONE", None), ("TWO BAD", None), ("THREE", None)]
    assert seen(log) == ["one", "three", "two bad"]


@pytest.mark.parametrize("in_flight", [1, 3])
def test_a_stopped_run_asks_nothing_twice(spark, tmp_path, in_flight):
    log = tmp_path / "log"
    log.mkdir()
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    texts = [f"prompt {i:03d}" for i in range(120)]
    prompts = table(spark, texts).repartition(3)
    with pytest.raises(Exception):
        ledger.ask(prompts, model=logged(log, die="prompt 077"), batch_size=1, in_flight=in_flight)
    before = settled(log)
    kept = ledger.replies().count()
    assert 0 < kept < 120
    asked = ledger.ask(prompts, model=logged(log), batch_size=5, in_flight=in_flight)
    assert asked == 120 - kept
    after = seen(log)
    # only calls that were in flight when the run stopped come again
    assert sorted(set(after)) == texts and len(after) - 120 <= len(before) - kept <= 3 * in_flight * 4
    if in_flight == 1:
        assert after == texts
    told = {r.digest: r.output for r in ledger.replies().collect()}
    keys = prompts.select(prompt_digest(F.col("prompt")).alias("d"), "prompt").collect()
    assert all(told[r.d] == r.prompt.upper() for r in keys)


def test_needs_one_model(spark, tmp_path):
    with pytest.raises(ValueError):
        Ledger(spark, str(tmp_path)).ask(table(spark, ["a"]))
