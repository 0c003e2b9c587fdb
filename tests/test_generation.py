from __future__ import annotations

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from fathomline.functions import lexical, parsing
from fathomline.functions.prompts import CLARIFICATION, TEMPLATES, placeholders, render, render_prompt
from fathomline.operators import synthesis
from fathomline.operators.generation import (
    error_to_empty,
    generate,
    normalise_output,
    with_retries,
)
from fathomline.plans.synthesis import qa_dataset


def test_prompts_are_filled_once(spark):
    df = spark.createDataFrame([("{b} $1 \\", "x"), (None, "y")], "a string, b string")
    out = df.select(render("{{j}} {a}|{b}|{a}", {"a": F.col("a"), "b": F.col("b")}).alias("p")).collect()
    assert [r.p for r in out] == ["{j} {b} $1 \\|x|{b} $1 \\", "{j} |y|"]
    with pytest.raises(ValueError, match="missing"):
        render_prompt(df, "{nope}")
    with pytest.raises(ValueError, match="no value"):
        render("{nope}", {})


def test_catalogue_placeholders():
    expected = {
        "qa_generation": {"context"},
        "qa_generation_with_history": {"context", "history"},
        "short_qa": {"text"},
        "location_dependency": {"question", "answer", "context"},
        "rag_answer": {"context", "question"},
        "chat_answer": {"input", "context"},
        "context_answer": {"context", "question"},
        "groundedness": {"question", "context"},
        "question_relevance": {"question"},
        "faithfulness": {"context", "question", "answer"},
        "answer_relevancy": {"question", "answer"},
    }
    for name, names in expected.items():
        assert set(placeholders(TEMPLATES[name])) == names


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("again")
        return ["ok"]

    assert with_retries(flaky) == ["ok"]
    with pytest.raises(RuntimeError):
        calls.clear()
        with_retries(flaky, attempts=2)


def test_a_bad_prompt_costs_few_calls():
    from fathomline.operators.generation import _answer_batch

    calls = []

    def model(prompts):
        calls.append(len(prompts))
        if "bad" in prompts:
            raise ValueError("no")
        return prompts

    prompts = [str(i) for i in range(1000)] + ["bad"]
    outputs, errors = _answer_batch(model, prompts, 3)
    assert outputs == [*prompts[:-1], None] and errors[-1] == "ValueError: no" and not any(errors[:-1])
    assert len(calls) <= 3 * (1 + 2 * 10)


def test_other_placeholders_need_a_column(spark):
    chunks = spark.createDataFrame([(0, "t", "h")], "chunk_index long, text string, past string")
    with pytest.raises(ValueError, match="history"):
        synthesis.qa_prompts(chunks, "qa_generation_with_history")
    prompt = synthesis.qa_prompts(chunks, "qa_generation_with_history", history="past").first()["prompt"]
    assert "answers:\nh\n" in prompt and "Passage:\nt\n" in prompt


def test_drafts_keep_whole_sentences(spark):
    long, fits = "word " * 70 + "end.", "short words here."
    df = spark.createDataFrame([(f"{long} {fits}",), (long,)], "t string")
    drafts = [r[0] for r in df.select(lexical.drafted_pair(F.col("t"))).collect()]
    assert drafts[0].endswith(f"Answer: {fits}") and drafts[1].endswith(f"Answer: {long}")
    answers = [parsing.parse_qa(F.lit(d + "\n \n"))["answer"] for d in drafts]
    problem = [parsing.qa_problem(F.lit("q"), a) for a in answers]
    assert list(spark.range(1).select(*problem).first()) == [None, "answer too long"]


def test_normalised_output():
    class Reply:
        content = "text"

    assert [normalise_output(x) for x in (Reply(), None, 3, "s")] == ["text", "", "3", "s"]


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_one_bad_prompt_does_not_spoil_its_batch(spark, batch):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        prompts = ["a", "bad b", None, "c"] * 5
        df = spark.createDataFrame(
            [(i, p, ["d"]) for i, p in enumerate(prompts)], "i long, prompt string, retrieval_context array<string>"
        ).repartition(3)
        rows = error_to_empty(generate(df, model)).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.output for r in rows] == ["A", "", "", "C"] * 5
    assert [r.error for r in rows] == [None, "ValueError: no", None, None] * 5
    assert [r.retrieval_context for r in rows] == [["d"], [], ["d"], ["d"]] * 5


def test_client_is_made_per_task_and_retried(spark):
    folder = tempfile.mkdtemp()

    def make():
        open(os.path.join(folder, f"made-{os.urandom(8).hex()}"), "w").close()
        state = {"n": 0}

        def model(prompts):
            state["n"] += 1
            if state["n"] < 3:
                raise RuntimeError("busy")
            return [None for _ in prompts]

        return model

    df = spark.createDataFrame([(i, "p") for i in range(40)], "i long, prompt string").coalesce(1)
    rows = generate(df, make_model=make).collect()
    assert {(r.output, r.error) for r in rows} == {("", None)}
    assert len(os.listdir(folder)) == 1
    with pytest.raises(ValueError):
        generate(df)


def test_wrong_number_of_replies_is_an_error(spark):
    df = spark.createDataFrame([("p",)], "prompt string")
    assert "replies" in generate(df, lambda prompts: []).first()["error"]


JUDGED = [
    ('```json\n{"Evaluation": "ok {x}", "Score": "4"}\n```', "ok {x}", 4, None),
    ('{"Score": 5}', None, None, None),
    ('{"Evaluation":"e","Score":"9"}', "e", None, None),
    ('{"Evaluation":"e","Score":3}', "e", 3, None),
    ("{bad", None, None, "Invalid JSON from model"),
    ("{bad}", None, None, "Invalid JSON from model"),
    ("no json", None, None, "Invalid JSON from model"),
    ("", None, None, "Invalid JSON from model"),
]


def test_judge_json(spark):
    df = spark.createDataFrame([(i, j[0]) for i, j in enumerate(JUDGED)], "i long, o string")
    j = parsing.parse_judge_json(F.col("o"))
    out = df.select("i", j.alias("j")).select(
        "i",
        F.col("j.parsed.Evaluation").alias("e"),
        parsing.valid_score(F.col("j.parsed.Evaluation"), F.col("j.parsed.Score")).alias("s"),
        "j.error",
        "j.raw_output",
    ).orderBy("i").collect()
    assert [(r.e, r.s, r.error) for r in out] == [j[1:] for j in JUDGED]
    assert [r.raw_output for r in out] == [j[0] if j[3] else None for j in JUDGED]


def test_pairs_and_limits(spark):
    outputs = [
        "Factoid question: What is X?\nAnswer: It is\nY.",
        "What is X?",
        f"Factoid question: q\nAnswer: {'a' * 301}",
        f"Factoid question: q\nAnswer: {'a' * 300}",
        f"Factoid question: {'q' * 301}\nAnswer: a",
        "Factoid question: \nAnswer: ",
        None,
    ]
    df = spark.createDataFrame([(i, o) for i, o in enumerate(outputs)], "i long, output string")
    valid, rejected = synthesis.qa_constraints(synthesis.parse_pairs(df))
    assert [(r.i, r.question) for r in valid.orderBy("i").collect()] == [(0, "What is X?"), (3, "q")]
    assert valid.where("i = 0").first()["answer"] == "It is\nY."
    assert {r.i: r.reason for r in rejected.collect()} == {
        1: "no pair in the output", 2: "answer too long", 4: "question too long",
        5: "empty question or answer", 6: "no pair in the output",
    }


def test_critique_by_a_model(spark):
    def judge(prompts):
        out = []
        for p in prompts:
            if "Total rating" in p:
                out.append("Evaluation: fine\nTotal rating: 3")
            else:
                out.append(json.dumps({"Evaluation": "e", "Score": "6" if "not useful" in p else "2"}))
        return out

    df = spark.createDataFrame([(1, "q", "a", "c")], "i long, question string, answer string, context string")
    kinds = (*synthesis.CRITIQUES, "answer_relevancy")
    rated = synthesis.critique(df, kinds, judge)
    plan = rated._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 4 and "Exchange" not in plan and "Join" not in plan
    row = rated.first()
    assert (row.groundedness_score, row.faithfulness_score, row.answer_relevancy_score) == (2, 2, 3)
    assert row.answer_relevancy_eval == "fine"
    assert row.question_relevance_score is None and row.question_relevance_error


def test_location_dependency(spark):
    one = {"Evaluation": "e", "Score": "1", "Refined Question": "rq", "Refined Answer": "ra", "Target Answer": ""}
    rows = [("given", json.dumps(one)), ("given", json.dumps({**one, "Score": "0"})), ("given", "none")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, answer string, output string")
    out = synthesis.location_dependency(df).orderBy("i").collect()
    target = [r.location_dependency_evaluator_target_answer for r in out]
    assert target == [CLARIFICATION, "given", None]
    assert [(r.refined_question, r.refined_answer) for r in out] == [("rq", "ra"), ("", ""), (None, None)]
    assert out[2].location_error


def test_sampling_is_the_same_for_any_partitioning(spark):
    chunks = spark.range(500).select(F.col("id").alias("chunk_index"), F.lit("t").alias("text"))
    a = synthesis.sample_chunks(chunks.repartition(1), 7).collect()
    b = synthesis.sample_chunks(chunks.repartition(9), 7).collect()
    assert a == b and len(a) == 7
    assert synthesis.sample_chunks(chunks, 7, seed="1").collect() != a
    assert "TakeOrderedAndProject" in synthesis.sample_chunks(chunks, 7)._jdf.queryExecution().executedPlan().toString()


def test_dataset_with_scripted_models(spark):
    def writer(prompts):
        return ["Factoid question: What?\nAnswer: That." if "good" in p else "sorry" for p in prompts]

    def judge(prompts):
        return ['{"Evaluation": "e", "Score": "1"}'] * len(prompts)

    chunks = spark.createDataFrame([(0, "good text"), (1, "other")], "chunk_index long, text string")
    dataset, rejected = qa_dataset(chunks, writer, judge)
    row = dataset.first()
    assert dataset.count() == 1 and rejected.first()["index"] == 1
    assert list(row.asDict()) == [
        "index", "question", "answer", "context", "location_dependency_evaluator_target_answer",
        "groundedness_score", "groundedness_eval", "question_relevancy_score",
        "question_relevancy_eval", "faithfulness_score", "faithfulness_eval",
    ]
    assert row.location_dependency_evaluator_target_answer == CLARIFICATION


def test_extractive_answer(spark):
    df = spark.createDataFrame(
        [("the cat", "A dog. The cat sat. The cat ran."), ("x", "Only this."), ("q", "")], "q string, c string"
    )
    out = df.select(lexical.extractive_answer(F.col("q"), F.col("c")).alias("a")).collect()
    assert [r.a for r in out] == ["The cat sat.", "Only this.", ""]
