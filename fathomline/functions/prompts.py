"""Prompt templates and their rendering as one concatenation per row."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the target answer of a question that depends on more context.
CLARIFICATION = (
    "This question is hard to answer accurately as it seems to depend on some more context. "
    "Could you please provide me with more context, e.g what you are currently doing in the "
    "software?"
)

_PAIR_FORMAT = """Reply in exactly this form:
Factoid question: <question, at most 300 characters>
Answer: <answer, at most 300 characters>"""

_RATING_FORMAT = """Reply with one JSON object and nothing else:
{{"Evaluation": "<your reasons>", "Score": "<whole number from 1 to 5>"}}"""

_VERDICT_FORMAT = """Reply with one JSON object and nothing else:
{{"verdict": "<yes or no>", "reason": "<your reasons>"}}"""

TEMPLATES = {
    "qa_generation": f"""Write one question that this passage answers, and its answer.
Stay within the passage, keep its language, and do not mention the passage itself.
{_PAIR_FORMAT}

Passage:
{{context}}
""",
    "qa_generation_with_history": f"""Write one question that this passage answers, and its answer.
Stay within the passage, keep its language, and do not repeat an earlier question.
{_PAIR_FORMAT}

Earlier questions and answers:
{{history}}

Passage:
{{context}}
""",
    "short_qa": f"""Make one fact question with a short answer from the text, in its language.
{_PAIR_FORMAT}

Text:
{{text}}
""",
    "location_dependency": """Decide whether the question can be answered from the context as it stands.
Score 0: it is clear and complete. Score 1: it is vague or needs a place in a document to be
understood. For score 1 also give a better question with its answer.
Reply with one JSON object and nothing else:
{{"Evaluation": "<your reasons>", "Score": "<0 or 1>", "Refined Question": "<or empty>",
"Refined Answer": "<or empty>", "Target Answer": "<or empty>"}}

Question: {question}
Answer: {answer}
Context: {context}
""",
    "rag_answer": """You get a question and numbered passages.
Question: {question}

Passages:
{context}

Write a short answer that these passages support, with the numbers of those you used. Write
nothing if they do not answer it.
""",
    "chat_answer": """Answer from these passages and from nothing else.

Passages:
{context}

Asked: {input}
""",
    "context_answer": """Question: {question}

These passages were found for it:
{context}

Your answer:""",
    "groundedness": f"""Rate from 1 to 5 how well the context answers the question.
1 means not at all, 5 means fully and clearly.
{_RATING_FORMAT}

Question: {{question}}
Context: {{context}}
""",
    "question_relevance": f"""Rate from 1 to 5 how useful the question is to the people who would ask it.
1 means not useful, 5 means very useful.
{_RATING_FORMAT}

Question: {{question}}
""",
    "faithfulness": f"""Rate from 1 to 5 how faithful the answer is to the context.
1 means it contradicts or invents, 5 means every statement is in the context.
{_RATING_FORMAT}

Context: {{context}}
Question: {{question}}
Answer: {{answer}}
""",
    "answer_relevancy": """Rate from 1 to 5 how directly the answer addresses the question.
Reply in exactly this form:
Evaluation: <your reasons>
Total rating: <whole number from 1 to 5>

Question: {question}
Answer: {answer}
""",
    "judge_support": f"""Does the evidence support the statement?
{_VERDICT_FORMAT}

Statement: {{statement}}
Evidence: {{evidence}}
""",
    "judge_relevance": f"""Does the statement help to answer the question?
It need not be true, but it must be about what was asked.
{_VERDICT_FORMAT}

Question: {{question}}
Statement: {{statement}}
""",
    "judge_usefulness": f"""Does the passage help to arrive at the expected answer to the question?
{_VERDICT_FORMAT}

Question: {{question}}
Expected answer: {{statement}}
Passage: {{evidence}}
""",
}


def placeholders(template: str) -> list[str]:
    """Distinct placeholder names, in order of appearance."""
    names = [name for _, name, _, _ in Formatter().parse(template) if name is not None]
    return list(dict.fromkeys(names))


def render(template: str, values: dict[str, Column]) -> Column:
    """Fill ``{name}`` once; ``{{`` and ``}}`` are literal braces.

    The template is cut up when the plan is built. A value that itself contains
    ``{name}`` stays as it is, and a null value becomes an empty text.
    """
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in values:
                raise ValueError(f"no value for placeholder {{{name}}}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def render_prompt(
    df: DataFrame, template: str, columns: dict[str, str] | None = None, name: str = "prompt"
) -> DataFrame:
    """Add a rendered prompt. ``columns`` maps placeholders to columns of other names."""
    renamed = columns or {}
    wanted = {p: renamed.get(p, p) for p in placeholders(template)}
    missing = [column for column in wanted.values() if column not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing")
    return df.withColumn(name, render(template, {p: F.col(c) for p, c in wanted.items()}))
