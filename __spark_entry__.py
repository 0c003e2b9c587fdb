
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import fathomline
import oracle_queries
from fathomline.functions import hashing, lexical, parsing
from fathomline.functions import text as txt
from fathomline.functions.prompts import TEMPLATES, render, render_prompt
from fathomline.operators import chunking, indexing, metrics, reporting, retrieval, synthesis
from fathomline.operators.cleaning import clean_pages, project_page_text, validate_records
from fathomline.operators.embedding import embed_texts
from fathomline.operators.generation import error_to_empty, generate
from fathomline.operators.ledger import Ledger, generate_once
from fathomline.operators.neighbours import knn_exact
from fathomline.operators.testcases import (
    attach_predictions,
    build_goldens,
    qa_from_turns,
    qa_history,
    zip_align,
)
from fathomline.operators.vector_index import knn_approx, open_vector_index, vector_index
from fathomline.plans.corpus import chunk_table, counted_chunk_table
from fathomline.plans.evaluation import EvaluationSet, Scorer
from fathomline.plans.rag import DenseRag, TfIdfRag
from fathomline.plans.synthesis import qa_dataset
from fathomline.sources.config import DEFAULT_CONFIG, select_metrics
from fathomline.sources.delimited import read_delimited, write_delimited
from fathomline.sources.documents import load_pages
from fathomline.sources.records import (
    head_n,
    project_qa_columns,
    read_qa_dataset,
    rename_columns,
    write_json,
)
from fathomline.sources.vectors import load_vectors
from fathomline.storage import materialise, scratch_path, spread
from fathomline.streaming.numbering import number_stream, numbered_chunks
from fathomline.streaming.row_local import read_file_stream

# The training-data operators are a part that can be left out as a whole.
try:
    import corpus_pipeline
    from fathomline.llm import queries as llm_queries
except ModuleNotFoundError as error:
    if error.name not in ("corpus_pipeline", "fathomline.llm", "fathomline.llm.queries"):
        raise
    corpus_pipeline = llm_queries = None

# Ship the package and this file with the tasks, wherever Spark was started.
for part in (fathomline, corpus_pipeline):
    if part is not None:
        cloudpickle.register_pickle_by_value(part)
if __name__ in sys.modules:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUSTOM_WEIGHTS = {
    "Answer Relevancy": 1.0,
    "Faithfulness": 2.5,
    "Contextual Recall": 0.0,
    "Contextual Precision": 0.75,
}


# -- tables ---------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_pages(load_pages(spread(documents(spark, sf_dir), "doc_id")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_table(documents(spark, sf_dir))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, each for its own text."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("index"),
        F.coalesce(txt.clean(F.col("text")), F.lit("")).alias("question"),
        F.col("text").alias("answer"),
        F.col("text").alias("context"),
    )


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_from_turns(table(spark, sf_dir, "conversations"))


# -- sources and cleaning -------------------------------------------------


def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "qa-json")
    write_json(qa(spark, sf_dir), path)
    records, _ = read_qa_dataset(spark, path, array_files=False)
    return project_qa_columns(records)


def read_qa_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_n(project_qa_columns(qa(spark, sf_dir)), 20)


def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with edge spaces, quotes, tabs, empty and null ones come back unchanged."""
    path, text, kind = scratch_path(spark, "pages-tsv"), F.col("text"), F.col("doc_id") % 7
    edges = (
        F.when(kind == 1, F.concat(F.lit(" "), text, F.lit(" ")))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.lit(None).cast("string"))
        .when(kind == 4, F.concat(F.lit('"'), text))
        .when(kind == 5, F.concat(text, F.lit('\t""')))
        .otherwise(text)
    )
    write_delimited(pages(spark, sf_dir).select("doc_id", edges.alias("text"), "source"), path)
    return read_delimited(
        spark, path, "doc_id long, text string, source string", schema_map={"source": "origin"}
    )


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return rename_columns(labels, {"quality": "is_good", "toxic": "is_toxic", "absent": "ignored"})


def loaded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load_vectors(spark, f"{sf_dir}/embeddings.parquet", hashing.DIMENSION)
    return vectors.select("vec_id", F.posexplode("embedding").alias("axis", "value")).select(
        "vec_id", "axis", F.round(F.col("value").cast("double"), 6).alias("value")
    )


def loaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\f")))
    return load_pages(broken)


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_page_text(load_pages(documents(spark, sf_dir)))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("."), F.lit("...")))
    return clean_pages(dotted).select("doc_id", "text")


def validated_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text is blank count as missing."""
    turns = table(spark, sf_dir, "conversations").withColumn(
        "text", F.when(F.col("role") != "system", F.col("text"))
    )
    valid, rejected = validate_records(turns, ["role", "text"])
    kept = valid.withColumn("reason", F.lit("valid")).unionByName(rejected)
    return kept.select("conv_id", "turn", "reason")


# -- chunking -------------------------------------------------------------


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_sentences(pages(spark, sf_dir))


def chunk_columns(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_no", "chunk_pos", "text", "chunk_token_count", "source")


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(chunking.chunk_documents(pages(spark, sf_dir), "sentence_chunker"))


def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(chunking.sentence_chunks(pages(spark, sf_dir), 100, 20))


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(chunking.chunk_documents(pages(spark, sf_dir), "recursive_chunker", 100))


def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_columns(
        chunking.chunk_documents(pages(spark, sf_dir), "semantic_chunker", 100, min_sentences=2)
    )


def chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select(
        "chunk_index", "doc_id", "page_no", "chunk_pos", "chunk_token_count"
    )


def stream_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in three portions; the query is started again for each."""
    path, arriving = scratch_path(spark, "numbered"), documents(spark, sf_dir)
    for portion in range(3):
        arriving.where(F.col("doc_id") % 3 == portion).write.mode("append").parquet(f"{path}/arrived")
        stream = read_file_stream(spark, f"{path}/arrived", arriving.schema)
        query = number_stream(stream, path, f"{path}/checkpoint")
        query.awaitTermination()
    return numbered_chunks(spark, path).select(
        "chunk_index", "doc_id", "page_no", "chunk_pos", "chunk_token_count"
    )


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted_chunk_table(documents(spark, sf_dir))[1]


# -- keyword index and retrieval ------------------------------------------


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.term_frequencies(chunks(spark, sf_dir))


def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = chunks(spark, sf_dir)
    found = indexing.inverse_document_frequency(
        indexing.term_frequencies(numbered), indexing.corpus_size(numbered)
    )
    return found.select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = indexing.tfidf_index(chunks(spark, sf_dir)).weights
    return weights.select("chunk_index", "term", F.round("weight", 6).alias("weight"))


def tfidf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexing.tfidf_index(chunks(spark, sf_dir))
    questions = qa(spark, sf_dir)
    small = retrieval.questions_fit(questions)
    asked = indexing.question_terms(questions, index.idf, small)
    return retrieval.tfidf_scores(asked, index, small)


def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = indexing.tfidf_index(chunks(spark, sf_dir))
    asked = indexing.question_terms(qa(spark, sf_dir), index.idf, small=False)
    return retrieval.top_k(retrieval.best_chunks_in_passes(asked, index, 5), 5)


def tfidf_topk_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question shrinks to its longest term, which few chunks contain."""
    numbered = chunks(spark, sf_dir)
    rare = qa(spark, sf_dir).withColumn("question", lexical.longest_term(F.col("context")))
    index = indexing.tfidf_index(numbered)
    return retrieval.tfidf_retrieve(rare, numbered, index, 5).drop("text")


def entry(spark: SparkSession) -> DataFrame:
    """Clean, chunk and index the documents; the top five chunks per question."""
    return tfidf_retrieval(spark, "/root/testdata/sf0.001")


def tfidf_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TfIdfRag(chunks(spark, sf_dir), k=5).retrieve(qa(spark, sf_dir))


def many_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn is a question; they meet the index block by block."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    asked = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("index"), F.col("text").alias("question"))
    numbered = chunks(spark, sf_dir)
    index = indexing.tfidf_index(numbered)
    return retrieval.tfidf_retrieve(asked, numbered, index, 5, small=False).drop("text")


def index_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from an index and a chunk table that were written and opened again."""
    path = scratch_path(spark, "kept")
    chunks(spark, sf_dir).write.parquet(f"{path}/chunks")
    numbered = spark.read.parquet(f"{path}/chunks")
    indexing.tfidf_index(numbered, path=f"{path}/index").close()
    index = indexing.open_index(spark, f"{path}/index")
    return TfIdfRag(numbered, k=5, index=index).retrieve(qa(spark, sf_dir))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.gather_context(qa(spark, sf_dir), tfidf_retrieval(spark, sf_dir))


def build_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("index", "built_context")


def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select(
        "index", F.posexplode("retrieval_context").alias("position", "text")
    )


# -- vectors --------------------------------------------------------------


def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed_texts(spread(documents(spark, sf_dir), "doc_id").select("doc_id", "text"))
    return (
        vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "value"))
        .where(F.col("value") > 0)
        .select("doc_id", "bucket", F.round(F.col("value").cast("double"), 4).alias("value"))
    )


def _vector_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.withColumnRenamed("vec_id", "index"), vectors


def knn_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_exact(*_vector_pairs(spark, sf_dir), k=10)


def knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shuffled form for question sets that must not be broadcast."""
    return knn_exact(*_vector_pairs(spark, sf_dir), k=10, small=False, block_rows=200)


def knn_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long vectors, near each other: the block sizes must not show in the result."""
    moved = F.transform("embedding", lambda x: x.cast("double") * 1000 + F.col("vec_id") % 3)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("embedding"))
    asked = vectors.withColumnRenamed("vec_id", "index")
    forms = {
        "small": knn_exact(asked, vectors, 10),
        "blocks of 100": knn_exact(asked, vectors, 10, small=False, block_rows=100),
        "blocks of 333": knn_exact(asked, vectors, 10, small=False, block_rows=333),
    }
    named = [found.select(F.lit(name).alias("form"), "*") for name, found in forms.items()]
    return reduce(DataFrame.union, named)


def knn_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through cells that are skipped by their radius; no neighbour is missed."""
    return knn_approx(*_vector_pairs(spark, sf_dir), k=10)


def knn_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for question sets that must not be broadcast."""
    return knn_approx(*_vector_pairs(spark, sf_dir), k=10, small=False)


def vector_index_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers from an index of vectors that was written and opened again."""
    path = scratch_path(spark, "kept-vectors")
    asked, vectors = _vector_pairs(spark, sf_dir)
    vector_index(vectors, path=path).close()
    return open_vector_index(spark, path).search(asked, k=10)


def dense_index_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk vectors that were indexed and opened again: only the questions are embedded."""
    path = scratch_path(spark, "kept-chunks")
    numbered = chunks(spark, sf_dir)
    embedded = materialise(
        embed_texts(numbered.select("chunk_index", "text")).select(F.col("chunk_index").alias("vec_id"), "embedding"),
        "chunk-vectors",
    )
    vector_index(embedded, path=path).close()
    rag = DenseRag(numbered, k=4, index=open_vector_index(spark, path))
    return rag.retrieve(qa(spark, sf_dir)).drop("text")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rag = DenseRag(chunks(spark, sf_dir), k=4)
    return rag.retrieve(qa(spark, sf_dir)).drop("text")


# -- prompts and generation -----------------------------------------------


def prompt_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template, filled from every record."""
    values = {
        "context": F.col("context"),
        "question": F.col("question"),
        "answer": F.col("answer"),
        "text": F.col("context"),
        "input": F.col("question"),
        "history": F.col("answer"),
        "statement": F.col("question"),
        "evidence": F.col("context"),
    }
    rendered = [
        F.struct(F.lit(name).alias("template"), render(template, values).alias("prompt"))
        for name, template in TEMPLATES.items()
    ]
    return qa(spark, sf_dir).select("index", F.inline(F.array(*rendered)))


def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = render_prompt(
        turn_pairs(spark, sf_dir), "{{{who}}}: {question} {{context}}", {"who": "conv_id"}
    )
    return prompts.select("conv_id", "turn", "prompt")


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = lexical.extractive_answer(F.col("question"), F.col("built_context"))
    return contexts(spark, sf_dir).select("index", answer.alias("answer"))


def _moody_model(prompts: list[str]) -> list[str | None]:
    if any("tion" in p for p in prompts):
        raise ValueError("cannot read this")
    return [f"{len(p)} characters" for p in prompts]


def generate_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails on some prompts: those rows end empty, with an error."""
    asked = qa(spark, sf_dir).withColumns(
        {"prompt": F.col("context"), "retrieval_context": F.array("context")}
    )
    replied = error_to_empty(generate(asked, make_model=lambda: _moody_model))
    return replied.select(
        "index", "output", "error", F.array_join("retrieval_context", "\n").alias("retrieved")
    )


def ledger_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a prompt, in two runs with one ledger. The second run's model would
    answer otherwise, so its replies show which prompts were asked again."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"))
    kept = Ledger(spark, scratch_path(spark, "turn-calls"))
    kept.ask(turns.where("turn < 2"), model=lambda ps: [f"first {len(p)}" for p in ps], batch_size=16, in_flight=3)
    again = generate_once(turns, kept, model=lambda ps: [f"second {len(p)}" for p in ps], batch_size=16)
    return again.select("conv_id", "turn", "output", "error")


def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = TfIdfRag(chunks(spark, sf_dir), k=5).answer(qa(spark, sf_dir))
    return answered.select(
        "index", "actual_output", F.array_join("retrieval_context", "\n").alias("retrieved"), "error"
    )


def _counting_embedder(texts: list[str]) -> list[list[float]]:
    """Length and number of vowels; fails on texts of some lengths."""
    if any(len(t) % 4 == 0 and t.startswith("Ask: ") for t in texts):
        raise ValueError("no vector")
    bare = [t.removeprefix("Ask: ") for t in texts]
    return [[float(len(t)), float(sum(t.count(v) for v in "aeiou"))] for t in bare]


def answer_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An embedder that fails on some questions: those rows end empty, with an error."""
    rag = DenseRag(chunks(spark, sf_dir), k=2, make_embedder=lambda: _counting_embedder, dim=2)
    asked = qa(spark, sf_dir).withColumn("question", F.concat(F.lit("Ask: "), "question"))
    return rag.answer(asked).select(
        "index", "actual_output", F.array_join("retrieval_context", "\n").alias("retrieved"), "error"
    )


# -- pairs and critique ---------------------------------------------------


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa_history(turn_pairs(spark, sf_dir), n=3).select("conv_id", "turn", "history")


def _drafted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model text of every turn; system turns lack the answer marker, and every other
    turn ends in line breaks."""
    marker = F.when(F.col("role") == "system", F.lit(" Reply: ")).otherwise(F.lit("\nAnswer: "))
    tail = F.when(F.col("turn") % 2 == 0, F.lit(" \n\n")).otherwise(F.lit(""))
    output = F.concat(F.lit("Factoid question: "), "role", F.lit("?"), marker, "text", tail)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", output.alias("output"))


def parse_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.parse_pairs(_drafted_turns(spark, sf_dir)).drop("output")


def qa_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = synthesis.qa_constraints(parse_qa(spark, sf_dir))
    both = valid.withColumn("reason", F.lit("valid")).unionByName(rejected)
    return both.select("conv_id", "turn", "reason")


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripted judge text of five kinds for every document."""
    judged = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    score = F.coalesce(F.col("quality") * 3 + F.col("toxic") + 1, F.lit(9)).cast("string")
    body = F.concat(
        F.lit('{"Evaluation": "{'), "source", F.lit('} is fine", "Score": "'), score, F.lit('"}')
    )
    kind = F.col("doc_id") % 5
    output = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, body)
        .when(kind == 2, F.concat(F.lit("Here you are:\n"), body, F.lit("\nThat is all.")))
        .when(kind == 3, F.concat(F.lit('{"Score": '), score, F.lit("}")))
        .otherwise(F.concat(F.lit('{"Evaluation": "'), "source", F.lit("}")))
    )
    return judged.select("doc_id", output.alias("output"))


def parse_judge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = parsing.parse_judge_json(F.col("output"))
    return judge_replies(spark, sf_dir).select("doc_id", judged.alias("j")).select(
        "doc_id",
        F.col("j.parsed.Evaluation").alias("evaluation"),
        F.col("j.parsed.Score").alias("score"),
        "j.error",
        "j.raw_output",
    )


def validate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_judge_json(spark, sf_dir)
    return parsed.select(
        "doc_id", parsing.valid_score(F.col("evaluation"), F.col("score")).alias("score")
    )


def critique_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).withColumn("context", F.concat_ws(" ", "answer", "question"))
    rated = synthesis.critique(pairs, (*synthesis.CRITIQUES, "answer_relevancy"))
    return rated.select(
        "conv_id",
        "turn",
        "groundedness_score",
        "question_relevance_score",
        "faithfulness_score",
        "answer_relevancy_score",
        "answer_relevancy_eval",
        "faithfulness_error",
    )


def _scripted_judge(prompts: list[str]) -> list[str]:
    """Replies by prompt length; every fourth length is not JSON."""
    return [
        "no idea"
        if len(p) % 4 == 0
        else f'Sure: {{"Evaluation": "length {len(p)}", "Score": "{len(p) % 4 + 2}"}}'
        for p in prompts
    ]


def critique_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same critique through a model call."""
    pairs = turn_pairs(spark, sf_dir).withColumn("context", F.col("answer"))
    rated = synthesis.critique(pairs, ("groundedness",), judge=lambda ps: _scripted_judge(ps))
    return rated.select(
        "conv_id", "turn", "groundedness_score", "groundedness_eval", "groundedness_error"
    )


def location_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripted 0/1 ratings for every labelled document."""
    judged = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    reply = F.concat(
        F.lit('{"Evaluation": "e", "Score": "'),
        F.col("quality").cast("string"),
        F.lit('", "Refined Question": "where in '),
        "source",
        F.lit('?", "Refined Answer": "'),
        "lang",
        F.lit('", "Target Answer": ""}'),
    )
    rated = synthesis.location_dependency(
        judged.select("doc_id", F.col("source").alias("answer"), reply.alias("output"))
    )
    return rated.drop("output", "answer")


def sample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.sample_chunks(chunks(spark, sf_dir), 5).select("chunk_index", "text")


def qa_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = synthesis.qa_prompts(chunks(spark, sf_dir), "short_qa")
    return prompts.select("chunk_index", "prompt")


def assemble_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset, _ = qa_dataset(chunks(spark, sf_dir))
    return dataset


def _chunk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the name of their source as the history told in the prompt."""
    return chunks(spark, sf_dir).withColumn("history", F.concat(F.lit("Q: "), "source", F.lit("?")))


def _writer(prompts: list[str]) -> list[str]:
    """Pairs that tell the prompt's history and length; every seventh length fails, every
    fifth gives no pair."""
    replies = []
    for p in prompts:
        if len(p) % 7 == 0:
            raise RuntimeError("busy")
        told = p.split("Earlier questions and answers:\n", 1)[1].split("\n", 1)[0]
        replies.append("none" if len(p) % 5 == 0 else f"Factoid question: {told}\nAnswer: {len(p)}\n")
    return replies


def _rater(prompts: list[str]) -> list[str]:
    """Valid ratings for even prompt lengths, an invalid score for odd ones."""
    return [
        '{"Evaluation": "e", "Score": "%d", "Refined Question": "", "Refined Answer": ""}'
        % (1 if len(p) % 2 == 0 else 7)
        for p in prompts
    ]


def _written_dataset(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return qa_dataset(
        _chunk_history(spark, sf_dir), make_writer=lambda: _writer, make_judge=lambda: _rater
    )


def assemble_qa_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset from a scripted writer that sees the history, and a scripted judge."""
    return _written_dataset(spark, sf_dir)[0].select("index", "question", "answer", "groundedness_score")


def assemble_qa_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What that dataset leaves out: failed drafts, no pairs, invalid ratings."""
    return _written_dataset(spark, sf_dir)[1].select("index", "question", "answer", "reason")


# -- evaluation -----------------------------------------------------------


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against vectors by position: the shorter table decides."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("index"), "label")
    return zip_align(qa(spark, sf_dir).select("index", "question"), vectors)


def goldens(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = build_goldens(qa(spark, sf_dir))
    return built.withColumn("context", F.get("context", 0))


def evaluation_set(spark: SparkSession, sf_dir: str) -> EvaluationSet:
    return EvaluationSet(TfIdfRag(chunks(spark, sf_dir), k=5), qa(spark, sf_dir))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation_set(spark, sf_dir).test_cases.select(
        "index",
        "input",
        "expected_output",
        "actual_output",
        F.get("context", 0).alias("context"),
        F.array_join("retrieval_context", "\n").alias("retrieved"),
    )


def attached_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the documents that have labels; the others stay empty."""
    goldens_ = documents(spark, sf_dir).select(F.col("doc_id").alias("index"), "source")
    predictions = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("index"),
        F.col("quality").cast("string").alias("actual_output"),
        F.array(F.col("toxic").cast("string")).alias("retrieval_context"),
    )
    joined = attach_predictions(goldens_, predictions)
    return joined.select(
        "index", "source", "actual_output", F.array_join("retrieval_context", "\n").alias("retrieved")
    )


def one_metric(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = metrics.score_cases(evaluation_set(spark, sf_dir).test_cases, [name])
        return scored.select("index", F.col(f"`{name}`").alias("score"))

    return query


def scorer(spark: SparkSession, sf_dir: str) -> Scorer:
    made = Scorer(evaluation_set(spark, sf_dir).test_cases)
    made.calculate_scores()
    return made


def evaluate_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer(spark, sf_dir).results()


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer(spark, sf_dir).metric_means()


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer(spark, sf_dir).overall_metrics()


def overall_custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorer(spark, sf_dir).overall_metrics(CUSTOM_WEIGHTS)


def overall_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = EvaluationSet(DenseRag(chunks(spark, sf_dir), k=3), qa(spark, sf_dir)).test_cases
    thresholds, _ = select_metrics(DEFAULT_CONFIG)
    return reporting.overall_metrics(metrics.evaluate(cases, thresholds))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = F.col("metrics")
    return scorer(spark, sf_dir).summary().select(
        "index",
        "query",
        "actual_output",
        "expected_output",
        F.get("actual_context", 0).alias("actual_context"),
        F.array_join("retrieval_context", "\n").alias("retrieved"),
        scored["Answer Relevancy"].alias("answer_relevancy"),
        scored["Faithfulness"].alias("faithfulness"),
        scored["Contextual Recall"].alias("contextual_recall"),
        scored["Contextual Precision"].alias("contextual_precision"),
    )


def _strict_judge(prompts: list[str]) -> list[str]:
    """Supports a statement if its text stands in the evidence word for word; fails on
    statements of some lengths."""
    replies = []
    for p in prompts:
        body = p.split("Statement: ", 1)[1]
        statement, evidence = body.split("\nEvidence: ", 1)
        if len(statement) % 11 == 0:
            raise ValueError("too long")
        replies.append('{"verdict": "%s"}' % ("yes" if statement in evidence else "no"))
    return replies


def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model judges the statements of every assistant answer against the question."""
    cases = turn_pairs(spark, sf_dir).select(
        F.struct("conv_id", "turn").alias("index"),
        F.concat_ws(" ", "answer", "question").alias("actual_output"),
        F.array(txt.clean(F.col("answer"))).alias("retrieval_context"),
    )
    judged = metrics.judge_verdicts(cases, lambda ps: _strict_judge(ps))
    return judged.select("index.conv_id", "index.turn", "score", "n_statements", "n_failed", "error")


def _reading_judge(prompts: list[str]) -> list[str]:
    """Reads the task: a statement helps with a question that has its second word; text
    supports a statement, and a passage is of use for an answer, that stands in it word
    for word. Fails on statements and answers of some lengths."""
    replies = []
    for p in prompts:
        task, body = p.split("\n", 1)
        if task == "Does the statement help to answer the question?":
            question, statement = body.split("\nQuestion: ", 1)[1].removesuffix("\n").rsplit("\nStatement: ", 1)
            holds = (statement.split(" ") + [""])[1] in question
        elif task == "Does the evidence support the statement?":
            statement, evidence = body.split("\nStatement: ", 1)[1].split("\nEvidence: ", 1)
            holds = statement in evidence
        elif task == "Does the passage help to arrive at the expected answer to the question?":
            statement, passage = body.split("\nExpected answer: ", 1)[1].split("\nPassage: ", 1)
            holds = statement in passage
        else:
            raise RuntimeError("no such task")
        if len(statement) % 11 == 0:
            raise ValueError("too long")
        replies.append('{"verdict": "%s"}' % ("yes" if holds else "no"))
    return replies


def judged_scorer(spark: SparkSession, sf_dir: str) -> Scorer:
    """All four metrics from a scripted judge that reads the task of each metric and fails on
    some statements; its calls overlap and are kept in a ledger."""
    kept = Ledger(spark, scratch_path(spark, "judged-calls"))
    cases = evaluation_set(spark, sf_dir).test_cases
    made = Scorer(cases, make_judge=lambda: _reading_judge, calls={"in_flight": 4, "ledger": kept})
    made.calculate_scores()
    return made


def evaluate_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_scorer(spark, sf_dir).results().select("index", "metric", "score", "success")


def overall_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judged_scorer(spark, sf_dir)
    return made.overall_metrics().join(made.failures(), "metric", "left")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return own_queries() | training_queries()


def training_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if llm_queries is None:
        return {}
    return llm_queries.queries() | {"pipeline": corpus_pipeline.run}


def own_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "json_roundtrip": json_roundtrip,
        "read_qa_head": read_qa_head,
        "delimited_roundtrip": delimited_roundtrip,
        "rename_columns": renamed_columns,
        "load_vectors": loaded_vectors,
        "load_pages": loaded_pages,
        "page_text": page_text,
        "clean_text": clean_text,
        "validate_records": validated_records,
        "split_sentences": split_sentences,
        "sentence_chunks": sentence_chunks,
        "chunk_overlap": chunk_overlap,
        "recursive_chunks": recursive_chunks,
        "semantic_chunks": semantic_chunks,
        "chunk_index": chunk_index,
        "stream_chunk_index": stream_chunk_index,
        "chunk_stats": chunk_stats,
        "term_freq": term_freq,
        "idf": idf,
        "tfidf_weights": tfidf_weights,
        "tfidf_scores": tfidf_scores,
        "tfidf_topk": tfidf_topk,
        "tfidf_topk_padded": tfidf_topk_padded,
        "tfidf_retrieval": tfidf_retrieval,
        "tfidf_many_questions": many_questions,
        "index_reopened": index_reopened,
        "build_context": build_context,
        "retrieval_context": retrieval_context,
        "hash_embed": hash_embed,
        "knn_exact": knn_all,
        "knn_blocks": knn_blocks,
        "knn_scaled": knn_scaled,
        "knn_approx": knn_approximate,
        "knn_cells": knn_cells,
        "vector_index_reopened": vector_index_reopened,
        "dense_topk": dense_topk,
        "dense_index_reopened": dense_index_reopened,
        "prompt_catalogue": prompt_catalogue,
        "render_prompt": rendered_prompts,
        "extractive_answer": extractive_answer,
        "generate_with_errors": generate_with_errors,
        "ledger_restart": ledger_restart,
        "answer_questions": answered_questions,
        "answer_with_failures": answer_with_failures,
        "qa_from_turns": turn_pairs,
        "qa_history": history,
        "parse_qa": parse_qa,
        "qa_constraints": qa_constraints,
        "parse_judge_json": parse_judge_json,
        "validate_score": validate_score,
        "critique_scores": critique_scores,
        "critique_model": critique_model,
        "location_dependency": location_dependency,
        "sample_chunks": sample_chunks,
        "qa_prompts": qa_prompts,
        "assemble_qa": assemble_qa,
        "assemble_qa_history": assemble_qa_history,
        "assemble_qa_rejected": assemble_qa_rejected,
        "zip_align": zipped,
        "goldens": goldens,
        "attach_predictions": attached_predictions,
        "test_cases": test_cases,
        "answer_relevancy": one_metric("Answer Relevancy"),
        "faithfulness": one_metric("Faithfulness"),
        "contextual_recall": one_metric("Contextual Recall"),
        "contextual_precision": one_metric("Contextual Precision"),
        "evaluate_long": evaluate_long,
        "metric_means": metric_means,
        "overall_metrics": overall_metrics,
        "overall_custom_weights": overall_custom_weights,
        "overall_dense": overall_dense,
        "summary": summary,
        "judge_verdicts": judge_verdicts,
        "evaluate_judged": evaluate_judged,
        "overall_judged": overall_judged,
    }


def oracle_sql() -> dict[str, str]:
    if llm_queries is None:
        return oracle_queries.oracle_sql()
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return oracle_queries.oracle_sql() | llm_queries.oracle_sql() | whole
