"""Answering a table of questions: retrieve, build the context, generate.

Subclass ``Rag`` and override ``retrieve`` or ``generate`` for other strategies.
Both map DataFrames to DataFrames, so a custom step is planned like the rest.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.lexical import extractive_answer
from fathomline.functions.prompts import TEMPLATES, render
from fathomline.operators.embedding import Embedder, embed_texts
from fathomline.operators.generation import Model, error_to_empty
from fathomline.operators.indexing import TfIdfIndex, tfidf_index
from fathomline.operators.ledger import replied
from fathomline.operators.neighbours import knn_exact
from fathomline.operators.retrieval import (
    TOP_K,
    attach_text,
    gather_context,
    questions_fit,
    tfidf_retrieve,
)
from fathomline.operators.vector_index import VectorIndex, vector_index
from fathomline.functions.hashing import DIMENSION
from fathomline.schemas import require
from fathomline.sources.vectors import checked_vectors
from fathomline.storage import materialise


class Rag(ABC):
    """``model`` maps a list of prompts to a list of replies; ``make_model`` builds one
    once per task. Without either the answer is the context sentence closest to the
    question. ``calls`` are options of the model's calls (see ``replied``)."""

    template = TEMPLATES["context_answer"]

    def __init__(
        self,
        model: Model | None = None,
        k: int = TOP_K,
        make_model: Callable[[], Model] | None = None,
        calls: dict | None = None,
    ) -> None:
        if k < 1:
            raise ValueError("k must be positive")
        self.model = model
        self.make_model = make_model
        self.calls = calls
        self.k = k

    @abstractmethod
    def retrieve(self, questions: DataFrame) -> DataFrame:
        """``(index, rank, text, ...)`` for ``questions(index, question)``."""

    def failed(self) -> DataFrame | None:
        """``(index, error)`` of the questions for which the last retrieval failed."""
        return None

    def prompt(self) -> Column:
        return render(
            self.template, {"context": F.col("built_context"), "question": F.col("question")}
        )

    def generate(self, asked: DataFrame) -> DataFrame:
        """Add ``_reply``, a ``struct<output, error>``, to questions with context."""
        if self.model is not None or self.make_model is not None:
            return replied(asked, "_reply", self.prompt(), self.model, self.make_model, self.calls)
        answer = extractive_answer(F.col("question"), F.col("built_context"))
        return asked.withColumn(
            "_reply",
            F.struct(answer.alias("output"), F.lit(None).cast("string").alias("error")),
        )

    def answer(self, questions: DataFrame) -> DataFrame:
        """``index, question, built_context, retrieval_context, actual_output, error``.

        A failed question keeps its error and gets an empty answer and list.
        """
        require(questions, index="bigint", question="string")
        asked = questions.select("index", "question")
        hits = require(self.retrieve(asked), index="bigint", rank="int", text="string")
        failed = self.failed()
        if failed is not None:
            lost = asked.join(failed, "index")
            asked = asked.join(failed, "index", "left_anti")
        replied = self.generate(gather_context(asked, hits))
        answered = replied.select(
            "index",
            "question",
            "built_context",
            "retrieval_context",
            F.col("_reply.output").alias("actual_output"),
            F.col("_reply.error").alias("error"),
        )
        if failed is not None:
            nothing = F.array().cast("array<string>")
            answered = answered.union(
                lost.select(
                    "index", "question", F.lit(""), nothing, F.lit(None).cast("string"), "error"
                )
            )
        return error_to_empty(answered, "actual_output")


class TfIdfRag(Rag):
    """Keyword retrieval over a numbered chunk table."""

    template = TEMPLATES["chat_answer"]

    def __init__(
        self,
        chunks: DataFrame,
        model: Model | None = None,
        k: int = TOP_K,
        index: TfIdfIndex | None = None,
        pad: bool = True,
        make_model: Callable[[], Model] | None = None,
        calls: dict | None = None,
    ) -> None:
        super().__init__(model, k, make_model, calls)
        self.chunks = chunks
        self.index = index if index is not None else tfidf_index(chunks)
        self.pad = pad

    def prompt(self) -> Column:
        return render(
            self.template, {"context": F.col("built_context"), "input": F.col("question")}
        )

    def retrieve(self, questions: DataFrame) -> DataFrame:
        return tfidf_retrieve(questions, self.chunks, self.index, self.k, self.pad)


class DenseRag(Rag):
    """Vector retrieval. ``vectors(vec_id, embedding)`` uses chunk numbers as ids;
    by default the chunks are embedded here.

    ``index`` is a ``vector_index`` of such vectors, for instance one that was kept and
    opened again: nothing is embedded then but the questions. ``approximate`` makes an index
    here, with these options of ``vector_index``. Without either every vector is compared;
    the result is the same.
    """

    def __init__(
        self,
        chunks: DataFrame,
        model: Model | None = None,
        k: int = TOP_K,
        embedder: Embedder | None = None,
        vectors: DataFrame | None = None,
        dim: int = DIMENSION,
        approximate: dict | None = None,
        make_model: Callable[[], Model] | None = None,
        make_embedder: Callable[[], Embedder] | None = None,
        index: VectorIndex | None = None,
        calls: dict | None = None,
    ) -> None:
        super().__init__(model, k, make_model, calls)
        self.chunks = chunks
        self.embedder, self.make_embedder = embedder, make_embedder
        self._failed: DataFrame | None = None
        self.dim = dim
        self.index = index
        if index is not None:
            self.vectors = index.vectors.select("vec_id", "embedding")
        elif vectors is None:
            embedded = embed_texts(chunks.select("chunk_index", "text"), "text", embedder, dim, make_embedder=make_embedder)
            # written once, so that no chunk is embedded again
            self.vectors = materialise(
                embedded.select(F.col("chunk_index").alias("vec_id"), "embedding"), "vectors"
            )
        else:
            self.vectors = checked_vectors(vectors, dim)
        if index is None and approximate is not None:
            self.index = vector_index(self.vectors, **approximate)

    def failed(self) -> DataFrame | None:
        return self._failed

    def retrieve(self, questions: DataFrame) -> DataFrame:
        embedded = embed_texts(
            questions, "question", self.embedder, self.dim, error="error", make_embedder=self.make_embedder
        )
        every = materialise(embedded, "asked")
        self._failed = every.where("error is not null").select("index", "error")
        asked = every.where("error is null").select("index", "embedding")
        if self.index is None:
            found = knn_exact(asked, self.vectors, self.k)
        else:
            found = self.index.search(asked, self.k)
        hits = found.withColumnRenamed("vec_id", "chunk_index")
        return attach_text(hits, self.chunks, questions_fit(questions, self.k)).select(
            "index", "rank", "chunk_index", "distance", "text"
        )
