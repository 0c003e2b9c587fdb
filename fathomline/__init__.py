"""Retrieval and evaluation of question-answering data as Spark jobs."""
