from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import parsing
from fathomline.functions.prompts import TEMPLATES, render
from fathomline.operators.chunking import sentence_chunks
from fathomline.operators.cleaning import clean_pages
from fathomline.sources.documents import load_pages
from fathomline.streaming.numbering import number_stream, numbered_chunks
from fathomline.streaming.row_local import read_file_stream, run_available

SF = "/root/testdata/sf0.001"


def prepared(documents):
    chunks = sentence_chunks(clean_pages(load_pages(documents)), 100, 20)
    prompt = render(TEMPLATES["short_qa"], {"text": F.col("text")})
    pair = parsing.parse_qa(F.concat(F.lit("Factoid question: q\nAnswer: "), "text"))
    return chunks.withColumns({"prompt": prompt, "pair": pair})


def test_stream_equals_batch(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.repartition(4).write.parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = read_file_stream(spark, str(tmp_path / "in"), documents.schema, max_files_per_trigger=1)
    for _ in range(2):  # the second run finds nothing new
        query = run_available(stream, prepared, out, state)
        query.awaitTermination()
        assert query.exception() is None
    batch = prepared(documents)
    streamed = spark.read.parquet(out)
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_numbers_go_on_over_batches_restarts_and_repeats(spark, tmp_path):
    def arrive(name, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        docs.coalesce(1).write.parquet(str(tmp_path / "in" / name))

    path, state = str(tmp_path / "out"), str(tmp_path / "state")
    schema = "doc_id long, text string, source string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        query = number_stream(stream, path, state, chunk_size=2, overlap=0)
        query.awaitTermination()
        found = numbered_chunks(spark, path).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in found] == list(range(len(found)))
        return [(r.batch, r.doc_id, r.page_no, r.chunk_pos) for r in found]

    arrive("a", [(5, "One two. Three four.\fFive.", "s"), (1, "Six seven. Eight nine.", "s")])
    first = run()
    assert first == [(0, 1, 0, 0), (0, 1, 0, 1), (0, 5, 0, 0), (0, 5, 0, 1), (0, 5, 1, 0)]
    arrive("b", [(0, "", "s"), (2, None, "s")])
    arrive("c", [(3, "A b. C d.", "s"), (1, "Again here.", "s")])
    second = run()
    assert second[:5] == first and [r[1:] for r in second[5:]] == [(1, 0, 0), (3, 0, 0), (3, 0, 1)]
    # the last batch is lost before it was committed, and runs again
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    assert run() == second
    # a batch whose row is missing is not shown
    assert spark.read.parquet(f"{path}/chunks").count() == 8
