"""Token counts against one call of the library per whole text."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from fixtures import documents, empty

from fathomline.llm import queries, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.01"
KINDS = [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading"), ("piece_bpe_32k.model", "prefixed")]

ODD = [
    "",
    " ",
    "\n\n\t",
    "a",
    " lead and trail ",
    "two  spaces   three no-break em　wide",
    "line\r\nends\rhere\vthere\fdone\x85next sep",
    "it's we're I'll 's ' s don 't",
    "é café ́alone a ́b Å",
    "ΟΔΥΣΣΕΥΣ ΟΔΟΣ Σ İstanbul STRASSE ẞ",
    "漢字かな交じり文。次の文、また。 한국어 텍스트",
    "<|endoftext|>", "a<|endoftext|>b", "x <|startoftext|> y<|ENDOFTEXT|> z", "<|endof text|> <|endoftext |>",
    "12345 a1b2 3 . 4,5 !?!? ... --",
    "\u0000 nul � \U0001f600‍\U0001f4bb zero​width",
    "fi ﬁ Å Å ½ ² Ⅷ",
    "word" * 3000,
    "</s><s> <unk> ▁ ▁▁a",
]


def whole_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [len(model.encode(t)) for t in texts]


def mixtures(n, seed=1):
    rng = random.Random(seed)
    parts = [*"aBé漢Σ1'!.<|>", " ", "  ", "\n", "\t", "́", " ", "\r", "ing", "The", "<|endoftext|>", "'s", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("name, spacing", KINDS)
@pytest.mark.parametrize("limit", [1 << 20, 16])
def test_pieces_sum_to_the_whole(monkeypatch, name, spacing, limit):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 64)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rows = tokens.windows
    monkeypatch.setattr(tokens, "windows", lambda column, kind: rows(column, kind, limit))
    with open(public_tokenizers.path(name), "rb") as file:
        make = tokens.json_encoder if name.endswith(".json") else tokens.model_encoder
        counter = tokens.Counter(make(file.read()))
    texts = ODD + mixtures(400)
    expected = whole_counts(name, texts)
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts, None]).slice(1, len(texts))):
        found = counter.rows(column, spacing).tolist()
        assert [(t, n) for t, n, m in zip(texts, found, expected) if n != m] == []


def test_rows(spark):
    long = "many words in a row, " * 100_000
    rows = [(1, "one two"), (1, "one two"), (1, "other"), (2, None), (3, ""), (None, "no id"), (4, long)]
    found = tokens.token_counts(documents(spark, rows), public_tokenizers.path("word_bpe_49k.json"))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    counts = whole_counts("word_bpe_49k.json", [t or "" for _, t in rows])
    expected = [(i, len((t or "").encode()), n) for (i, t), n in zip(rows, counts)]
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected, key=key)
    assert tokens.token_counts(empty(spark), public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_what_is_not_known(spark, tmp_path):
    with pytest.raises(ValueError, match="spacing"):
        tokens.token_counts(empty(spark), "x.json", spacing="none")
    with pytest.raises(ValueError, match="no tokenizer"):
        tokens.token_counts(empty(spark), "x.txt")


def test_op11(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.queries()["op11_token_counts"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    counts = dict(zip(texts, whole_counts("word_bpe_49k.json", list(texts.values()))))
    for r in found:
        n = counts[r["doc_id"]]
        assert tuple(r)[1:] == (len(texts[r["doc_id"]].encode()), n, n > 2048)
