"""Token counts of whole texts by a given tokenizer, lengths only.

Texts are cut where no token can cross: a text is the sum of its pieces. Arrow batches
are read in windows of bounded bytes, a window's distinct pieces are encoded once, in
batches of about equal bytes, and only lengths leave the encoder.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.storage import spread

#: bytes of text read at a time, and bytes handed to the encoder at a time
WINDOW_BYTES = 1 << 20
BATCH_BYTES = 1 << 17
#: pieces whose lengths a task remembers, and the longest piece it remembers
REMEMBERED = 1 << 18
SHORT = 64
#: the vocabulary is sent to the tasks, so its size is checked
VOCABULARY_BYTES = 128 << 20

#: how a tokenizer treats the space between two words, and so where a text may be cut:
#: ``dropped``: white space is no part of a token; cut at every run of it.
#: ``leading``: a space belongs to the word behind; cut in front of one between letters.
#: ``prefixed``: the encoder puts a space in front; drop one between letters and cut there.
SPACING = ("dropped", "leading", "prefixed")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _cuts(data: np.ndarray, spacing: str) -> np.ndarray:
    """Which bytes are boundaries: white space, or single spaces between ASCII letters."""
    if spacing == "dropped":
        return _SPACE[data]
    cut = np.zeros(len(data), bool)
    if len(data) > 2:
        letter = _LETTER[data]
        cut[1:-1] = (data[1:-1] == 0x20) & letter[:-2] & letter[2:]
    return cut


def windows(column: pa.Array, spacing: str, limit: int = WINDOW_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row bounds of parts of a text column, of about ``limit`` bytes.

    Neighbouring short rows share a part. A longer text comes in several parts that end at
    boundaries; where it has none, a part grows until the next one. Null texts are empty.
    """
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1] or b"\0" * 8, kind)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        if end > row:
            yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end
            continue
        at, stop = int(offsets[row]), int(offsets[row + 1])
        while at < stop:
            to, reach = stop, limit
            while at + reach < stop:
                found = np.flatnonzero(_cuts(raw[at : at + reach], spacing)[1:])
                if len(found):
                    to = at + 1 + int(found[-1])
                    break
                reach *= 2
            yield row, raw[at:to], np.array([0, to - at])
            at = to + 1 if spacing == "prefixed" and to < stop else to
        row += 1


def pieces(data: np.ndarray, bounds: np.ndarray, spacing: str) -> tuple[pa.Array, np.ndarray]:
    """The pieces between boundaries as one Arrow column, and the row of each."""
    cut = _cuts(data, spacing)
    if spacing != "dropped":
        # a boundary needs a letter of the same row on both sides
        edges = bounds[(bounds > 0) & (bounds < len(data))]
        cut[edges] = False
        cut[edges - 1] = False
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds[:-1]] = True
    if spacing == "leading":
        begins[:-1] |= cut
        gone = np.zeros(len(data), bool)
    else:
        gone = cut
        begins[1:] |= cut
    # consecutive boundaries, and rows that are empty or end in one, leave empty pieces out
    first = np.flatnonzero(begins[:-1])
    sizes = np.diff(np.concatenate((np.zeros(1, np.int64), np.cumsum(~gone, dtype=np.int64)))[np.append(first, len(data))])
    first, sizes = first[sizes > 0], sizes[sizes > 0]
    rows = np.searchsorted(bounds, first, "right") - 1
    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    kept = np.ascontiguousarray(data[~gone])
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(kept)), rows


Encoder = Callable[[list[str]], list[int]]


def json_encoder(vocabulary: bytes) -> Encoder:
    """Lengths by the ``tokenizers`` library; no special tokens are added, texts are whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def model_encoder(vocabulary: bytes) -> Encoder:
    """Lengths by the ``sentencepiece`` library, without begin and end tokens."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_proto=vocabulary)
    return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]


def _byte_batches(texts: list[str], sizes: list[int]) -> Iterator[list[str]]:
    """Neighbouring texts of about ``BATCH_BYTES`` together; a longer one is alone."""
    batch, size = [], 0
    for text, n in zip(texts, sizes):
        if batch and size + n > BATCH_BYTES:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


class Counter:
    """Piece lengths by an encoder; each piece is encoded once while it is remembered."""

    def __init__(self, encode: Encoder) -> None:
        self.encode = encode
        self.known: dict[str, int] = {}

    def lengths(self, distinct: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in distinct if p not in self.known]
        found = {}
        for batch in _byte_batches(new, [len(p.encode()) for p in new]):
            found.update(zip(batch, self.encode(batch)))
        result = np.array([found[p] if p in found else self.known[p] for p in distinct], np.int64)
        self.known.update((p, n) for p, n in found.items() if len(p) <= SHORT)
        return result

    def rows(self, column: pa.Array, spacing: str) -> np.ndarray:
        """Tokens of every row of a text column."""
        total = np.zeros(len(column), np.int64)
        for first, data, bounds in windows(column, spacing):
            texts, rows = pieces(data, bounds, spacing)
            coded = texts.dictionary_encode()
            lengths = self.lengths(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            np.add.at(total, first + rows, lengths)
        return total


def token_counts(docs: DataFrame, path: str, spacing: str = "dropped", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for every row: UTF-8 bytes and tokens of its ``text``.

    ``path`` names the driver's file of a tokenizer: ``.json`` for ``tokenizers``, ``.model``
    for ``sentencepiece``. The file goes to the tasks, whatever their own folders hold.
    ``spacing`` says how it treats spaces (see ``SPACING``); ``dropped`` fits tokenizers
    whose words never hold white space. The counts are those of the whole text in one call
    of the library with its defaults: no token is added, special strings inside a text are
    handled as the library does, nothing is truncated or padded.

    A null text counts as empty: 0 bytes and 0 tokens. Rows are independent, so repeated
    rows and repeated or missing ids give one row each; an empty table gives none. Other
    columns are ignored. A text's memory is bounded by ``WINDOW_BYTES``, or by its longest
    stretch without a boundary, which the encoder must see whole.
    """
    if spacing not in SPACING:
        raise ValueError(f"spacing must be one of {', '.join(SPACING)}")
    kinds = {".json": json_encoder, ".model": model_encoder}
    make = kinds.get(os.path.splitext(path)[1])
    if make is None:
        raise ValueError(f"no tokenizer is known for {path}")
    with open(path, "rb") as file:
        vocabulary = file.read(VOCABULARY_BYTES + 1)
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {VOCABULARY_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(make(shared.value))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array(counter.rows(batch.column("text"), spacing)),
                ],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        whole.alias("text"),
    )
    return spread(rows, "doc_id").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
