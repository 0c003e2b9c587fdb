"""Benchmark decontamination by winnowing.

The fingerprints of a text are the least k-gram hashes of its sliding windows, so two texts
that share a long enough span share a fingerprint. Fingerprints of documents and benchmark
items are joined; around each hit, the windows that contain it are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.rows import BROADCAST_KEYS, drop_rows, text_key
from fathomline.storage import fits_in_memory, materialise

WINDOW_WORDS = 10
GRAM_WORDS = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, _GAPS), "")


def _runs(count: Column, size: int) -> Column:
    """0-based starts of all runs of ``size`` among ``count`` neighbours."""
    return F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))


def gram_hashes(tokens: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, in order.

    Words are hashed once; a run's hash mixes its words' hashes.
    """
    mixed = lambda hashes: F.transform(
        _runs(F.size(hashes), size), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)])
    )
    return _bound(F.transform(tokens, lambda w: F.xxhash64(w)), mixed)


def winnowed(hashes: Column, size: int) -> Column:
    """Distinct least hashes of every run of ``size`` neighbouring hashes."""
    return F.array_distinct(
        F.transform(_runs(F.size(hashes), size), lambda i: F.least(*[F.get(hashes, i + k) for k in range(size)]))
    )


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, not at every mention."""
    return F.transform(F.array(value), use)[0]


def _fingerprints(tokens: Column, window: int, gram: int) -> Column:
    return _bound(gram_hashes(tokens, gram), lambda h: winnowed(h, window - gram + 1))


def _windows(items: DataFrame, window: int) -> DataFrame:
    """``(size, phrase, item_ids)``: every distinct window of the items' words.

    An item with fewer words than ``window`` is one window of its own size.
    """
    size = F.least(F.size("words"), F.lit(window))
    phrases = F.transform(
        F.sequence(F.lit(1), F.size("words") - size + 1),
        lambda i: F.array_join(F.slice("words", i, size), " "),
    )
    each = items.where(F.size("words") > 0).select("item_id", size.alias("size"), F.explode(phrases).alias("phrase"))
    return each.groupBy("size", "phrase").agg(F.collect_set("item_id").alias("item_ids"))


def leaks(
    docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS
) -> DataFrame:
    """``(doc_id, key, n_words, n_hit, n_items, item_ids)`` for every row of ``docs``.

    A window is ``window`` neighbouring words of an item, or all words of an item that has
    fewer. ``n_hit`` counts the document's words inside any occurrence of a window, and
    ``item_ids`` are the items with occurring windows, as sorted text joined by commas.
    With k-grams of ``gram`` words and fingerprints from ``window - gram + 1`` of them, any
    shared window has a shared fingerprint, so none is missed. Items shorter than a window
    are looked up by runs of their own length, which only happens if there are such items.

    A null or empty text has no words and no hits; such items have no windows. Repeated
    items and ids count once; an item without an id leaks like others but is not named. Rows
    that repeat id and text get equal results, rows without an id get theirs too. An empty
    table of documents gives an empty result, an empty benchmark no hits. Other columns are
    ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"), "text"
    )
    tokens = items.select("item_id", words(F.col("text")).alias("words"))
    windows = materialise(_windows(tokens, window), "windows")
    starts = materialise(_long_hits(rows, tokens, windows, window, gram), "long-hits")
    short = [r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect()]
    for size in sorted(short):  # at most window - 1 sizes
        starts = starts.union(_short_hits(rows, windows, size))
    covered = starts.groupBy("_id", "_key").agg(
        F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
    )
    # spans in order of their starts; each adds the words beyond the furthest end so far
    grown = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["size"]).alias("end"),
            (s["total"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(s["end"], x["start"]))).alias("total"),
        ),
    )["total"]
    names = F.array_sort(F.transform(F.array_compact("items"), lambda i: i.cast("string")))
    told = materialise(
        covered.select(
            F.col("_id"),
            F.col("_key"),
            grown.cast("long").alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.array_join(names, ",").alias("item_ids"),
        ),
        "leaks",
    )
    counted = rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_key").alias("key"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
        .cast("long")
        .alias("n_words"),
    )
    joined = counted.join(
        _small(told), counted["doc_id"].eqNullSafe(told["_id"]) & (counted["key"] == told["_key"]), "left"
    )
    nothing = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "key",
        "n_words",
        F.coalesce("n_hit", nothing).alias("n_hit"),
        F.coalesce("n_items", nothing).alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"),
    )


def _small(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if its rows measure small."""
    size = sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(64))
    return F.broadcast(df) if fits_in_memory(df, size, BROADCAST_KEYS) else df


def _long_hits(rows, tokens, windows, window: int, gram: int) -> DataFrame:
    """``(_id, _key, start, size, item_ids)`` of full windows that occur in a row."""
    prints = materialise(
        tokens.where(F.size("words") >= window)
        .select(F.explode(_fingerprints(F.col("words"), window, gram)).alias("print"))
        .distinct(),
        "fingerprints",
    )
    found = rows.select(
        "_id", "_key", F.explode(_fingerprints(words(F.col("text")), window, gram)).alias("print")
    ).join(_small(prints), "print")
    hits = materialise(found.groupBy("_id", "_key").agg(F.collect_set("print").alias("prints")), "hits")
    small = _small(hits)
    again = rows.join(small, rows["_id"].eqNullSafe(small["_id"]) & (rows["_key"] == small["_key"])).select(
        rows["_id"], rows["_key"], words(F.col("text")).alias("words"), "prints"
    )
    # a window that contains a hit starts up to window - gram words before it
    near = F.transform(
        F.filter(
            F.transform(gram_hashes(F.col("words"), gram), lambda h, i: F.when(F.array_contains("prints", h), i)),
            lambda i: i.isNotNull(),
        ),
        lambda i: F.sequence(F.greatest(i - (window - gram), F.lit(0)), i),
    )
    starts = again.select(
        "_id", "_key", "words", F.explode(F.array_distinct(F.flatten(near))).alias("start")
    ).where(F.col("start") + window <= F.size("words"))
    phrases = starts.select(
        "_id", "_key", "start", F.array_join(F.slice("words", F.col("start") + 1, window), " ").alias("phrase")
    )
    full = windows.where(F.col("size") == window)
    return phrases.join(_small(full), "phrase").select("_id", "_key", "start", "size", "item_ids")


def _short_hits(rows, windows, size: int) -> DataFrame:
    """The same for items of exactly ``size`` words."""
    runs = rows.select("_id", "_key", words(F.col("text")).alias("words")).select(
        "_id",
        "_key",
        F.posexplode(
            F.transform(_runs(F.size("words"), size), lambda i: F.array_join(F.slice("words", i + 1, size), " "))
        ).alias("start", "phrase"),
    )
    short = windows.where(F.col("size") == size)
    return runs.join(_small(short), "phrase").select("_id", "_key", "start", "size", "item_ids")


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item."""
    found = leaks(docs, items, **options).where("n_hit > 0")
    gone = materialise(
        found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "gone"
    )
    return drop_rows(docs, gone)
