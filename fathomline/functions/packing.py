"""Greedy packing of sentence sizes into chunks, folded inside one row.

Spark copies the accumulator of ``aggregate`` at every step. The fold therefore
runs over blocks of positions: the inner fold collects the few bounds of its
block, and the outer fold appends them to the full list once per block. Nothing
else grows, so a text with very many sentences stays cheap.

The folds look single items up by position. Arrays are therefore bound to a
variable first: the optimizer would otherwise copy their whole expression into
the fold and evaluate it at every step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import bind

BOUND = "struct<start:int,stop:int,tokens:int>"
BLOCK = 512


def _bound(start: Column, stop: Column, tokens: Column) -> Column:
    return F.struct(start.alias("start"), stop.alias("stop"), tokens.alias("tokens"))


def _open(start: Column, tokens: Column, out: Column) -> Column:
    """The chunk being filled, and the bounds closed so far."""
    return F.struct(start.alias("start"), tokens.alias("tokens"), out.alias("out"))


def _no_bounds() -> Column:
    return F.array().cast(f"array<{BOUND}>")


def _fold(
    sizes: Column,
    closes: Callable[[Column, Column, Column], Column],
    carried: Callable[[Column, Column], Column] | None = None,
) -> Column:
    """Walk over the items once, closing a chunk before item ``at`` where
    ``closes(at, start, tokens)`` holds. ``carried(at, start)`` gives the items
    and tokens of the closed chunk that also open the next one."""
    count = F.size(sizes)

    def step(state: Column, at: Column) -> Column:
        size = F.get(sizes, at)
        out = F.concat(state["out"], F.array(_bound(state["start"], at, state["tokens"])))
        if carried is None:
            restarted = _open(at, size, out)
        else:
            restarted = F.transform(
                F.array(carried(at, state["start"])),
                lambda kept: _open(at - kept["n"], kept["tokens"] + size, out),
            )[0]
        continued = _open(state["start"], state["tokens"] + size, state["out"])
        return F.when(closes(at, state["start"], state["tokens"]), restarted).otherwise(continued)

    def block(state: Column, first: Column) -> Column:
        positions = F.sequence(first, F.least(first + BLOCK, count) - 1)
        walked = F.aggregate(positions, _open(state["start"], state["tokens"], _no_bounds()), step)
        return F.transform(
            F.array(walked),
            lambda w: _open(w["start"], w["tokens"], F.concat(state["out"], w["out"])),
        )[0]

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.array(_bound(state["start"], count, state["tokens"])))

    firsts = F.sequence(F.lit(0), count - 1, F.lit(BLOCK))
    packed = F.aggregate(firsts, _open(F.lit(0), F.lit(0), _no_bounds()), block, finish)
    return F.when(count > 0, packed).otherwise(_no_bounds())


def pack(sizes: Column, limit: int, overlap: int = 0, min_items: int = 1) -> Column:
    """Chunk bounds ``[start, stop)`` with their token counts.

    A chunk closes when it holds ``min_items`` sentences and the next one would
    exceed ``limit``; the next chunk starts with the longest run of trailing
    sentences that fits in ``overlap`` tokens and still leaves room. A sentence
    longer than ``limit`` makes a chunk by itself.
    """
    if limit < 1 or overlap < 0 or min_items < 1:
        raise ValueError("limit and min_items must be positive, overlap not negative")
    return bind(sizes, lambda bound: _pack(bound, limit, overlap, min_items))


def _pack(sizes: Column, limit: int, overlap: int, min_items: int) -> Column:
    def closes(at: Column, start: Column, tokens: Column) -> Column:
        return (at - start >= min_items) & (tokens + F.get(sizes, at) > limit)

    def carried(at: Column, start: Column) -> Column:
        # Every sentence has at least one token: looking back over ``overlap``
        # sentences is enough. The first sentence of a chunk never repeats.
        budget = F.least(F.lit(overlap), F.lit(limit) - F.get(sizes, at))

        def keep(kept: Column, back: Column) -> Column:
            size = F.get(sizes, at - back)
            fits = ~kept["full"] & (at - back > start) & (kept["tokens"] + size <= budget)
            longer = F.struct(
                (kept["n"] + 1).alias("n"),
                (kept["tokens"] + size).alias("tokens"),
                F.lit(False).alias("full"),
            )
            done = F.struct(
                kept["n"].alias("n"), kept["tokens"].alias("tokens"), F.lit(True).alias("full")
            )
            return F.when(fits, longer).otherwise(done)

        none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("tokens"), F.lit(False).alias("full"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(overlap)), none, keep)

    return _fold(sizes, closes, carried if overlap else None)


def pack_at_breaks(
    sizes: Column, similarities: Column, limit: int, min_items: int, threshold: float
) -> Column:
    """Chunk bounds that close at a topic break or when ``limit`` is reached.

    ``similarities[i]`` compares item ``i`` with the item before it.
    """
    if limit < 1 or min_items < 1:
        raise ValueError("limit and min_items must be positive")
    return bind(
        similarities,
        lambda near: bind(
            sizes, lambda bound: _pack_at_breaks(bound, near, limit, min_items, threshold)
        ),
    )


def _pack_at_breaks(
    sizes: Column, similarities: Column, limit: int, min_items: int, threshold: float
) -> Column:
    def closes(at: Column, start: Column, tokens: Column) -> Column:
        topic_break = (at - start >= min_items) & (F.get(similarities, at) < threshold)
        full = (at - start >= 1) & (tokens + F.get(sizes, at) > limit)
        return topic_break | full

    return _fold(sizes, closes)


def assemble(items: Column, bounds: Column) -> Column:
    """``array<struct<text, tokens>>``: the items of each chunk joined by a space."""

    def joined(bound: Column, every: Column) -> Column:
        positions = F.sequence(bound["start"], bound["stop"] - 1)
        return F.array_join(F.transform(positions, lambda i: F.get(every, i)), " ")

    return bind(
        items,
        lambda every: F.transform(
            bounds,
            lambda b: F.struct(joined(b, every).alias("text"), b["tokens"].alias("tokens")),
        ),
    )
