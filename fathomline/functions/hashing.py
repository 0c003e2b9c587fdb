"""Row-local feature-hashing vectors and similarities.

Lists of few terms are hashed in the JVM. For whole texts the terms go to Arrow, where each
different term of a batch is hashed once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.text import bind, terms

DIMENSION = 64


def buckets(term_array: Column, dim: int = DIMENSION) -> Column:
    """Bucket of each term: the first 32 bits of its MD5, modulo ``dim``."""
    return F.transform(
        term_array,
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dim).cast("int"),
    )


def bucket_counts(term_array: Column, dim: int = DIMENSION) -> Column:
    """Dense counts per bucket.

    Each bucket number is added once, so the sorted list has one run per bucket
    and run lengths minus one are the counts. Sorting dominates the cost.
    """

    def run_ends(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda i: (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

    every = F.sequence(F.lit(0), F.lit(dim - 1))
    return bind(
        F.sort_array(F.concat(buckets(term_array, dim), every)),
        lambda ordered: bind(
            run_ends(ordered),
            lambda ends: F.transform(
                ends,
                lambda end, at: end - F.when(at == 0, 0).otherwise(F.get(ends, at - 1)) - 1,
            ),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def unit_counts(terms: pa.ListArray, dim: int = DIMENSION) -> pa.ListArray:
    """Per row the counts of its terms by bucket (see ``buckets``), scaled to unit length;
    zeros without terms, null for a null row."""
    known = terms.is_valid().to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    digests = b"".join(hashlib.md5(name, usedforsecurity=False).digest()[:4] for name in names)
    bucket = np.frombuffer(digests, ">u4").astype(np.int64) % dim
    row = np.repeat(np.arange(len(terms)), terms.value_lengths().fill_null(0).to_numpy())
    places = row * dim + bucket[coded.indices.to_numpy()]
    counts = np.bincount(places, minlength=len(terms) * dim).reshape(-1, dim)
    units = counts / np.maximum(np.sqrt((counts**2).sum(axis=1)), 1.0)[:, None]
    bounds = np.append(0, np.cumsum(known * dim))
    offsets = pa.array(bounds, pa.int32(), mask=np.append(~known, False))
    return pa.ListArray.from_arrays(offsets, pa.array(units[known].ravel()))


def hash_embedding(text: Column, dim: int = DIMENSION) -> Column:
    """Unit vector of term counts per hash bucket; zeros when there is no term."""

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for found in batches:
            yield unit_counts(found, dim)

    return embed(terms(text))


def neighbour_similarities(vectors: Column) -> Column:
    """Cosine of each vector with the one before it, to 6 digits; 0 if either is
    zero, and for the first."""

    def with_lengths(vector: Column) -> Column:
        return F.struct(vector.alias("v"), F.sqrt(dot(vector, vector)).alias("length"))

    def compare(every: Column) -> Column:
        def cosine(here: Column, at: Column) -> Column:
            return bind(
                F.get(every, at - 1),
                lambda before: F.when(
                    (here["length"] > 0) & (before["length"] > 0),
                    F.round(dot(here["v"], before["v"]) / (here["length"] * before["length"]), 6),
                ).otherwise(F.lit(0.0)),
            )

        return F.transform(
            every, lambda here, at: F.when(at > 0, cosine(here, at)).otherwise(F.lit(0.0))
        )

    return bind(F.transform(vectors, with_lengths), compare)
