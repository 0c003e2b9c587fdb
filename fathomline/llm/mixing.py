"""Mixing documents to target domain weights with soft membership.

A naive Bayes classifier learned from a labelled table gives every document a posterior
over the domains. A document of ``n`` tokens with posterior ``p`` and rate ``r`` is expected
to give ``r n p[k]`` tokens to domain ``k``. Nonnegative rates that bring these totals to
the targets are fitted by projected-gradient least squares: each step is one aggregation
over the documents that returns one number per domain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.rows import BROADCAST_KEYS, fresh, same_row, text_key
from fathomline.llm.samples import bounded
from fathomline.storage import fits_in_memory, materialise

PER_DOMAIN = 3000
#: most frequent tokens that the classifier knows; bounds its table of weights
VOCABULARY = 20_000
LEAST_DOCS = 3
SMOOTHING = 0.5
#: tokens whose log share differs by less in every domain tell nothing and are not kept
LEAST_EVIDENCE = 0.2
#: known tokens after which more evidence counts for less, so long texts stay soft
EVIDENCE = 200.0
STEPS = 100
STEPS_PER_TABLE = 12
TOLERANCE = 1e-7
_SPACES = r"[\x20\x09-\x0D]+"


def quality_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, label)``: ``prose`` or ``junk`` by the ``quality`` label, ``toxic`` before both.

    Ids whose label rows disagree, and null labels, are left out.
    """
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select(
        "doc_id",
        F.when(F.coalesce("toxic", F.lit(0)) > 0, "toxic")
        .when(F.col("quality") > 0, "prose")
        .otherwise("junk")
        .alias("label"),
    )
    agreed = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    return agreed.where("label = _other").select("doc_id", "label")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACES), "")


def _weights(docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int) -> DataFrame:
    """``(token, w0, w1, ...)``: log of each domain's share of the token over the overall share."""
    sample = F.broadcast(bounded(labelled.where(F.col("label").isin(domains)), per_domain))  # bounded
    seen = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(sample, "doc_id")
        .select("doc_id", "label", F.explode(_tokens(F.col("text"))).alias("token"))
        .groupBy("token")
        .agg(
            F.countDistinct("doc_id").alias("docs"),
            *[F.sum((F.col("label") == name).cast("long")).alias(f"c{k}") for k, name in enumerate(domains)],
        ),
        "token-counts",
    )
    known = seen.where(F.col("docs") >= LEAST_DOCS).orderBy(F.desc("docs"), "token").limit(VOCABULARY)
    known = materialise(known, "vocabulary")
    places = range(len(domains))
    sums = known.agg(F.count("*").alias("n"), *[F.sum(f"c{k}").alias(f"c{k}") for k in places]).first()
    size = SMOOTHING * (sums["n"] or 0)
    total = sum((sums[f"c{k}"] or 0) for k in places)

    def share(count: Column, whole: float) -> Column:
        return F.log((count + SMOOTHING) / F.lit(float(whole + size or 1)))

    overall = share(sum((F.col(f"c{k}") for k in places), F.lit(0)), total)
    ratios = known.select(
        "token", *[(share(F.col(f"c{k}"), sums[f"c{k}"] or 0) - overall).alias(f"w{k}") for k in places]
    )
    return ratios.where(" or ".join(f"abs(w{k}) >= {LEAST_EVIDENCE}" for k in places))


def posteriors(
    docs: DataFrame, labelled: DataFrame, domains: list[str], per_domain: int = PER_DOMAIN
) -> DataFrame:
    """``(_id, _key, n, p0, p1, ...)`` for every distinct id and text: tokens and posterior.

    Domains without a labelled document get probability 0, and if none has any, all get the
    same. A text without known tokens has the priors, which are the domains' shares of the
    labelled documents.
    """
    places = range(len(domains))
    # the empty token stands for the row itself, so every row meets one token at least
    row_token = docs.sparkSession.createDataFrame([("", *[0.0 for _ in places])]).toDF(
        "token", *[f"w{k}" for k in places]
    )
    weights = materialise(_weights(docs, labelled, domains, per_domain).union(row_token), "weights")
    counts = {r["label"]: r["n"] for r in labelled.where(F.col("label").isin(domains)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    priors = [counts.get(name, 0) / total if total else 1 / len(domains) for name in domains]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"),
        text_key(F.col("text")).alias("_key"),
        F.array_append(_tokens(F.col("text")), "").alias("tokens"),
    ).select("_id", "_key", (F.size("tokens") - 1).cast("long").alias("n"), F.explode("tokens").alias("token"))
    # the vocabulary is bounded by VOCABULARY rows
    summed = (
        rows.join(F.broadcast(weights), "token")
        .groupBy("_id", "_key")
        .agg(
            F.sum(F.when(F.col("token") == "", F.col("n")).otherwise(0)).alias("n"),
            F.count_if(F.col("token") != "").alias("known"),
            *[F.sum(f"w{k}").alias(f"s{k}") for k in places],
        )
    )
    tempered = F.lit(EVIDENCE) / (F.lit(EVIDENCE) + F.col("known"))
    scores = [
        F.lit(float("-inf")) if not prior else F.log(F.lit(prior)) + F.col(f"s{k}") * tempered
        for k, prior in enumerate(priors)
    ]
    scored = summed.select("_id", "_key", "n", *[s.alias(f"s{k}") for k, s in enumerate(scores)])
    top = F.greatest(*[F.col(f"s{k}") for k in places]) if len(domains) > 1 else F.col("s0")
    raised = scored.select("_id", "_key", "n", *[F.exp(F.col(f"s{k}") - top).alias(f"e{k}") for k in places])
    whole = sum((F.col(f"e{k}") for k in places), F.lit(0.0))
    return raised.select("_id", "_key", "n", *[(F.col(f"e{k}") / whole).alias(f"p{k}") for k in places])


def _project(rate: Column, step: list[float]) -> Column:
    """A gradient step of the rate, cut off at 0."""
    return F.greatest(F.lit(0.0), rate - sum((F.col(f"p{k}") * s for k, s in enumerate(step)), F.lit(0.0)))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """``members`` with a column ``rate``: expected tokens by domain match ``targets``.

    ``targets`` are shares of all tokens of ``members``; rates start at 1. The least-squares
    gradient of a rate, measured in the document's share of tokens, is its posterior times
    the domains' excess. Step sizes take turns between the two two-point rules, so they adapt
    to the problem's curvature; the driver sees one row of sums per step. Targets that no
    rates can reach are approached as least squares does, within the number of steps.
    """
    places = range(len(targets))
    total = float(members.agg(F.sum("n").alias("n")).first()["n"] or 0)
    state = members.withColumn("rate", F.lit(1.0))
    if not total:
        return state
    share = F.col("n") / total
    products = [(j, k) for j in places for k in places]
    curve = members.agg(*[F.sum(share * F.col(f"p{j}") * F.col(f"p{k}")) for j, k in products]).first()
    rate, pending, before, size = F.col("rate"), 0, None, 1.0
    for number in range(steps):
        moved = F.lit(0.0) if before is None else share * F.pow(rate - before[1], 2)
        sums = state.agg(
            *[F.sum(share * F.col(f"p{k}") * rate).alias(f"t{k}") for k in places], F.sum(moved).alias("moved")
        ).first()
        excess = [sums[f"t{k}"] - targets[k] for k in places]
        if before is not None:
            if sums["moved"] < TOLERANCE**2:
                break
            turn = [a - b for a, b in zip(excess, before[0])]
            length = sum(t * t for t in turn)
            bent = sum(turn[j] * turn[k] * c for (j, k), c in zip(products, curve))
            if length and bent > 0:
                size = sums["moved"] / length if number % 2 else length / bent
            size = min(max(size, 0.1), 1e4)
        if max(map(abs, excess)) < TOLERANCE:
            break
        before = (excess, rate)
        rate = _project(rate, [size * e for e in excess])
        pending += 1
        if pending == STEPS_PER_TABLE:  # the nested steps become two columns again
            state = materialise(
                state.select(*members.columns, before[1].alias("_before"), rate.alias("rate")), "rates"
            )
            before, rate, pending = (excess, F.col("_before")), F.col("rate"), 0
    return state.select(*members.columns, rate.alias("rate"))


def mix(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], per_domain: int = PER_DOMAIN
) -> DataFrame:
    """``(_id, _key, n, domain, p0, ..., rate)`` for every distinct id and text of ``docs``.

    ``labelled`` is ``(doc_id, label)``; ``targets`` gives weights of labels, which are
    scaled to sum 1; ``domain`` is the likeliest one, the first in order of names on a tie.
    Null and empty texts have no tokens and the rate of the prior. Repeated rows of one id
    and text count as many times as they occur in the totals and share a rate. An empty
    table gives an empty result. Other columns are ignored.
    """
    whole = sum(targets.values())
    if not targets or whole <= 0 or min(targets.values()) < 0:
        raise ValueError("targets must be nonnegative weights with a positive sum")
    domains = sorted(targets)
    members = materialise(posteriors(docs, labelled, domains, per_domain), "members")
    fitted = fit_rates(members, [targets[d] / whole for d in domains])
    best = reduce(
        lambda rest, k: F.when(
            F.col(f"p{k}") >= F.greatest(*[F.col(f"p{j}") for j in range(len(domains))], F.lit(0.0)), domains[k]
        ).otherwise(rest),
        reversed(range(len(domains))),
        F.lit(None).cast("string"),
    )
    # rates are rounded, so the order of sums does not show
    return materialise(fitted.select("*", best.alias("domain")).withColumn("rate", F.round("rate", 6)), "mixed")


def copies(rate: Column, *salt: Column) -> Column:
    """Whole copies of a row: the rate rounded up or down by a hash, right on average."""
    place = F.pmod(F.xxhash64(F.lit("copies"), *salt), F.lit(1 << 30)) / (1 << 30)
    return (F.floor(rate) + (place < rate - F.floor(rate)).cast("long")).cast("long")


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **options) -> DataFrame:
    """``docs`` with ``domain``, ``rate`` and ``copies``; rows with no copy are left out."""
    found = mix(docs, labelled, targets, **options)
    size = F.lit(96)
    small = F.broadcast(found) if fits_in_memory(found, size, BROADCAST_KEYS) else found
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    names = [fresh(docs, c) for c in ("domain", "rate", "copies")]
    joined = keyed.join(small, same_row(keyed, small, key))
    return joined.select(
        *[keyed[c] for c in docs.columns],
        small["domain"].alias(names[0]),
        small["rate"].alias(names[1]),
        copies(small["rate"], keyed["doc_id"], keyed[key]).alias(names[2]),
    ).where(F.col(names[2]) > 0)
