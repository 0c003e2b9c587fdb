"""Personal data: base patterns, and terms that give protected values away.

E-mail addresses, IP addresses, card and phone numbers are the protected entities. The
corpus tells how strongly a term near an entity reveals it: with ``c(t)`` occurrences of a
term, ``c(e)`` mentions of an entity, ``c(t, e)`` mentions of the entity with the term in
their context and ``n`` terms in all, the pointwise mutual information
``log(c(t, e) n / (c(t) c(e)))`` is divided by the entity's information ``log(n / c(e))``.
A value of 1 means that who reads the term knows the entity. Terms above the threshold are
spans as well, in the contexts of that entity, and are generalised like the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.rows import BROADCAST_KEYS, fresh, same_row, text_key
from fathomline.storage import fits_in_memory, materialise

#: kinds in the order that breaks ties between spans with one start
KINDS = ("email", "ip", "card", "phone", "term")
THRESHOLD = 0.9
#: a term must stand near this many mentions of an entity
SUPPORT = 3
#: code points on either side of an entity that are its context
CONTEXT = 160
#: matches whose lengths are summed together
BLOCK = 128

_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
# runs are possessive and begin where a run begins (or the last match ended), so no text
# makes the search quadratic; the matches are those of the plain patterns
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
LONG_CARD = r"[0-9](?:[\x20-]?[0-9]){13}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: whole words of at least four letters; what follows the word may be punctuation
TERM = r"(?<=\s)\p{L}{4,}+(?=[.,;:!?]*+\s)"

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, not at every mention."""
    return F.transform(F.array(value), use)[0]


def _numbers(count: Column, step: int = 1) -> Column:
    """``0, step, 2 * step, ...`` below ``count``."""
    numbers = F.sequence(F.lit(0), count - 1, F.lit(step))
    return F.when(count > 0, numbers).otherwise(F.array().cast("array<int>"))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda total, n: total + n)


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of all matches, in code points.

    A match begins behind all gaps and matches before it. Their lengths are summed for blocks
    of ``BLOCK`` matches first and then inside a match's block, so that the work does not
    grow with the square of the matches.
    """

    def within(m: Column) -> Column:
        """Matches from their values and the lengths of gaps and values."""
        count, sums = F.size(m["values"]), F.zip_with(m["gaps"], m["lengths"], lambda g, n: g + n)

        def starts(both: Column) -> Column:
            totals = F.transform(_numbers(count, BLOCK), lambda at: _sum(F.slice(both, at + 1, F.lit(BLOCK))))

            def place(before: Column) -> Column:
                return F.transform(
                    _numbers(count),
                    lambda i: F.get(before, F.floor(i / BLOCK).cast("int"))
                    + _sum(F.slice(both, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
                    + F.get(m["gaps"], i),
                )

            running = F.aggregate(
                totals,
                F.array(F.lit(0)),
                lambda done, n: F.array_append(done, F.element_at(done, F.lit(-1)) + n),
            )
            return _bound(running, place)

        return _bound(
            _bound(sums, starts),
            lambda first: F.transform(
                _numbers(count),
                lambda i: F.struct(
                    F.get(first, i).alias("start"),
                    (F.get(first, i) + F.get(m["lengths"], i)).alias("end"),
                    F.get(m["values"], i).alias("value"),
                ),
            ),
        )

    def measured(values: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
        return F.struct(
            values.alias("values"),
            F.transform(gaps, lambda g: F.length(g)).alias("gaps"),
            F.transform(values, lambda v: F.length(v)).alias("lengths"),
        )

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _bound(_bound(values, measured), within)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octets(value: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), fits)


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = digit * 2
        folded = F.when(doubled > 9, doubled - 9).otherwise(doubled)
        return total + F.when(i % 2 == 1, folded).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four base kinds that pass their checks, by start and then kind."""
    none = F.array().cast(_SPAN)

    def kind(name: str, pattern: str, may: Column, passes) -> Column:
        spans = F.transform(
            F.filter(located(text, pattern), lambda m: passes(m["value"])),
            lambda m: F.struct(m["start"], F.lit(KINDS.index(name)).alias("kind"), m["end"], m["value"]),
        ).cast(_SPAN)
        return F.when(may, spans).otherwise(none)

    def card(value: Column) -> Column:
        digits = _digits(value)
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))

    return F.array_sort(
        F.concat(
            kind("email", EMAIL, text.contains("@"), lambda v: F.lit(True)),
            kind("ip", IP, text.rlike(IP), _octets),
            kind("card", CARD, text.rlike(LONG_CARD), card),
            kind("phone", PHONE, text.contains("+"), lambda v: F.length(_digits(v)).between(10, 15)),
        )
    )


def _entity(span: Column) -> Column:
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), span["kind"] + 1)
    email = span["kind"] == KINDS.index("email")
    bare = F.when(email, F.lower(span["value"])).otherwise(F.regexp_replace(span["value"], "[^0-9.]", ""))
    return F.concat_ws(":", name, bare)


def _context(text: Column, span: Column) -> Column:
    """Terms around a span with their places. A space stands in for either end of the text."""
    low = F.greatest(span["start"] - CONTEXT, F.lit(0))
    ahead = F.substring(text, low + 1, span["start"] - low)
    behind = F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    open_start = F.when(low == 0, F.concat(F.lit(" "), ahead)).otherwise(ahead)
    open_end = F.when(F.length(behind) < CONTEXT, F.concat(behind, F.lit(" "))).otherwise(behind)

    def moved(found: Column, by: Column) -> Column:
        return F.transform(
            found,
            lambda m: F.struct(
                (m["start"] + by).alias("start"), (m["end"] + by).alias("end"), F.lower(m["value"]).alias("term")
            ),
        )

    return F.concat(
        moved(located(open_start, TERM), low - F.when(low == 0, 1).otherwise(0)),
        moved(located(open_end, TERM), span["end"]),
    )


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def _read(docs: DataFrame) -> DataFrame:
    """Rows with id, key, base spans, number of terms and mentions with their contexts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text")).alias("_key"), text.alias("text")
    )
    spanned = rows.withColumn("base", base_spans(F.col("text")))
    mentions = F.when(
        F.size("base") > 0,
        F.transform(
            "base",
            lambda s: F.struct(_entity(s).alias("entity"), _context(F.col("text"), s).alias("terms")),
        ),
    )
    found = spanned.select(
        "_id", "_key", "base", F.regexp_count(_padded(F.col("text")), F.lit(TERM)).alias("n_terms"), mentions.alias("mentions")
    )
    return materialise(found, "personal")


def _revealing(docs: DataFrame, read: DataFrame, threshold: float, support: int) -> DataFrame:
    """``(entity, term, disclosure)`` of terms at or above the threshold."""
    mentions = read.where("mentions is not null").select(F.explode("mentions").alias("m"))
    entities = mentions.groupBy("m.entity").agg(F.count("*").alias("c_e")).where(F.col("c_e") >= support)
    near = mentions.select(
        "m.entity", F.explode(F.array_distinct(F.transform("m.terms", lambda t: t["term"]))).alias("term")
    )
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("c_te")).where(F.col("c_te") >= support)
    pairs = materialise(pairs.join(entities, "entity"), "near-terms")
    wanted = materialise(pairs.select("term").distinct(), "terms")
    bytes_each = F.length("term") * 4 + 32
    small = F.broadcast(wanted) if fits_in_memory(wanted, bytes_each, BROADCAST_KEYS) else wanted
    counts = (
        docs.select(F.explode(F.regexp_extract_all(_padded(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
        .select(F.lower("term").alias("term"))
        .join(small, "term")
        .groupBy("term")
        .agg(F.count("*").alias("c_t"))
    )
    counts = materialise(counts, "term-counts")
    n = F.lit(float(read.agg(F.sum("n_terms").alias("n")).first()["n"] or 0))
    informed = pairs.join(counts, "term")
    shared = F.log(F.col("c_te") * n / (F.col("c_t") * F.col("c_e")))
    disclosure = shared / F.log(n / F.col("c_e"))
    found = informed.where(n > F.col("c_e")).select("entity", "term", disclosure.alias("disclosure"))
    return materialise(found.where(F.col("disclosure") >= threshold), "revealing")


def _revealed(read: DataFrame, revealing: DataFrame) -> DataFrame:
    """``(_id, _key, terms)``: spans of revealing terms in the contexts of their entities."""
    placed = (
        read.where("mentions is not null")
        .select("_id", "_key", F.explode("mentions").alias("m"))
        .select("_id", "_key", "m.entity", F.explode("m.terms").alias("t"))
        .select("_id", "_key", "entity", "t.term", "t.start", "t.end")
    )
    row_bytes = F.length("entity") * 4 + F.length("term") * 4 + 64
    small = F.broadcast(revealing) if fits_in_memory(revealing, row_bytes, BROADCAST_KEYS) else revealing
    kind = F.lit(KINDS.index("term")).alias("kind")
    spans = placed.join(small, ["entity", "term"]).select(
        "_id", "_key", F.struct("start", kind, "end", F.col("term").alias("value")).alias("span")
    )
    return materialise(spans.groupBy("_id", "_key").agg(F.collect_set("span").cast(_SPAN).alias("terms")), "revealed")


def personal_spans(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``(doc_id, key, base, spans)`` for every row: base spans, and all spans by start and kind.

    Spans are ``(start, kind, end, value)`` in code points, ends exclusive, ``kind`` a place
    in ``KINDS``. Spans of different kinds may overlap; those of one kind do not. Terms are
    counted over all documents; a term is only a span within ``CONTEXT`` code points of a
    mention of the entity it reveals, so texts without personal data have no spans.

    Null and empty texts have no spans. Rows that repeat id and text get equal results, rows
    without an id get theirs too. An empty table gives an empty result. Other columns are
    ignored.
    """
    read = _read(docs)
    revealed = _revealed(read, _revealing(docs, read, threshold, support))
    size = F.size("terms") * 64 + 64
    small = F.broadcast(revealed) if fits_in_memory(revealed, size, BROADCAST_KEYS) else revealed
    joined = read.join(small, read["_id"].eqNullSafe(small["_id"]) & (read["_key"] == small["_key"]), "left")
    return joined.select(
        read["_id"].alias("doc_id"),
        read["_key"].alias("key"),
        "base",
        F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(_SPAN)))).alias("spans"),
    )


def told(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def _merged(spans: Column) -> Column:
    """Spans in order with overlapping ones as one, which keeps the first one's kind."""

    def step(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")
        )
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        overlaps = F.coalesce(s["start"] < last["end"], F.lit(False))
        return F.when(
            overlaps, F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), joined)
        ).otherwise(F.array_append(done, new))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int,kind:int>>"), step)


def generalised(text: Column, merged: Column) -> Column:
    """``text`` with every span replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def piece(s: Column, i: Column) -> Column:
        low = F.when(i == 0, F.lit(0)).otherwise(F.get(merged, i - 1)["end"])
        return F.concat(F.substring(text, low + 1, s["start"] - low), F.element_at(names, s["kind"] + 1))

    rest = F.substring(text, F.element_at(merged, -1)["end"] + 1, F.length(text))
    return F.concat(F.array_join(F.transform(merged, piece), ""), rest)


def sanitise(docs: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``docs`` with all spans of ``personal_spans`` generalised in ``text``; other columns stay."""
    found = personal_spans(docs, threshold, support).where(F.size("spans") > 0)
    spans = F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    found = found.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"), _merged(spans).alias("_spans")
    ).dropDuplicates(["_id", "_key"])
    found = materialise(found, "spans")
    small = F.broadcast(found) if fits_in_memory(found, F.size("_spans") * 32 + 64, BROADCAST_KEYS) else found
    key = fresh(docs, "_key")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    joined = keyed.join(small, same_row(keyed, small, key), "left")
    text = F.when(small["_spans"].isNull(), keyed["text"]).otherwise(generalised(keyed["text"], small["_spans"]))
    return joined.select(*[text.alias(c) if c == "text" else keyed[c] for c in docs.columns])
