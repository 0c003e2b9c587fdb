"""Registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import (
    decontaminate,
    langid,
    licences,
    merkle,
    minhash,
    mixing,
    pages,
    quality,
    ranked,
    sanitise,
    tokens,
    toxicity,
    vectors,
)
from fathomline.llm.samples import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_copies(_table(spark, sf_dir, "documents"), percent=85)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


OP1_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    END AS shingles
  FROM worded
), items AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN least_ids ON doc_id = a
"""


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.personal_spans(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        number = sanitise.KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(kind) for kind in sanitise.KINDS[:4]],
        F.sha2(sanitise.told(F.col("base")), 256).alias("base_sha256"),
        sanitise.told(F.col("spans")).alias("spans"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


TARGETS = {"prose": 0.8, "junk": 0.15, "toxic": 0.05}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(_table(spark, sf_dir, "labels"))
    found = mixing.mix(_table(spark, sf_dir, "documents"), labelled, TARGETS)
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("n").alias("n_tokens"),
        "domain",
        *[F.round(f"p{k}", 6).alias(f"p_{name}") for k, name in enumerate(sorted(TARGETS))],
        "rate",
        mixing.copies(F.col("rate"), F.col("_id"), F.col("_key")).alias("copies"),
    )


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2("item_ids", 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold(5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        "n_offending",
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.select("vec_id", "n_links", "component_id", kept.alias("kept"))


TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counted.select("*", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row in five is tampered with before its root is folded again."""
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(touched, merkle.leaf(text=F.translate("text", UPPER, LOWER)))
    found = merkle.proofs(_table(spark, sf_dir, "documents"), {"tampered": tampered})
    shown = found.withColumn(
        "folded_root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    )
    return shown.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def _canonical_sql(text: str) -> str:
    text = f"regexp_replace(lower({text}), '{licences.COPYRIGHT_LINE}', '', 'g')"
    for given, one in licences.SPELLINGS:
        text = f"replace({text}, '{given}', '{one}')"
    return rf"trim(regexp_replace({text}, '[\x00-\x2F\x3A-\x60\x7B-\x7F\x{{A9}}]+', ' ', 'g'))"


def _op5_sql() -> str:
    texts = ", ".join(
        f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(licences.KNOWN)
    )
    return rf"""
WITH known AS (
  SELECT form, arg_min(licence, place) AS licence FROM (
    SELECT place, licence, {_canonical_sql("t")} AS form FROM (VALUES {texts}) AS k(place, licence, t))
  GROUP BY form
), docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT doc_id, true AS whole, t AS unit FROM docs
  UNION ALL
  SELECT doc_id, false, unnest(string_split(t, chr(10))) FROM docs
  UNION ALL
  SELECT doc_id, false, unnest(list_filter(
    string_split_regex(t, '
[ 	
]*
'), lambda p: contains(p, chr(10)))) FROM docs
), hits AS (
  SELECT doc_id, whole, licence
  FROM (SELECT doc_id, whole, {_canonical_sql("unit")} AS form FROM units) JOIN known USING (form)
  WHERE form <> ''
), told AS (
  SELECT doc_id, max(licence) FILTER (WHERE whole) AS licence, count(*) FILTER (WHERE NOT whole) AS n_hits,
    string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
  FROM hits GROUP BY doc_id
)
SELECT doc_id, licence, coalesce(n_hits, 0)::BIGINT AS n_hits, coalesce(licences, '') AS licences
FROM docs LEFT JOIN told USING (doc_id)
"""


OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, size, phrase FROM (
    SELECT item_id, least(len(w), 10) AS size,
      unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
        lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS phrase
    FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, start, array_to_string(w[start:start + size - 1], ' ') AS phrase FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS start FROM doc_words, sizes)
), hits AS (
  SELECT doc_id, item_id, start, size FROM runs JOIN windows USING (size, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (
    SELECT doc_id, unnest(range(start, start + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP9_SQL = r"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ids AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least_ids ON vec_id = least_ids.a LEFT JOIN counts ON vec_id = counts.a
"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    told = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen({f}) || ':' || {f} END" for f in fields]
    return f"sha256({' || '.join(told)})"


_RUN_STEP = """list_aggregate(nodes[:i % 16], 'string_agg', '') AS before,
    list_aggregate(nodes[i % 16 + 2:], 'string_agg', '') AS after"""

OP12_SQL = f"""
WITH RECURSIVE coded AS (
  SELECT *,
    xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1),
      lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
    lambda s, b: list_reduce([xor(s, b)] || range(8),
      lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 5 = 0 AS touched
  FROM documents
), hashed AS (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
    CASE WHEN touched THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf_sql("text")} END AS shown
  FROM coded
), leaves AS (
  SELECT *, row_number() OVER (ORDER BY 1) AS rid,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY source) AS n FROM hashed
), levels AS (
  SELECT 0 AS lvl, source, i, n, leaf AS node FROM leaves
  UNION ALL
  SELECT lvl + 1, source, i // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY i))
  FROM levels WHERE n > 1 GROUP BY lvl, source, i // 16, n
), runs AS (
  SELECT lvl, source, i // 16 AS run, list(node ORDER BY i) AS nodes FROM levels WHERE n > 1 GROUP BY ALL
), subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n
  FROM levels WHERE n = 1
), tops AS (
  SELECT 0 AS lvl, i, n, node FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY i))
  FROM tops WHERE n > 1 GROUP BY lvl, i // 16, n
), top_runs AS (
  SELECT lvl, i // 16 AS run, list(node ORDER BY i) AS nodes FROM tops WHERE n > 1 GROUP BY ALL
), folds AS (
  SELECT rid, 0 AS lvl, source, i, n, shown AS cur, '' AS told FROM leaves
  UNION ALL
  SELECT rid, lvl + 1, source, i // 16, (n + 15) // 16, sha256(coalesce(before, '') || cur || coalesce(after, '')),
    told || coalesce(before, '') || coalesce(after, '')
  FROM (SELECT f.*, {_RUN_STEP} FROM folds f JOIN runs r
    ON f.lvl = r.lvl AND f.source IS NOT DISTINCT FROM r.source AND f.i // 16 = r.run WHERE f.n > 1)
), ways AS (
  SELECT rid, 0 AS lvl, s.i, s.n, cur, told, s.node AS subroot
  FROM folds f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
  UNION ALL
  SELECT rid, lvl + 1, i // 16, (n + 15) // 16, sha256(coalesce(before, '') || cur || coalesce(after, '')),
    told || coalesce(before, '') || coalesce(after, ''), subroot
  FROM (SELECT w.*, {_RUN_STEP} FROM ways w JOIN top_runs r ON w.lvl = r.lvl AND w.i // 16 = r.run WHERE w.n > 1)
)
SELECT doc_id, leaf, subroot, t.node AS root, sha256(told) AS proof_sha256, cur AS folded_root, cur = t.node AS verified
FROM leaves JOIN ways USING (rid) JOIN (SELECT node FROM tops WHERE n = 1) t ON true
WHERE ways.n = 1
"""


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), corpus AS (
  SELECT count(*)::BIGINT AS size, sum(len(w))::BIGINT AS length FROM docs WHERE len(w) > 0
), held AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT rid, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * size + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM held, corpus GROUP BY term, size
), scores AS (
  SELECT item_id, rid, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * size) // length))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN items USING (term), corpus GROUP BY item_id, rid, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank
  FROM scores WHERE score > 0)
WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_copies": op1_near_copies,
        "op2_personal_data": op2_personal_data,
        "op3_quality": op3_quality,
        "op4_mixing": op4_mixing,
        "op5_licences": op5_licences,
        "op6_leaks": op6_leaks,
        "op7_toxicity": op7_toxicity,
        "op8_language": op8_language,
        "op9_near_vectors": op9_near_vectors,
        "op10_main_text": op10_main_text,
        "op11_token_counts": op11_token_counts,
        "op12_manifest": op12_manifest,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_copies": OP1_SQL,
        "op5_licences": _op5_sql(),
        "op6_leaks": OP6_SQL,
        "op9_near_vectors": OP9_SQL,
        "op12_manifest": OP12_SQL,
        "op13_ranked_search": OP13_SQL,
    }
