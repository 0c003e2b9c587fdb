"""The registered queries once more, as SQL for DuckDB.

Every query is a chain of named parts; ``_query`` joins the parts it needs.
"""

from __future__ import annotations

from string import Formatter

from fathomline.functions.prompts import CLARIFICATION, TEMPLATES

SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)


def clean(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '\.{{2,}}', '.', 'g'), '{SPACE}', ' ', 'g')"


def cut(text: str, ends: str) -> str:
    marked = rf"regexp_replace({text}, '([{ends}]+) ', '\1' || chr(30), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(30)), "
        "lambda part: trim(part)), lambda part: part <> '')"
    )


def sentences(text: str) -> str:
    return cut(text, ".!?")


def tokens(text: str) -> str:
    return f"len(string_split({text}, ' '))"


def terms(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def term_set(text: str) -> str:
    return f"list_distinct({terms(text)})"


def shared(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def containment_of(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 THEN 0.0 ELSE {shared(a, b)} / len({a}) END)"


def packed(name: str, source: str, limit: int, overlap: int) -> dict[str, str]:
    """Greedy chunks over ``source(doc_id, items, sizes)`` as ``name``."""
    budget = f"greatest(p[stop + 1] - {overlap}, coalesce(p[stop + 2], 0) - {limit})"
    after = f"greatest(start + 1, least(stop, len(list_filter(p, lambda x: x < {budget}))))"
    stop = (
        f"least(n, greatest({{s}} + 1, "
        f"len(list_filter(p, lambda x: x - p[{{s}} + 1] <= {limit})) - 1))"
    )
    first = stop.format(s="0")
    later = stop.format(s="fresh")
    return {
        f"{name}_p": f"""SELECT doc_id, items, len(sizes) AS n,
            list_prepend(0, list_transform(range(1, len(sizes) + 1),
                lambda i: list_sum(sizes[1:i])::BIGINT)) AS p
            FROM {source} WHERE len(sizes) > 0""",
        f"{name}_r": f"""SELECT doc_id, n, p, 0 AS pos, 0::BIGINT AS start, {first} AS stop
            FROM {name}_p
            UNION ALL
            SELECT doc_id, n, p, pos + 1, fresh, {later}
            FROM (SELECT *, {after} AS fresh FROM {name}_r WHERE stop < n)""",
        name: f"""SELECT r.doc_id, 0 AS page_no, r.pos::INTEGER AS chunk_pos,
            array_to_string(s.items[r.start + 1 : r.stop], ' ') AS text,
            (r.p[r.stop + 1] - r.p[r.start + 1])::INTEGER AS chunk_token_count, '' AS source
            FROM {name}_r r JOIN {name}_p s USING (doc_id)""",
    }


def sized(source: str) -> str:
    return f"""SELECT doc_id, items, list_transform(items, lambda s: {tokens("s")}) AS sizes
        FROM {source}"""


def weighted(name: str, counts: str, key: str) -> dict[str, str]:
    return {
        f"{name}_x": f"""SELECT c.{key}, c.term, c.tf * i.idf AS x
            FROM {counts} c JOIN idf i USING (term)""",
        name: f"""SELECT {key}, term, x / sqrt(sum(x * x) OVER (PARTITION BY {key})) AS weight
            FROM {name}_x""",
    }


def scored(name: str, asked: str) -> dict[str, str]:
    return {
        f"{name}_counts": f"""SELECT index, term, count(*) AS tf FROM
            (SELECT index, unnest({terms("question")}) AS term FROM {asked}) GROUP BY ALL""",
        **weighted(f"{name}_weights", f"{name}_counts", "index"),
        name: f"""SELECT q.index, w.chunk_index, round(sum(q.weight * w.weight), 6) AS score
            FROM {name}_weights q JOIN weights w USING (term) GROUP BY ALL""",
    }


def ranked(scores: str, k: int, order: str = "score DESC, chunk_index") -> str:
    return f"""SELECT *, (row_number() OVER (PARTITION BY index ORDER BY {order}))::INTEGER AS rank
        FROM {scores} QUALIFY rank <= {k}"""


def padded(scores: str, asked: str) -> str:
    """All chunks for all questions: the plain form of padding with zeros."""
    return f"""SELECT q.index, c.chunk_index, coalesce(s.score, 0.0) AS score
        FROM {asked} q CROSS JOIN chunks c
        LEFT JOIN {scores} s ON s.index = q.index AND s.chunk_index = c.chunk_index"""


def best_sentence(question: str, context: str) -> str:
    """Of the sentences with most shared terms, the first."""
    options = f"""list_transform({sentences(clean(context))},
        lambda s, i: struct_pack(shared := {shared(term_set("s"), term_set(question))},
            before := -i, sentence := s))"""
    return f"coalesce(list_max({options}).sentence, '')"


def share(items: str, test: str) -> str:
    return f"""(CASE WHEN len({items}) = 0 THEN 0.0
        ELSE len(list_filter({items}, lambda s: {test})) / len({items}) END)"""


def rating(part: str, whole: str) -> str:
    a, b = term_set(part), term_set(whole)
    return f"(floor({containment_of(a, b)} * 4 + 0.5) + 1)::INTEGER"


def rating_json(score: str, why: str = "shared terms") -> str:
    return f"""('{{"Evaluation":"{why}","Score":"' || {score} || '"}}')"""


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rendered(template: str, values: dict[str, str]) -> str:
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(text(literal))
        if name is not None:
            parts.append(f"coalesce(CAST({values[name]} AS VARCHAR), '')")
    return " || ".join(parts)


def pair_part(group: int) -> str:
    pattern = r"(?s)Factoid question:\s*(.*?)\s*Answer:\s*(.*?)\s*\z"
    return (
        f"CASE WHEN regexp_matches(output, '{pattern}') "
        f"THEN trim(regexp_extract(output, '{pattern}', {group})) END"
    )


PARTS: dict[str, str] = {
    "qa": f"""SELECT item_id AS index, coalesce({clean("text")}, '') AS question,
        text AS answer, text AS context FROM benchmark""",
    "cleaned": f"SELECT doc_id, {clean('text')} AS text FROM documents",
    "split": f"SELECT doc_id, {sentences('text')} AS items FROM cleaned",
    "sized": sized("split"),
    **packed("standard", "sized", 500, 50),
    **packed("overlapping", "sized", 100, 20),
    "atoms": f"""SELECT doc_id, flatten(list_transform(items, lambda s:
            CASE WHEN {tokens("s")} <= 100 THEN [s]
            ELSE flatten(list_transform({cut("s", ",;:")}, lambda c:
                CASE WHEN {tokens("c")} <= 100 THEN [c] ELSE string_split(c, ' ') END)) END)) AS items
        FROM split""",
    "atoms_sized": sized("atoms"),
    **packed("recursive", "atoms_sized", 100, 0),
    "sentence_rows": """SELECT doc_id, i, items[i] AS sentence, sizes[i] AS n
        FROM (SELECT *, unnest(range(1, len(items) + 1)) AS i FROM sized)""",
    "sentence_buckets": f"""SELECT doc_id, i, bucket, count(*) AS c FROM (
            SELECT doc_id, i,
                CAST('0x' || substr(md5(unnest({terms("sentence")})), 1, 8) AS BIGINT) % 64 AS bucket
            FROM sentence_rows) GROUP BY ALL""",
    "sentence_norms": """SELECT doc_id, i, sqrt(sum(c * c)) AS norm
        FROM sentence_buckets GROUP BY ALL""",
    "sentence_dots": """SELECT b.doc_id, b.i, sum(a.c * b.c) AS dot
        FROM sentence_buckets a JOIN sentence_buckets b
        ON a.doc_id = b.doc_id AND a.i = b.i - 1 AND a.bucket = b.bucket GROUP BY ALL""",
    "sentence_sims": """SELECT r.doc_id, r.i,
            coalesce(round(d.dot / (y.norm * x.norm), 6), 0.0) AS similarity
        FROM sentence_rows r
        LEFT JOIN sentence_dots d ON d.doc_id = r.doc_id AND d.i = r.i
        LEFT JOIN sentence_norms x ON x.doc_id = r.doc_id AND x.i = r.i - 1
        LEFT JOIN sentence_norms y ON y.doc_id = r.doc_id AND y.i = r.i""",
    "topic_breaks": """SELECT doc_id, list(i - 1 ORDER BY i) FILTER (similarity < 0.2) AS breaks
        FROM sentence_sims GROUP BY doc_id""",
    "semantic_p": """SELECT s.doc_id, s.items, len(s.sizes) AS n,
            list_prepend(0, list_transform(range(1, len(s.sizes) + 1),
                lambda i: list_sum(s.sizes[1:i])::BIGINT)) AS p, b.breaks
        FROM sized s JOIN topic_breaks b USING (doc_id) WHERE len(s.sizes) > 0""",
}
_semantic_stop = (
    "least(n, greatest({s} + 1, len(list_filter(p, lambda x: x - p[{s} + 1] <= 100)) - 1), "
    "coalesce(list_min(list_filter(breaks, lambda x: x >= {s} + 2)), n))"
)
PARTS |= {
    "semantic_r": f"""SELECT doc_id, 0 AS pos, 0::BIGINT AS start, n, p, breaks,
            {_semantic_stop.format(s="0")} AS stop FROM semantic_p
        UNION ALL
        SELECT doc_id, pos + 1, stop, n, p, breaks, {_semantic_stop.format(s="stop")}
        FROM semantic_r WHERE stop < n""",
    "semantic": """SELECT r.doc_id, 0 AS page_no, r.pos::INTEGER AS chunk_pos,
            array_to_string(s.items[r.start + 1 : r.stop], ' ') AS text,
            (r.p[r.stop + 1] - r.p[r.start + 1])::INTEGER AS chunk_token_count, '' AS source
        FROM semantic_r r JOIN semantic_p s USING (doc_id)""",
    "chunks": """SELECT row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS chunk_index, *
        FROM standard""",
    "tf": f"""SELECT chunk_index, term, count(*) AS tf FROM
        (SELECT chunk_index, unnest({terms("text")}) AS term FROM chunks) GROUP BY ALL""",
    "idf": """SELECT term, count(*) AS df,
            ln(((SELECT count(*) FROM chunks) + 1) / (count(*) + 1)) + 1 AS idf
        FROM tf GROUP BY term""",
    **weighted("weights", "tf", "chunk_index"),
    **scored("scores", "qa"),
    "hits": ranked("scores", 5),
    "all_scores": padded("scores", "qa"),
    "padded_hits": ranked("all_scores", 5),
    "found": """SELECT h.index, h.rank, h.chunk_index, h.score, c.text
        FROM padded_hits h JOIN chunks c USING (chunk_index)""",
    "contexts": """SELECT q.*, coalesce(f.texts, []) AS retrieval_context,
            array_to_string(coalesce(f.texts, []), ' ') AS built_context
        FROM qa q LEFT JOIN
            (SELECT index, list(text ORDER BY rank) AS texts FROM found GROUP BY index) f
        USING (index)""",
    "longest": f"""SELECT * REPLACE (coalesce(list_min(list_transform({term_set("context")},
            lambda t: struct_pack(shorter := -length(t), t := t))).t, '') AS question) FROM qa""",
    **scored("rare_scores", "longest"),
    "rare_all": padded("rare_scores", "longest"),
    "rare_hits": ranked("rare_all", 5),
    "turn_questions": """SELECT conv_id * 1000 + turn AS index, text AS question
        FROM conversations WHERE role = 'user'""",
    **scored("turn_scores", "turn_questions"),
    "turn_all": padded("turn_scores", "turn_questions"),
    "turn_hits": ranked("turn_all", 5),
    "answers": f"""SELECT *, {best_sentence("question", "built_context")} AS actual_output
        FROM contexts""",
    "documents_hashed": f"""SELECT doc_id, bucket, count(*) AS c FROM (
            SELECT doc_id,
                CAST('0x' || substr(md5(unnest({terms("text")})), 1, 8) AS BIGINT) % 64 AS bucket
            FROM documents) GROUP BY ALL""",
    "chunk_hashed": f"""SELECT chunk_index, bucket, count(*) AS c FROM (
            SELECT chunk_index,
                CAST('0x' || substr(md5(unnest({terms("text")})), 1, 8) AS BIGINT) % 64 AS bucket
            FROM chunks) GROUP BY ALL""",
    "chunk_units": """SELECT c.chunk_index, b.bucket,
            (coalesce(h.c, 0) / greatest(sqrt(sum(coalesce(h.c * h.c, 0))
                OVER (PARTITION BY c.chunk_index)), 1))::FLOAT::DOUBLE AS v
        FROM chunks c CROSS JOIN (SELECT unnest(range(64)) AS bucket) b
        LEFT JOIN chunk_hashed h ON h.chunk_index = c.chunk_index AND h.bucket = b.bucket""",
    "chunk_vectors": """SELECT chunk_index, list(v ORDER BY bucket) AS v
        FROM chunk_units GROUP BY ALL""",
    "question_hashed": f"""SELECT index, bucket, count(*) AS c FROM (
            SELECT index,
                CAST('0x' || substr(md5(unnest({terms("question")})), 1, 8) AS BIGINT) % 64 AS bucket
            FROM qa) GROUP BY ALL""",
    "question_units": """SELECT q.index, b.bucket,
            (coalesce(h.c, 0) / greatest(sqrt(sum(coalesce(h.c * h.c, 0))
                OVER (PARTITION BY q.index)), 1))::FLOAT::DOUBLE AS v
        FROM qa q CROSS JOIN (SELECT unnest(range(64)) AS bucket) b
        LEFT JOIN question_hashed h ON h.index = q.index AND h.bucket = b.bucket""",
    "question_vectors": """SELECT index, list(v ORDER BY bucket) AS v
        FROM question_units GROUP BY ALL""",
    "distances": """SELECT q.index, c.chunk_index, round(list_distance(q.v, c.v), 6) AS distance
        FROM question_vectors q CROSS JOIN chunk_vectors c""",
    "near3": ranked("distances", 3, "distance, chunk_index"),
    "near4": ranked("distances", 4, "distance, chunk_index"),
    "dense_found": """SELECT q.*, f.texts AS retrieval_context,
            array_to_string(f.texts, ' ') AS built_context
        FROM qa q JOIN (SELECT h.index, list(c.text ORDER BY h.rank) AS texts
            FROM near3 h JOIN chunks c USING (chunk_index) GROUP BY h.index) f USING (index)""",
    "dense_answers": f"""SELECT *, {best_sentence("question", "built_context")} AS actual_output
        FROM dense_found""",
    "counted_chunks": """SELECT chunk_index, text, [length(text)::DOUBLE,
            length(regexp_replace(text, '[^aeiou]', '', 'g'))::DOUBLE] AS v FROM chunks""",
    "counted_questions": """SELECT index, 'Ask: ' || question AS question, [length(question)::DOUBLE,
            length(regexp_replace(question, '[^aeiou]', '', 'g'))::DOUBLE] AS v FROM qa""",
    "counted_distances": """SELECT q.index, c.chunk_index, round(list_distance(q.v, c.v), 6) AS distance
        FROM counted_questions q CROSS JOIN counted_chunks c WHERE length(q.question) % 4 <> 0""",
    "counted_near": ranked("counted_distances", 2, "distance, chunk_index"),
    "counted_found": """SELECT q.index, q.question, f.texts, coalesce(array_to_string(f.texts, ' '), '') AS built
        FROM counted_questions q LEFT JOIN (SELECT h.index, list(c.text ORDER BY h.rank) AS texts
            FROM counted_near h JOIN chunks c USING (chunk_index) GROUP BY h.index) f USING (index)""",
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    "vector_distances": """SELECT a.vec_id AS index, b.vec_id,
            round(list_distance(a.v, b.v), 6) AS distance
        FROM vectors a CROSS JOIN vectors b""",
    "scaled": "SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 1000 + vec_id % 3) AS v FROM embeddings",
    "scaled_distances": """SELECT a.vec_id AS index, b.vec_id,
            round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6)
                AS distance
        FROM scaled a CROSS JOIN scaled b""",
    "turn_pairs": """SELECT conv_id, turn, text AS question, next_text AS answer FROM (
            SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
            FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'""",
    "drafted_turns": """SELECT conv_id, turn, 'Factoid question: ' || role || '?' ||
            CASE WHEN role = 'system' THEN ' Reply: ' ELSE chr(10) || 'Answer: ' END || text ||
            CASE WHEN turn % 2 = 0 THEN ' ' || chr(10) || chr(10) ELSE '' END AS output
        FROM conversations""",
    "parsed_turns": f"""SELECT conv_id, turn, {pair_part(1)} AS question, {pair_part(2)} AS answer
        FROM drafted_turns""",
    "judge_bodies": """SELECT d.doc_id, d.source, d.doc_id % 5 AS kind,
            CAST(coalesce(l.quality * 3 + l.toxic + 1, 9) AS VARCHAR) AS score,
            '{"Evaluation": "{' || d.source || '} is fine", "Score": "' ||
            coalesce(l.quality * 3 + l.toxic + 1, 9) || '"}' AS body
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "judge_replies": """SELECT doc_id, CASE kind
            WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```'
            WHEN 1 THEN body
            WHEN 2 THEN 'Here you are:' || chr(10) || body || chr(10) || 'That is all.'
            WHEN 3 THEN '{"Score": ' || score || '}'
            ELSE '{"Evaluation": "' || source || '}' END AS output
        FROM judge_bodies""",
    "judge_found": r"""SELECT doc_id, output, regexp_extract(output, '(?s)\{.*\}') AS found
        FROM judge_replies""",
    "judge_parsed": """SELECT doc_id,
            CASE WHEN json_valid(found) THEN json_extract_string(found, '$.Evaluation') END AS evaluation,
            CASE WHEN json_valid(found) THEN json_extract_string(found, '$.Score') END AS score,
            CASE WHEN NOT json_valid(found) THEN 'Invalid JSON from model' END AS error,
            CASE WHEN NOT json_valid(found) THEN output END AS raw_output
        FROM judge_found""",
    "drafts": f"""SELECT chunk_index AS index, text AS context, list_max(list_transform(
            {sentences("text")}, lambda s, i: struct_pack(fits := length(s) <= 300, n := {tokens("s")}, before := -i, s := s))).s
            AS longest FROM chunks""",
    "drafted": f"""SELECT index, context, longest, 'Factoid question: What does the text say about ' ||
            coalesce(list_min(list_transform({term_set("longest")},
                lambda t: struct_pack(shorter := -length(t), t := t))).t, '') ||
            '?' || chr(10) || 'Answer: ' || longest AS output FROM drafts""",
    "drafted_pairs": f"""SELECT index, context, {pair_part(1)} AS question, {pair_part(2)} AS answer
        FROM drafted""",
    "valid_pairs": """SELECT * FROM drafted_pairs WHERE question <> '' AND answer <> ''
        AND length(question) <= 300 AND length(answer) <= 300""",
}


def case_metrics(source: str) -> str:
    """The four metrics over ``source(index, question, answer, actual_output, ...)``."""
    out = "out_statements"
    wanted = "want_statements"
    known = "known"
    return f"""SELECT index,
        round({share(out, f"list_has_any({terms('s')}, asked)")}, 6) AS answer_relevancy,
        round({share(out, f"{containment_of(term_set('s'), known)} >= 0.5")}, 6) AS faithfulness,
        round({share(wanted, f'''len(list_filter(context_terms, lambda c:
            {containment_of(term_set('s'), 'c')} >= 0.5)) > 0''')}, 6) AS contextual_recall,
        round(CASE WHEN len(list_filter(verdicts, lambda v: v)) = 0 THEN 0.0 ELSE
            list_sum(list_transform(verdicts, lambda v, r: CASE WHEN v
                THEN len(list_filter(verdicts[1:r], lambda w: w)) / r ELSE 0.0 END))
            / len(list_filter(verdicts, lambda v: v)) END, 6) AS contextual_precision
        FROM (SELECT *, list_transform(context_terms, lambda c:
                {containment_of('want_terms', 'c')} >= 0.5) AS verdicts
            FROM (SELECT index, {sentences(clean("actual_output"))} AS out_statements,
                {sentences(clean("answer"))} AS want_statements,
                {term_set("question")} AS asked, {term_set("built_context")} AS known,
                {term_set("answer")} AS want_terms,
                list_transform(retrieval_context, lambda c: {term_set("c")}) AS context_terms
                FROM {source}))"""


def long_scores(cases: str) -> str:
    return f"""SELECT index, metric, score FROM (SELECT index, unnest([
            struct_pack(metric := 'Answer Relevancy', score := answer_relevancy),
            struct_pack(metric := 'Faithfulness', score := faithfulness),
            struct_pack(metric := 'Contextual Recall', score := contextual_recall),
            struct_pack(metric := 'Contextual Precision', score := contextual_precision)],
            recursive := true) FROM {cases})"""


def overall(means: str, weights: dict[str, float]) -> str:
    rows = ", ".join(f"({text(m)}, {w}::DOUBLE)" for m, w in weights.items())
    weighted_mean = f"""(SELECT sum(m.value * w.weight) / sum(w.weight) FROM {means} m
        JOIN (VALUES {rows}) w(metric, weight) USING (metric))"""
    return f"""SELECT metric, round(value, 6) AS value FROM {means}
        UNION ALL SELECT 'Average Performance', round((SELECT avg(value) FROM {means}), 6)
        UNION ALL SELECT 'Weighted Average Performance', round({weighted_mean}, 6)"""


PARTS |= {
    "cases": case_metrics("answers"),
    "long": long_scores("cases"),
    "means": "SELECT metric, avg(score) AS value FROM long GROUP BY metric",
    "dense_cases": case_metrics("dense_answers"),
    "dense_long": long_scores("dense_cases"),
    "dense_means": "SELECT metric, avg(score) AS value FROM dense_long GROUP BY metric",
}

PARTS |= {
    "judged": """SELECT index, metric, count(*) FILTER (length(statement) % 11 = 0) AS n_failed,
            list(CASE WHEN metric = 'Answer Relevancy' THEN contains(evidence, split_part(statement, ' ', 2))
                ELSE contains(evidence, statement) END ORDER BY position) AS verdicts
        FROM judged_rows GROUP BY ALL""",
    "written": f"""SELECT chunk_index AS index, text AS context, 'Q: ' || source || '?' AS history,
            length({rendered(TEMPLATES["qa_generation_with_history"], {"context": "text", "history": "('Q: ' || source || '?')"})}) AS n
        FROM chunks""",
    "written_pairs": """SELECT index, context, n, CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN history END AS question,
            CASE WHEN n % 7 <> 0 AND n % 5 <> 0 THEN n::VARCHAR END AS answer FROM written""",
    "written_rated": f"""SELECT *, CASE
            WHEN n % 7 = 0 THEN 'draft: RuntimeError: busy'
            WHEN n % 5 = 0 THEN 'no pair in the output'
            WHEN length({rendered(TEMPLATES["groundedness"], {"question": "question", "context": "context"})}) % 2 = 1
                THEN 'groundedness: score or reasons are invalid'
            WHEN length({rendered(TEMPLATES["question_relevance"], {"question": "question"})}) % 2 = 1
                THEN 'question_relevance: score or reasons are invalid'
            WHEN length({rendered(TEMPLATES["faithfulness"], {"question": "question", "context": "context", "answer": "answer"})}) % 2 = 1
                THEN 'faithfulness: score or reasons are invalid'
            WHEN length({rendered(TEMPLATES["location_dependency"], {"question": "question", "context": "context", "answer": "answer"})}) % 2 = 1
                THEN 'location: score or reasons are invalid' END AS reason
        FROM written_pairs""",
    "judged_rows": f"""SELECT index, metric, s[i] AS statement, CASE WHEN len(e) = len(s) AND
            metric = 'Contextual Precision' THEN e[i] ELSE e[1] END AS evidence, i AS position
        FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT index, unnest([
            struct_pack(metric := 'Answer Relevancy', s := {sentences(clean("actual_output"))},
                e := [question]),
            struct_pack(metric := 'Faithfulness', s := {sentences(clean("actual_output"))},
                e := [built_context]),
            struct_pack(metric := 'Contextual Recall', s := {sentences(clean("answer"))},
                e := [built_context]),
            struct_pack(metric := 'Contextual Precision',
                s := list_transform(retrieval_context, lambda c: answer), e := retrieval_context)],
            recursive := true) FROM answers))""",
    "judged_long": """SELECT a.index, m.metric, round(CASE WHEN j.index IS NULL THEN 0.0 WHEN n_failed > 0 THEN NULL
            WHEN m.metric <> 'Contextual Precision' THEN len(list_filter(verdicts, lambda v: v)) / len(verdicts)
            WHEN len(list_filter(verdicts, lambda v: v)) = 0 THEN 0.0
            ELSE list_sum(list_transform(verdicts, lambda v, r: CASE WHEN v
                THEN len(list_filter(verdicts[1:r], lambda w: w)) / r ELSE 0.0 END))
                / len(list_filter(verdicts, lambda v: v)) END, 6) AS score, coalesce(n_failed, 0) AS n_failed
        FROM answers a CROSS JOIN (SELECT unnest(['Answer Relevancy', 'Faithfulness', 'Contextual Recall',
            'Contextual Precision']) AS metric) m
        LEFT JOIN judged j ON j.index = a.index AND j.metric = m.metric""",
    "judged_means": "SELECT metric, avg(score) AS value FROM judged_long GROUP BY metric",
}
DEFAULT = {
    "Answer Relevancy": 0.20,
    "Faithfulness": 0.30,
    "Contextual Recall": 0.25,
    "Contextual Precision": 0.25,
}
CUSTOM = {
    "Answer Relevancy": 1.0,
    "Faithfulness": 2.5,
    "Contextual Recall": 0.0,
    "Contextual Precision": 0.75,
}


def _query(final: str) -> str:
    """Put the parts a query mentions, directly or not, in front of it."""
    needed: list[str] = []

    def visit(sql: str, inside: str = "") -> None:
        words = set(_words(sql))
        for name in PARTS:
            if name in words and name != inside and name not in needed:
                visit(PARTS[name], name)
                needed.append(name)

    visit(final)
    if not needed:
        return final
    parts = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in needed)
    return f"WITH RECURSIVE {parts}\n{final}"


def _words(sql: str) -> list[str]:
    import re

    return re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", sql)


CHUNK_COLUMNS = "doc_id, page_no, chunk_pos, text, chunk_token_count, source"


def oracle_sql() -> dict[str, str]:
    values = {
        "context": "context",
        "question": "question",
        "answer": "answer",
        "text": "context",
        "input": "question",
        "history": "answer",
        "statement": "question",
        "evidence": "context",
    }
    catalogue = " UNION ALL ".join(
        f"SELECT index, {text(name)} AS template, {rendered(template, values)} AS prompt FROM qa"
        for name, template in TEMPLATES.items()
    )
    valid_rate = lambda a, b: rating(a, b)
    groundedness_prompt = rendered(
        TEMPLATES["groundedness"], {"question": "question", "context": "answer"}
    )
    plain = {
        "json_roundtrip": "SELECT index, context, question, answer FROM qa",
        "read_qa_head": """SELECT index, context, question, answer FROM qa
            ORDER BY index LIMIT 20""",
        "delimited_roundtrip": """SELECT c.doc_id, CASE c.doc_id % 7 WHEN 1 THEN ' ' || c.text || ' '
            WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '"' || c.text WHEN 5 THEN c.text || chr(9) || '""'
            ELSE c.text END AS text, d.source AS origin
            FROM cleaned c JOIN documents d USING (doc_id)""",
        "rename_columns": "SELECT doc_id, quality AS is_good, toxic AS is_toxic FROM labels",
        "load_vectors": """SELECT vec_id, (i - 1)::INTEGER AS axis,
            round(embedding[i]::DOUBLE, 6) AS value
            FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)""",
        "load_pages": """SELECT doc_id, (i - 1)::INTEGER AS page_no, parts[i] AS text, source
            FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i
                FROM (SELECT *, string_split(text, chr(10)) AS parts FROM documents))""",
        "page_text": "SELECT doc_id, 0 AS page_no, text FROM documents",
        "clean_text": f"SELECT doc_id, {clean('''replace(text, '.', '...')''')} AS text FROM documents",
        "validate_records": """SELECT conv_id, turn, CASE WHEN role <> 'system' THEN 'valid'
            ELSE 'text is missing' END AS reason FROM conversations""",
        "split_sentences": """SELECT doc_id, 0 AS page_no, (i - 1)::INTEGER AS pos, sentence,
            n::INTEGER AS tokens FROM sentence_rows""",
        "sentence_chunks": f"SELECT {CHUNK_COLUMNS} FROM standard",
        "chunk_overlap": f"SELECT {CHUNK_COLUMNS} FROM overlapping",
        "recursive_chunks": f"SELECT {CHUNK_COLUMNS} FROM recursive",
        "semantic_chunks": f"SELECT {CHUNK_COLUMNS} FROM semantic",
        "chunk_index": "SELECT chunk_index, doc_id, page_no, chunk_pos, chunk_token_count FROM chunks",
        "stream_chunk_index": """SELECT row_number() OVER (ORDER BY doc_id % 3, doc_id, page_no, chunk_pos) - 1 AS chunk_index,
            doc_id, page_no, chunk_pos, chunk_token_count FROM chunks""",
        "chunk_stats": """SELECT 'pages' AS measure, count(*) AS n FROM documents
            UNION ALL SELECT 'chunks', count(*) FROM chunks""",
        "term_freq": "SELECT chunk_index, term, tf FROM tf",
        "idf": "SELECT term, df, round(idf, 6) AS idf FROM idf",
        "tfidf_weights": "SELECT chunk_index, term, round(weight, 6) AS weight FROM weights",
        "tfidf_scores": "SELECT index, chunk_index, score FROM scores",
        "tfidf_topk": "SELECT index, chunk_index, score, rank FROM hits",
        "tfidf_topk_padded": "SELECT index, rank, chunk_index, score FROM rare_hits",
        "tfidf_many_questions": "SELECT index, rank, chunk_index, score FROM turn_hits",
        "index_reopened": "SELECT index, rank, chunk_index, score, text FROM found",
        "tfidf_retrieval": "SELECT index, rank, chunk_index, score, text FROM found",
        "build_context": "SELECT index, built_context FROM contexts",
        "retrieval_context": "SELECT index, rank - 1 AS position, text FROM found",
        "hash_embed": """SELECT doc_id, bucket::INTEGER AS bucket,
            round((c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS value
            FROM documents_hashed""",
        "knn_exact": ranked("vector_distances", 10, "distance, vec_id"),
        "knn_blocks": ranked("vector_distances", 10, "distance, vec_id"),
        "knn_scaled": f"""SELECT form, index, rank, vec_id, distance
            FROM ({ranked("scaled_distances", 10, "distance, vec_id")})
            CROSS JOIN (SELECT unnest(['small', 'blocks of 100', 'blocks of 333']) AS form)""",
        "knn_approx": ranked("vector_distances", 10, "distance, vec_id"),
        "knn_cells": ranked("vector_distances", 10, "distance, vec_id"),
        "vector_index_reopened": ranked("vector_distances", 10, "distance, vec_id"),
        "dense_topk": "SELECT index, rank, chunk_index, distance FROM near4",
        "dense_index_reopened": "SELECT index, rank, chunk_index, distance FROM near4",
        "prompt_catalogue": catalogue,
        "render_prompt": """SELECT conv_id, turn, '{' || conv_id || '}: ' || question ||
            ' {context}' AS prompt FROM turn_pairs""",
        "extractive_answer": "SELECT index, actual_output AS answer FROM answers",
        "generate_with_errors": """SELECT index,
            CASE WHEN contains(context, 'tion') THEN '' ELSE length(context) || ' characters' END AS output,
            CASE WHEN contains(context, 'tion') THEN 'ValueError: cannot read this' END AS error,
            CASE WHEN contains(context, 'tion') THEN '' ELSE context END AS retrieved FROM qa""",
        "answer_questions": """SELECT index, actual_output,
            array_to_string(retrieval_context, chr(10)) AS retrieved, CAST(NULL AS VARCHAR) AS error FROM answers""",
        "answer_with_failures": f"""SELECT index, CASE WHEN texts IS NULL THEN '' ELSE
            {best_sentence("question", "built")} END AS actual_output,
            coalesce(array_to_string(texts, chr(10)), '') AS retrieved,
            CASE WHEN texts IS NULL THEN 'ValueError: no vector' END AS error FROM counted_found""",
        "qa_from_turns": "SELECT conv_id, turn, question, answer FROM turn_pairs",
        "qa_history": """SELECT conv_id, turn, coalesce(string_agg(
            'Q: ' || question || chr(10) || 'A: ' || answer, chr(10)) OVER
            (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS history
            FROM turn_pairs""",
        "parse_qa": "SELECT conv_id, turn, question, answer FROM parsed_turns",
        "qa_constraints": """SELECT conv_id, turn, CASE
            WHEN question IS NULL OR answer IS NULL THEN 'no pair in the output'
            WHEN question = '' OR answer = '' THEN 'empty question or answer'
            WHEN length(question) > 300 THEN 'question too long'
            WHEN length(answer) > 300 THEN 'answer too long' ELSE 'valid' END AS reason
            FROM parsed_turns""",
        "parse_judge_json": "SELECT doc_id, evaluation, score, error, raw_output FROM judge_parsed",
        "validate_score": """SELECT doc_id, CASE WHEN evaluation IS NOT NULL AND
            regexp_matches(score, '^[1-5]$') THEN score::INTEGER END AS score FROM judge_parsed""",
        "critique_scores": f"""SELECT conv_id, turn,
            {valid_rate("question", "answer || ' ' || question")} AS groundedness_score,
            {valid_rate("question", "answer || ' ' || question || ' ' || answer")}
                AS question_relevance_score,
            {valid_rate("answer", "answer || ' ' || question")} AS faithfulness_score,
            {valid_rate("question", "answer")} AS answer_relevancy_score,
            'shared terms' AS answer_relevancy_eval, CAST(NULL AS VARCHAR) AS faithfulness_error
            FROM turn_pairs""",
        "critique_model": f"""SELECT conv_id, turn,
            CASE WHEN n % 4 <> 0 THEN (n % 4 + 2)::INTEGER END AS groundedness_score,
            CASE WHEN n % 4 <> 0 THEN 'length ' || n END AS groundedness_eval,
            CASE WHEN n % 4 = 0 THEN 'Invalid JSON from model' END AS groundedness_error
            FROM (SELECT conv_id, turn, length({groundedness_prompt}) AS n FROM turn_pairs)""",
        "location_dependency": f"""SELECT doc_id, quality AS location_score,
            CASE WHEN quality = 1 THEN 'where in ' || source || '?' ELSE '' END AS refined_question,
            CASE WHEN quality = 1 THEN lang ELSE '' END AS refined_answer,
            CASE WHEN quality = 1 THEN {text(CLARIFICATION)} ELSE source END
                AS location_dependency_evaluator_target_answer,
            CAST(NULL AS VARCHAR) AS location_error
            FROM documents JOIN labels USING (doc_id)""",
        "sample_chunks": """SELECT chunk_index, text FROM chunks
            ORDER BY md5(chunk_index || '0'), chunk_index LIMIT 5""",
        "qa_prompts": f"""SELECT chunk_index, {rendered(TEMPLATES["short_qa"], {"text": "text"})}
            AS prompt FROM chunks""",
        "assemble_qa": f"""SELECT index, question, answer, context,
            CASE WHEN {rating("question", "context")} <= 2 THEN {text(CLARIFICATION)} ELSE answer END
                AS location_dependency_evaluator_target_answer,
            {rating("question", "context")} AS groundedness_score, 'shared terms' AS groundedness_eval,
            {rating("question", "context || ' ' || answer")} AS question_relevancy_score,
            'shared terms' AS question_relevancy_eval,
            {rating("answer", "context")} AS faithfulness_score, 'shared terms' AS faithfulness_eval
            FROM valid_pairs""",
        "assemble_qa_history": """SELECT index, question, answer, 1::INTEGER AS groundedness_score
            FROM written_rated WHERE reason IS NULL""",
        "assemble_qa_rejected": "SELECT index, question, answer, reason FROM written_rated WHERE reason IS NOT NULL",
        "zip_align": """SELECT q.index, q.question, e.label
            FROM qa q JOIN embeddings e ON e.vec_id = q.index""",
        "goldens": """SELECT index, question AS input, answer AS expected_output, context FROM qa""",
        "attach_predictions": """SELECT d.doc_id AS index, d.source,
            coalesce(l.quality::VARCHAR, '') AS actual_output,
            coalesce(l.toxic::VARCHAR, '') AS retrieved
            FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "test_cases": """SELECT index, question AS input, answer AS expected_output, actual_output,
            context, array_to_string(retrieval_context, chr(10)) AS retrieved FROM answers""",
        "answer_relevancy": "SELECT index, answer_relevancy AS score FROM cases",
        "faithfulness": "SELECT index, faithfulness AS score FROM cases",
        "contextual_recall": "SELECT index, contextual_recall AS score FROM cases",
        "contextual_precision": "SELECT index, contextual_precision AS score FROM cases",
        "evaluate_long": """SELECT index, metric, score, threshold, score >= threshold AS success
            FROM (SELECT *, CASE WHEN metric = 'Answer Relevancy' THEN 0.5 ELSE 0.7 END::DOUBLE
                AS threshold FROM long)""",
        "metric_means": "SELECT metric, round(value, 6) AS value FROM means",
        "overall_metrics": overall("means", DEFAULT),
        "overall_custom_weights": overall("means", CUSTOM),
        "overall_dense": overall("dense_means", DEFAULT),
        "summary": """SELECT index, question AS query, actual_output, answer AS expected_output,
            context AS actual_context, array_to_string(retrieval_context, chr(10)) AS retrieved,
            answer_relevancy, faithfulness, contextual_recall, contextual_precision
            FROM answers JOIN cases USING (index)""",
        "ledger_restart": """SELECT conv_id, turn, CASE WHEN text IN (SELECT text FROM conversations WHERE turn < 2)
            THEN 'first ' ELSE 'second ' END || length(text) AS output, NULL::VARCHAR AS error FROM conversations""",
        "evaluate_judged": """SELECT index, metric, score,
            score >= CASE WHEN metric = 'Answer Relevancy' THEN 0.5 ELSE 0.7 END AS success FROM judged_long""",
        "overall_judged": f"""SELECT o.metric, o.value, f.n_failed, f.error FROM ({overall("judged_means", DEFAULT)}) o
            LEFT JOIN (SELECT metric, count(*) AS n_failed, 'ValueError: too long' AS error
                FROM judged_long WHERE n_failed > 0 GROUP BY metric) f USING (metric)""",
        "judge_verdicts": f"""SELECT conv_id, turn, round(CASE WHEN len(statements) = 0 THEN 0.0
                WHEN n_failed > 0 THEN NULL ELSE len(list_filter(statements,
                lambda s: contains(evidence, s))) / len(statements) END, 6) AS score,
            len(statements)::BIGINT AS n_statements, n_failed,
            CASE WHEN n_failed > 0 THEN 'ValueError: too long' END AS error
            FROM (SELECT *, len(list_filter(statements, lambda s: length(s) % 11 = 0))::BIGINT AS n_failed
                FROM (SELECT conv_id, turn, {sentences(clean("answer || ' ' || question"))} AS statements,
                {clean("answer")} AS evidence FROM turn_pairs))""",
    }
    return {name: _query(sql) for name, sql in plain.items()}
