"""Independent SQL for the catalogue's queries, in a dialect with lists and lambdas. $NAME$ stands for a shared part."""

from __future__ import annotations

from memoriq.functions.text import ACRONYM_NOISE, CANDIDATE_STOP, QUERY_STOP

_AS_OF = "1767225600000000"
_FROM, _TO = "TIMESTAMPTZ '2024-06-01 00:00:00+00'", "TIMESTAMPTZ '2025-06-30 23:59:59+00'"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_PARTS = {
    "M": """m AS (SELECT * FROM (SELECT lower(id) id, * EXCLUDE (id), row_number() OVER (PARTITION BY lower(id)) rn
        FROM memories WHERE id IS NOT NULL AND text IS NOT NULL AND created_at IS NOT NULL) WHERE rn = 1)""",
    "LIVE": "live AS (SELECT * FROM m WHERE NOT coalesce(tombstoned, false))",
    "MEN": """men AS (SELECT * FROM (SELECT lower(id) id, lower(memory_id) memory_id, lower(entity_id) entity_id, start_offset, end_offset,
        row_number() OVER (PARTITION BY lower(id)) rn FROM mentions) WHERE rn = 1)""",
    "ENT": "ent AS (SELECT lower(id) id, canonical_name, entity_type, aliases FROM entities)",
    "V": """v AS (SELECT memory_id, e FROM (SELECT lower(memory_id) memory_id, embedding::DOUBLE[] e,
        row_number() OVER (PARTITION BY lower(memory_id) ORDER BY updated_at DESC NULLS LAST, embedding DESC NULLS LAST) rn
        FROM memory_embeddings WHERE profile_safe_id = 'p64_main_7be1d0') WHERE rn = 1 AND len(e) = 64 AND list_sum(list_transform(e, lambda x: abs(x))) > 0)""",
    "QV": "qv AS (SELECT embedding::DOUBLE[] q FROM embeddings WHERE vec_id = 0)",
    "TERMS": """terms AS (SELECT list_distinct(list_filter(regexp_split_to_array('what about the keyboard release in tallowmere', ' '),
        lambda w: length(w) >= 2 AND NOT list_contains($STOP$, w))) t)""",
    "NAMES": """names AS (SELECT unnest(['keyboard', 'release', 'tallowmere', 'keyboard release', 'release tallowmere']) n)""",
    "STOP": _list(QUERY_STOP),
    "CSTOP": _list(CANDIDATE_STOP),
    "NOISE": _list(ACRONYM_NOISE),
    "TAGS": "list_sort(list_distinct(list_filter([lower(trim(source)), lower(trim(language))], lambda x: x IS NOT NULL)))",
    "EFF": "coalesce(occurred_at, created_at)",
    "ACR": """list_filter(regexp_extract_all(regexp_replace(text, '[À-ɏß]', 'x', 'g'), '\\b([A-Z]{2,}[0-9]*(?:[._-][A-Z0-9]+)*)\\b', 1), lambda a: NOT list_contains($NOISE$, a))""",
    "OUT": """o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(id) ORDER BY coalesce(attempt_count, -1) DESC, arrival_no DESC) rn FROM outbox) WHERE rn = 1)""",
    "BRANCH": """
    bv AS (SELECT id, list_cosine_similarity(e, q) semantic, 0.0 lexical, 'vec' branch FROM live JOIN v ON memory_id = id, qv ORDER BY round(semantic, 9) DESC, id LIMIT 30),
    bl AS (SELECT id, 0.0 semantic, lexical, 'lex' branch FROM lex ORDER BY round(lexical, 9) DESC, id LIMIT 30),
    be AS (SELECT id, 0.0 semantic, 0.0 lexical, 'ent' branch FROM live WHERE id IN
      (SELECT memory_id FROM men JOIN ent ON ent.id = men.entity_id WHERE lower(canonical_name) IN (SELECT n FROM names)) ORDER BY id LIMIT 30),
    seeds AS (SELECT id, max(semantic) semantic, max(lexical) lexical, list_sort(list_distinct(list(branch))) branches FROM
      (SELECT * FROM bv UNION ALL SELECT * FROM bl UNION ALL SELECT * FROM be) GROUP BY id)""",
    "W": "list_filter(regexp_split_to_array(lower($X$), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> '')",
    "LEX": """lex AS (SELECT id, lexical FROM (SELECT id,
        len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: list_contains(t, w))) * 1.0
        + len(list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: list_contains(t, w))) * 0.4
        + len(list_filter(regexp_split_to_array(lower(coalesce(conversation_id, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: list_contains(t, w))) * 0.2 lexical
        FROM live, terms) WHERE lexical > 0)""",
    "NEAR": """se AS (SELECT DISTINCT entity_id FROM men WHERE memory_id IN (SELECT id FROM seeds) AND entity_id IS NOT NULL),
    near AS (SELECT memory_id id, count(*) shared FROM men WHERE entity_id IN (SELECT entity_id FROM se)
      AND memory_id NOT IN (SELECT id FROM seeds) GROUP BY memory_id)""",
    "EXP": """cand AS (SELECT id, true is_seed, 0 shared, semantic, lexical, branches FROM seeds
      UNION ALL SELECT id, false, shared, NULL, 0.0, [] FROM near)""",
    "POST": """post AS (SELECT id, lexeme, sum(w) weight FROM (
        SELECT id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+')) lexeme, 1.0::DOUBLE w FROM $SRC$
        UNION ALL SELECT id, unnest(regexp_split_to_array(lower(source), '[^\\p{L}\\p{M}\\p{N}]+')), 0.4::DOUBLE FROM $SRC$
        UNION ALL SELECT id, unnest(regexp_split_to_array(lower(conversation_id), '[^\\p{L}\\p{M}\\p{N}]+')), 0.2::DOUBLE FROM $SRC$) WHERE lexeme <> '' GROUP BY ALL)""",
    "BQ": """bq AS (SELECT doc_id query_id, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{M}\\p{N}]+'),
        lambda w: length(w) >= 2 AND NOT list_contains($STOP$, w))) terms, e.embedding::DOUBLE[] q
        FROM documents JOIN embeddings e ON vec_id = doc_id % 500 WHERE doc_id % 50 = 0 AND title IS NOT NULL)""",
    "BHITS": """
    nv AS (SELECT * FROM (SELECT query_id, memory_id id, list_cosine_similarity(e, q) semantic, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(e, q), 9) DESC, memory_id) r
        FROM bq, v WHERE memory_id IN (SELECT id FROM live)) WHERE r <= $B$),
    nl AS (SELECT * FROM (SELECT query_id, id, sum(weight) lexical, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(weight), 9) DESC, id) r
        FROM post JOIN (SELECT query_id, unnest(terms) lexeme FROM bq) USING (lexeme) GROUP BY query_id, id) WHERE r <= $B$),
    mg AS (SELECT query_id, id, max(semantic) semantic, max(lexical) lexical FROM
        (SELECT query_id, id, semantic, 0.0 lexical FROM nv UNION ALL SELECT query_id, id, 0.0, lexical FROM nl) GROUP BY ALL),
    sc AS (SELECT query_id, id, created_at, semantic, lexical, pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0) recency FROM mg JOIN live USING (id)),
    ranked AS (SELECT * FROM (SELECT *, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at DESC, id) rank
        FROM (SELECT *, 0.55 * greatest(0.0, semantic) + 0.2 * recency + 0.1 * 1.0 + 0.15 * lexical score FROM sc)) WHERE rank <= $K$)""",
    "BFULL": """
    bn AS (SELECT query_id, unnest(list_filter(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]), lambda x, i: list_position(k || list_transform(range(1, len(k)), lambda j: k[j] || ' ' || k[j + 1]), x) = i)[1:12]) n
        FROM (SELECT doc_id query_id, list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: length(w) >= 4 AND NOT list_contains($CSTOP$, w)) k FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL)),
    ne AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) r FROM (SELECT DISTINCT bn.query_id, men.memory_id id
        FROM bn JOIN ent ON lower(ent.canonical_name) = n JOIN men ON men.entity_id = ent.id WHERE men.memory_id IN (SELECT id FROM live) AND bn.query_id IN (SELECT query_id FROM bq))) WHERE r <= $B$),
    fs AS (SELECT query_id, id, max(semantic) semantic, max(lexical) lexical FROM
        (SELECT query_id, id, semantic, 0.0 lexical FROM nv UNION ALL SELECT query_id, id, 0.0, lexical FROM nl UNION ALL SELECT query_id, id, 0.0, 0.0 FROM ne) GROUP BY ALL),
    fe AS (SELECT DISTINCT query_id, entity_id FROM men JOIN fs ON men.memory_id = fs.id WHERE entity_id IS NOT NULL),
    fn AS (SELECT query_id, memory_id id, count(*) shared FROM men JOIN fe USING (entity_id) GROUP BY ALL),
    fc AS (SELECT query_id, id, true is_seed, 0 shared, semantic, lexical FROM fs
        UNION ALL SELECT query_id, id, false, shared, NULL, 0.0 FROM fn ANTI JOIN fs USING (query_id, id)),
    full_hits AS (SELECT query_id, id, created_at, is_seed, greatest(0.0, CASE WHEN is_seed THEN coalesce(semantic, 0.0) WHEN e IS NULL THEN 0.0 ELSE list_cosine_similarity(e, q) END) semantic,
        pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0) recency, CASE WHEN is_seed THEN 1.0::DOUBLE ELSE least(1.0, shared / 3.0) END graph, lexical::DOUBLE lexical
        FROM fc JOIN live USING (id) JOIN bq USING (query_id) LEFT JOIN v ON memory_id = id),
    local_hits AS (SELECT query_id, id, CASE WHEN e IS NULL THEN 0.0 ELSE greatest(0.0, list_cosine_similarity(e, q)) END semantic,
        pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0) recency
        FROM (SELECT * FROM live ORDER BY created_at DESC, id LIMIT 5000) LEFT JOIN v ON memory_id = id, bq)""",
    "GR": """gr AS (SELECT query_id, id, CASE WHEN sum(weight) >= 2 THEN 2 ELSE 1 END grade FROM post JOIN (SELECT query_id, unnest(terms) lexeme FROM bq) USING (lexeme) GROUP BY ALL)""",
    "MET": """
    ideal AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(p + 1)) ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) p FROM gr) WHERE p <= 5 GROUP BY 1),
    per AS (SELECT run, query_id, min(rank) f, sum((pow(2.0, grade) - 1) / log2(rank + 1)) dcg FROM rk JOIN gr USING (query_id, id) WHERE rank <= 5 AND grade >= 1 GROUP BY ALL),
    met AS (SELECT r.run, ideal.query_id, coalesce(1.0 / f, 0.0) rr, CASE WHEN ideal > 0 THEN coalesce(dcg, 0.0) / ideal ELSE 0.0 END ndcg, CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END success
        FROM ideal CROSS JOIN (SELECT DISTINCT run FROM rk) r LEFT JOIN per ON per.run = r.run AND per.query_id = ideal.query_id)""",
    "AS_OF": _AS_OF,
    "FROM": _FROM,
    "TO": _TO,
}


def _sql(text: str, **own: str) -> str:
    parts = _PARTS | own
    for _ in range(6):
        for k, v in parts.items():
            text = text.replace(f"${k}$", v)
    return text


_BATCH = "$M$, $LIVE$, $V$, $BQ$, $POST$, $BHITS$"
_FULL = "$M$, $LIVE$, $V$, $MEN$, $ENT$, $BQ$, $POST$, $BHITS$, $BFULL$"
_PATHS = """rk AS (SELECT run, query_id, id, place AS rank FROM (SELECT run, query_id, id, row_number() OVER (PARTITION BY run, query_id ORDER BY round(score, 9) DESC, id) place FROM (
    SELECT '1_local' run, query_id, id, 0.7::DOUBLE * semantic + 0.3::DOUBLE * recency score FROM local_hits
    UNION ALL SELECT '2_seeds', query_id, id, 0.7::DOUBLE * semantic + 0.3::DOUBLE * recency FROM full_hits WHERE is_seed
    UNION ALL SELECT '3_graph', query_id, id, 0.6::DOUBLE * semantic + 0.2::DOUBLE * recency + 0.2::DOUBLE * graph FROM full_hits
    UNION ALL SELECT '4_lexical', query_id, id, 0.55::DOUBLE * semantic + 0.2::DOUBLE * recency + 0.1::DOUBLE * graph + 0.15::DOUBLE * lexical FROM full_hits)) WHERE place <= 5)"""
_EVAL = "WITH $M$, $LIVE$, $V$, $BQ$, $POST$, $BHITS$, $GR$, rk AS (SELECT 'x' run, query_id, id, rank FROM ranked), $MET$"
_SEEDS = "$M$, $LIVE$, $MEN$, $ENT$, $V$, $QV$, $TERMS$, $NAMES$, $LEX$, $BRANCH$"
_RUNS = """rk AS (SELECT run, query_id, id, place AS rank FROM (SELECT run, query_id, id,
    row_number() OVER (PARTITION BY run, query_id ORDER BY round(a * semantic + b * recency + g * 1.0 + d * lexical, 9) DESC, id) place FROM ranked, runs) WHERE place <= 5)"""


def _batch(text: str, k: str = "25", b: str = "75") -> str:
    return _sql(text, K=k, B=b, SRC="live")


SQL = {
    "scan_memories": _sql("""WITH $M$ SELECT id, length(text) n_chars, epoch_us(created_at) created_us, epoch_us(occurred_at) occurred_us, source, conversation_id,
        language, sentiment, embedding_profile, embedding_dim, tombstoned FROM m"""),
    "point_lookup": _sql("WITH $M$ SELECT id, source FROM m ORDER BY id LIMIT 1"),
    "filter_effective_time": _sql("WITH $M$, $LIVE$ SELECT id FROM live WHERE $EFF$ BETWEEN $FROM$ AND $TO$"),
    "filter_lax_time": _sql("WITH $M$, $LIVE$ SELECT id FROM live WHERE (occurred_at >= $FROM$ OR created_at >= $FROM$) AND (occurred_at <= $TO$ OR created_at <= $TO$)"),
    "filter_tags": _sql("WITH $M$, $LIVE$ SELECT id, array_to_string($TAGS$, ',') tags FROM live WHERE list_has_any($TAGS$, ['git', 'de'])"),
    "filter_source_conv": _sql("WITH $M$, $LIVE$ SELECT id FROM live WHERE source = 'slack' AND conversation_id = 'c00-000001'"),
    "tombstone_antijoin": _sql("WITH $M$ SELECT id FROM m WHERE id NOT IN (SELECT id FROM m WHERE tombstoned)"),
    "malformed_rows": " UNION ALL ".join(
        f"SELECT '{c}' field, count(*) FILTER ({c} IS NULL) n_null FROM outbox" for c in ("id", "record_type", "record_id", "operation", "created_at", "payload")
    ),
    "null_defaults": _sql("WITH $M$ SELECT id, coalesce(source, '') source, coalesce(sentiment, 0.0) sentiment FROM m"),
    "hit_json": _sql("""WITH $M$, $LIVE$ SELECT id, '{"id":"' || id || '"' || coalesce(',"language":"' || language || '"', '') || coalesce(',"source":"' || source || '"', '') || '}' AS json
        FROM live WHERE conversation_id = 'c00-000002'"""),
    "date_window": _sql("WITH $M$ SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM m WHERE strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') BETWEEN '2024-03-01' AND '2024-03-31'"),
    "vector_topk": _sql("WITH $M$, $LIVE$, $V$, $QV$ SELECT id, round(list_cosine_similarity(e, q), 6) semantic FROM live JOIN v ON memory_id = id, qv ORDER BY round(list_cosine_similarity(e, q), 9) DESC, id LIMIT 25"),
    "vector_topk_batch": _sql("""WITH $V$ SELECT query_id, rank, id, semantic FROM (SELECT vec_id query_id, memory_id id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) semantic,
        row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], e), 9) DESC, memory_id) AS rank FROM embeddings, v WHERE vec_id % 50 = 0) WHERE rank <= 5"""),
    "cosine_scores": _sql("""WITH $QV$, c AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) c FROM embeddings, qv)
        SELECT vec_id, round(c, 6) AS cosine, round(greatest(0.0, c), 6) AS clamped, round(1.0 - c, 6) distance FROM c"""),
    "l2_normalise": _sql("WITH $V$ SELECT memory_id, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) length, 1.0::DOUBLE unit FROM v"),
    "blob_roundtrip": "SELECT vec_id, (4 * len(embedding))::INTEGER n_bytes, true same FROM embeddings",
    "pad_truncate": _sql("""WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: w <> ''), lambda w: length(w)) l FROM documents)
        SELECT doc_id, array_to_string((l || [0, 0, 0, 0, 0, 0, 0, 0])[1:8], ',') ids, least(8, len(l))::INTEGER n_real FROM w"""),
    "mean_pool": """WITH t AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (embedding[i]::DOUBLE + embedding[i + 16]::DOUBLE + embedding[i + 32]::DOUBLE) / 3) m FROM embeddings WHERE embedding IS NOT NULL),
        n AS (SELECT vec_id, m, sqrt(list_sum(list_transform(m, lambda x: x * x))) l FROM t)
        SELECT vec_id, round(m[1] / l, 6) x0, round(m[8] / l, 6) x7, round(m[16] / l, 6) x15, 1.0::DOUBLE AS length FROM n""",
    "vector_texts": "SELECT vec_id, '[' || array_to_string(list_transform(embedding[1:4], lambda x: round(x::DOUBLE * 100)::INTEGER), ',') || ']' AS text FROM embeddings",
    "provider_vectors": "SELECT vec_id, 8 n, 1.0::DOUBLE AS length FROM embeddings",
    "corpus_jsonl": _sql("""WITH $M$ SELECT id, length(text) n_chars, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') created_at, array_to_string($TAGS$, ',') tags FROM m
        UNION ALL SELECT doc_id::VARCHAR, length(title), NULL, '2' FROM documents WHERE doc_id % 50 = 0"""),
    "corpus_lines": "SELECT trim(title) AS text, count(*) n FROM documents WHERE trim(title) <> '' GROUP BY ALL",
    "commit_log": """SELECT 'm' || substr(sha1(doc_id::VARCHAR), 1, 8) id, least(600, length('fix: ' || title || chr(10) || 'body')) n_chars, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') created_at,
        'git' AS source, 'bugfix,git,src' tags FROM documents WHERE title IS NOT NULL""",
    "json_responses": _sql("""WITH $M$, $LIVE$ SELECT '{"id":"' || id || '"' || coalesce(',"language":"' || language || '"', '') || coalesce(',"source":"' || source || '"', '') || '}' AS json
        FROM live WHERE conversation_id = 'c00-000003' UNION ALL SELECT '{"error":"no such memory"}'"""),
    "report_table": _sql("""WITH $M$, c AS (SELECT coalesce(language, '-') AS language, count(*) n FROM m GROUP BY 1)
        SELECT '| language | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || language || ' | ' || n || ' |', chr(10) ORDER BY language) AS markdown FROM c"""),
    "corpus_survey": _sql("""WITH $M$, t AS (SELECT value, count(*) n FROM (SELECT unnest($TAGS$) AS value FROM m) GROUP BY 1 ORDER BY n DESC, value LIMIT 3),
        x AS (SELECT string_agg(value || ':' || n, ',' ORDER BY n DESC, value) tops FROM t)
        SELECT count(*) n_memories, strftime(min(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') || '..' || strftime(max(created_at) AT TIME ZONE 'UTC', '%Y-%m-%d') AS days, min(tops) top_tags, min(tops) top_entities FROM m, x"""),
    "verified_model": "SELECT * FROM (VALUES ('one.txt', 'a', true), ('two.txt', 'b', true), ('bad.txt', 'b', false), ('gone.txt', NULL, false)) x(file, folder, ok)",
    "path_histogram": _batch(f"""WITH {_FULL} SELECT CASE WHEN doc_id IN (SELECT query_id FROM fs) THEN 'hybrid' ELSE 'local' END AS path, count(*) n
        FROM documents WHERE doc_id % 50 = 0 GROUP BY ALL""", "10", "30"),
    "recency_score": _sql("WITH $M$ SELECT id, round(pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0), 6) recency FROM m"),
    "profile_guard": "SELECT profile_safe_id, count(*) n FROM memory_embeddings WHERE profile_safe_id = 'p64_main_7be1d0' AND len(embedding) = 64 GROUP BY ALL",
    "safe_ids": _sql("""WITH $M$ SELECT DISTINCT embedding_profile, replace(lower(embedding_profile), '-', '_') || '_' ||
        substr(sha256(embedding_profile || '|' || embedding_backend || '|' || embedding_dim), 1, 6) safe_id FROM m WHERE embedding_profile IS NOT NULL"""),
    "query_tokens": _sql("""SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), '|') tokens FROM (SELECT doc_id,
        list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{M}\\p{N}]+'), lambda w: length(w) >= 2 AND NOT list_contains($STOP$, w)) w FROM documents WHERE title IS NOT NULL)"""),
    "entity_fallback": _sql("""WITH k AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', 'What about', title, source)), '[^\\p{L}\\p{M}\\p{N}]+'),
          lambda w: length(w) >= 4 AND NOT list_contains($CSTOP$, w)) k FROM documents WHERE title IS NOT NULL),
        a AS (SELECT doc_id, k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]) c FROM k)
        SELECT doc_id, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[1:12], '|') AS names FROM a"""),
    "lexical_postings": _sql("WITH $M$, $POST$ SELECT lexeme, count(*) n_rows, round(sum(weight), 6) weight FROM post GROUP BY lexeme", SRC="m"),
    "lexical_rank": _sql("WITH $M$, $LIVE$, $TERMS$, $LEX$ SELECT id, round(lexical, 6)::DOUBLE lexical FROM lex"),
    "lexical_topk": _sql("WITH $M$, $LIVE$, $TERMS$, $LEX$ SELECT id, round(lexical, 6)::DOUBLE lexical FROM lex ORDER BY round(lexical, 9) DESC, id LIMIT 25"),
    "entity_branch": _sql("""WITH $M$, $LIVE$, $MEN$, $ENT$, $NAMES$ SELECT id FROM live WHERE id IN
        (SELECT memory_id FROM men JOIN ent ON ent.id = men.entity_id WHERE lower(canonical_name) IN (SELECT n FROM names)) ORDER BY id LIMIT 25"""),
    "entity_mentions": _sql("WITH $MEN$, $ENT$ SELECT entity_type, count(*) n, count(DISTINCT memory_id) n_memories FROM men JOIN ent ON ent.id = entity_id GROUP BY entity_type"),
    "tag_counts": _sql("""WITH $M$, t AS (SELECT unnest($TAGS$) AS value FROM m), c AS (SELECT value, count(*) n FROM t WHERE value <> 'en' GROUP BY value ORDER BY n DESC, value LIMIT 20)
        SELECT (row_number() OVER (ORDER BY n DESC, value))::INTEGER AS rank, value, n FROM c"""),
    "memory_tags": _sql("WITH $M$ SELECT id, array_to_string($TAGS$, ',') tags FROM m WHERE len($TAGS$) > 0"),
    "tag_ids": _sql("""WITH $M$, t AS (SELECT DISTINCT unnest($TAGS$) AS name FROM m), h AS (SELECT name, sha256('memoriq:tag:' || name) h FROM t)
        SELECT name, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3),
          substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1)::INTEGER % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) id FROM h"""),
    "list_recent": _sql("""WITH $M$, $LIVE$, p AS (SELECT * FROM live ORDER BY created_at DESC, id LIMIT 5000),
        s AS (SELECT id, created_at, pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0) s FROM p)
        SELECT id, round(s, 6) score FROM s ORDER BY round(s, 9) DESC, created_at DESC, id LIMIT 25"""),
    "prefilter_limit": _sql("WITH $M$, $LIVE$ SELECT id, epoch_us(created_at) created_us FROM live ORDER BY created_at DESC, id LIMIT 100"),
    "recall_local": _sql("""WITH $M$, $LIVE$, $V$, $QV$, p AS (SELECT * FROM live ORDER BY created_at DESC, id LIMIT 5000),
        s AS (SELECT id, created_at, CASE WHEN e IS NULL THEN 0.0 ELSE greatest(0.0, list_cosine_similarity(e, q)) END semantic,
          pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0) recency FROM p LEFT JOIN v ON memory_id = id, qv)
        SELECT id, round(semantic, 6) semantic, round(recency, 6) recency, round(0.7 * semantic + 0.3 * recency, 6) score FROM s
        ORDER BY round(0.7 * semantic + 0.3 * recency, 9) DESC, created_at DESC, id LIMIT 10"""),
    "recall_around": _sql("""WITH $M$, $LIVE$, a AS (SELECT $EFF$ AS at_ts FROM m WHERE tombstoned ORDER BY id LIMIT 1),
        d AS (SELECT id, abs(epoch_us($EFF$) - epoch_us(at_ts)) / 1000000.0 delta FROM live, a WHERE abs(epoch_us(occurred_at) - epoch_us(at_ts)) <= 604800000000 OR abs(epoch_us(created_at) - epoch_us(at_ts)) <= 604800000000)
        SELECT id, round(delta, 6) delta, round(1.0 - least(1.0, delta / 604800.0), 6) score FROM d ORDER BY d.delta, id LIMIT 10"""),
    "recall_around_batch": _sql("""WITH $M$, $LIVE$, a AS (SELECT doc_id anchor_id, epoch_us(created_at) us FROM documents WHERE doc_id % 50 = 0)
        SELECT anchor_id, rank, id, delta_us FROM (SELECT anchor_id, id, abs(epoch_us($EFF$) - us) delta_us, row_number() OVER (PARTITION BY anchor_id ORDER BY abs(epoch_us($EFF$) - us), id) AS rank
        FROM live, a WHERE abs(epoch_us(occurred_at) - us) <= 86400000000 OR abs(epoch_us(created_at) - us) <= 86400000000) WHERE rank <= 3"""),
    "seed_union_merge": _sql(f"WITH {_SEEDS} SELECT id, round(semantic, 6) semantic, round(lexical, 6)::DOUBLE lexical, array_to_string(branches, ',') branches FROM seeds"),
    "branch_counts": _sql(f"""WITH {_SEEDS} SELECT count(*) FILTER (list_contains(branches, 'vec')) vec, count(*) FILTER (list_contains(branches, 'lex')) lex,
        count(*) FILTER (list_contains(branches, 'ent')) ent, count(*) unique_ids FROM seeds"""),
    "graph_neighbors": _sql(f"WITH {_SEEDS}, $NEAR$ SELECT id, shared FROM near"),
    "expand_graph": _sql(f"""WITH {_SEEDS}, $NEAR$, $EXP$ SELECT id, is_seed, shared, round(CASE WHEN is_seed THEN 1.0 ELSE least(1.0, shared / 3.0) END, 6)::DOUBLE graph FROM cand JOIN live USING (id)
        WHERE (occurred_at >= $FROM$ OR created_at >= $FROM$) AND (occurred_at <= $TO$ OR created_at <= $TO$)"""),
    "recall_hybrid": _sql(f"""WITH {_SEEDS}, $NEAR$, $EXP$,
        s AS (SELECT id, created_at, is_seed, shared, branches, greatest(0.0, CASE WHEN is_seed THEN coalesce(semantic, 0.0) WHEN e IS NULL THEN 0.0 ELSE greatest(0.0, list_cosine_similarity(e, q)) END) semantic,
          pow(0.5, greatest(0.0, ($AS_OF$ - epoch_us($EFF$)) / 86400000000.0) / 30.0) recency, CASE WHEN is_seed THEN 1.0 ELSE least(1.0, shared / 3.0) END graph, lexical
          FROM cand JOIN live USING (id) LEFT JOIN v ON memory_id = id, qv),
        t AS (SELECT *, 0.55::DOUBLE * semantic + 0.2::DOUBLE * recency + 0.1::DOUBLE * graph + 0.15::DOUBLE * lexical score FROM s)
        SELECT id, is_seed, shared, array_to_string(branches, ',') branches, round(semantic, 6) semantic, round(recency, 6) recency, round(graph, 6)::DOUBLE graph, round(lexical, 6)::DOUBLE lexical, round(score, 6) score
        FROM t ORDER BY round(t.score, 9) DESC, created_at DESC, id LIMIT 10"""),
    "recall_batch": _batch(f"""WITH {_FULL} SELECT query_id, rank, id, round(score, 6) score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, created_at DESC, id) AS rank
        FROM (SELECT *, 0.55::DOUBLE * semantic + 0.2::DOUBLE * recency + 0.1::DOUBLE * graph + 0.15::DOUBLE * lexical score FROM full_hits)) WHERE rank <= 10""", "10", "30"),
    "relate_traverse_khop": """WITH RECURSIVE w AS (SELECT lower(subject_entity_id) a, lower(object_entity_id) b FROM relations UNION SELECT lower(object_entity_id), lower(subject_entity_id) FROM relations),
        r(entity_id, hop) AS (SELECT * FROM (SELECT lower(id), 0 FROM entities ORDER BY lower(id) LIMIT 3) UNION SELECT b, hop + 1 FROM r JOIN w ON a = entity_id WHERE hop < 3)
        SELECT entity_id, min(hop) hop FROM r GROUP BY entity_id""",
    "outbox_stats": """SELECT count(*) pending, epoch_us(min(created_at)) oldest_us, (SELECT last_error FROM outbox WHERE sent_at IS NULL ORDER BY created_at NULLS LAST, id, last_error NULLS FIRST LIMIT 1) last_error,
        coalesce(sum(attempt_count), 0)::BIGINT attempts FROM outbox WHERE sent_at IS NULL""",
    "outbox_routes": """SELECT CASE WHEN record_type = 'memory' AND record_id IS NOT NULL AND lower(trim(operation)) IN ('insert', 'update', 'upsert') THEN 'upsert'
        WHEN record_type = 'memory' AND record_id IS NOT NULL AND lower(trim(operation)) = 'delete' THEN 'delete' ELSE 'ack' END route, count(*) n FROM outbox GROUP BY ALL""",
    "backlog_alarm": _sql("SELECT count(*) pending, count(*) >= 1000 too_many, coalesce(($AS_OF$ - epoch_us(min(created_at))) / 1000000.0 >= 3600, false) too_old FROM outbox WHERE sent_at IS NULL"),
    "retry_backoff": "SELECT attempt_count, count(*) n, CASE WHEN attempt_count > 0 THEN least(30.0, pow(2.0, attempt_count - 1)) ELSE 0.0 END::DOUBLE wait_seconds FROM outbox GROUP BY ALL",
    "upsert_latest_wins": """SELECT record_id, id, arrival_no FROM (SELECT lower(record_id) record_id, lower(id) id, arrival_no,
        row_number() OVER (PARTITION BY lower(record_id) ORDER BY created_at DESC NULLS LAST, lower(id) DESC, arrival_no DESC) rn FROM outbox WHERE record_id IS NOT NULL) WHERE rn = 1""",
    "upsert_memories": _sql("WITH $M$ SELECT id, CASE WHEN substr(id, 1, 1) < '8' THEN epoch_us(created_at) ELSE epoch_us(created_at) + 86400000000 END created_us, 'sync' source, round(-sentiment, 6) sentiment FROM m"),
    "replace_mentions": _sql("""WITH $MEN$, o AS (SELECT * FROM men WHERE memory_id IS NOT NULL)
        SELECT memory_id, CASE WHEN substr(memory_id, 1, 1) = 'a' THEN 1 ELSE count(*) END n, CASE WHEN substr(memory_id, 1, 1) = 'a' THEN 0 ELSE sum(start_offset) END::BIGINT offsets FROM o GROUP BY memory_id"""),
    "insert_tags": _sql("WITH $M$ SELECT unnest(['git', 'slack', 'unused']) AS name UNION SELECT unnest($TAGS$) FROM m"),
    "delete_cascade": _sql("""WITH $M$, $MEN$, $V$, g AS (SELECT id FROM m WHERE tombstoned) SELECT 'memories' table_name, count(*) n FROM m WHERE id NOT IN (SELECT id FROM g)
        UNION ALL SELECT 'mentions', count(*) FROM men WHERE memory_id IS NULL OR memory_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'embeddings', count(*) FROM v WHERE memory_id NOT IN (SELECT id FROM g)"""),
    "soft_delete": _sql("WITH $M$ SELECT (coalesce(tombstoned, false) OR substr(id, 1, 2) = '00') tombstoned, count(*) n FROM m GROUP BY 1"),
    "entity_first_spelling": _sql("""WITH $ENT$ SELECT key, entity_type, canonical_name FROM (SELECT lower(canonical_name) AS key, entity_type, canonical_name,
        row_number() OVER (PARTITION BY lower(canonical_name), entity_type ORDER BY id) rn FROM ent) WHERE rn = 1"""),
    "event_windows": """SELECT epoch_us(date_trunc('hour', ts)) start_us, event_type, count(*) n, round(sum(value), 2) total FROM events GROUP BY ALL""",
    "mrr_at_k": _batch(_EVAL + " SELECT query_id, round(rr, 6)::DOUBLE rr FROM met"),
    "ndcg_at_k": _batch(_EVAL + " SELECT query_id, round(ndcg, 6) ndcg FROM met"),
    "success_at_k": _batch(_EVAL + " SELECT query_id, success::DOUBLE success FROM met"),
    "ablation_metrics": _batch(f"WITH {_FULL}, $GR$, {_PATHS}, $MET$ SELECT run, round(avg(rr), 6) mrr, round(avg(ndcg), 6) ndcg, round(avg(success), 6) success, count(*) n_queries FROM met GROUP BY run", "10", "30"),
    "weight_sweep": _batch(f"""WITH {_BATCH}, $GR$, s AS (SELECT unnest([0.1::DOUBLE, 0.3, 0.5, 0.7, 0.9]) x),
        runs AS (SELECT concat_ws('/', format('{{:g}}', p.x), format('{{:g}}', q.x), format('{{:g}}', r.x)) run, p.x a, q.x b, r.x g, 1.0::DOUBLE - p.x - q.x - r.x d FROM s p, s q, s r WHERE 1.0::DOUBLE - p.x - q.x - r.x BETWEEN 0 AND 1),
        {_RUNS}, $MET$, mm AS (SELECT run, round(avg(rr), 6) mrr, round(avg(ndcg), 6) ndcg FROM met GROUP BY run)
        SELECT run, mrr, ndcg FROM mm JOIN runs USING (run) ORDER BY mrr DESC, ndcg DESC, a DESC, b DESC, g DESC, d DESC LIMIT 10"""),
    "failure_labels": _batch(f"""WITH {_BATCH}, $GR$, t AS (SELECT query_id, max(coalesce(grade, 0)) best, max(coalesce(grade, 0)) FILTER (rank = 1) t1, max(lexical) FILTER (rank = 1) l1
        FROM ranked LEFT JOIN gr USING (query_id, id) WHERE rank <= 5 GROUP BY 1)
        SELECT doc_id query_id, CASE WHEN doc_id NOT IN (SELECT query_id FROM gr) THEN 'no-truth' WHEN best IS NULL THEN 'no-results' WHEN best = 0 THEN 'miss' WHEN t1 = 0 AND l1 > 0.3 THEN 'lexical-hit'
        WHEN t1 = 0 THEN 'rank-issue' WHEN t1 = 2 THEN 'good' WHEN t1 = 1 THEN 'partial-top1' ELSE 'unclassified' END AS label
        FROM documents LEFT JOIN t ON t.query_id = doc_id WHERE doc_id % 50 = 0"""),
    "parity_jaccard": _batch(f"""WITH {_FULL}, {_PATHS}
        SELECT coalesce(l.query_id, r.query_id) query_id, round(count(*) FILTER (l.id = r.id) / greatest(1, count(*))::DOUBLE, 6) jaccard
        FROM (SELECT * FROM rk WHERE run = '1_local') l FULL JOIN (SELECT * FROM rk WHERE run = '4_lexical') r ON l.query_id = r.query_id AND l.id = r.id GROUP BY 1""", "10", "30"),
    "parity_spearman": _batch(f"""WITH {_FULL}, {_PATHS},
        c AS (SELECT coalesce(l.query_id, r.query_id) query_id, count(*) FILTER (l.id = r.id) n, coalesce(sum((l.rank - r.rank) * (l.rank - r.rank)), 0) s
        FROM (SELECT * FROM rk WHERE run = '1_local') l FULL JOIN (SELECT * FROM rk WHERE run = '4_lexical') r ON l.query_id = r.query_id AND l.id = r.id GROUP BY 1)
        SELECT query_id, n AS common, round(CASE WHEN n >= 2 THEN 1.0 - 6.0 * s / (n * (n * n - 1)) END, 6)::DOUBLE spearman FROM c""", "10", "30"),
    "latency_stats": """WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 r, count(*) OVER (PARTITION BY event_type) n FROM events WHERE value IS NOT NULL)
        SELECT event_type, count(*) AS count, round(avg(value), 6) AS mean, max(value) FILTER (r = floor((n - 1) * 0.5 + 0.5)) p50, max(value) FILTER (r = floor((n - 1) * 0.95 + 0.5)) p95,
        max(value) FILTER (r = floor((n - 1) * 0.99 + 0.5)) p99, min(value) AS min, max(value) AS max, round(stddev_pop(value), 4) AS stdev FROM o GROUP BY event_type""",
    "grade_around_date": _sql("""WITH $M$, q AS (SELECT doc_id query_id, (created_at AT TIME ZONE 'UTC')::DATE AS day FROM documents WHERE doc_id % 50 = 0)
        SELECT query_id, CASE WHEN q.day = ($EFF$ AT TIME ZONE 'UTC')::DATE THEN 2 ELSE 1 END grade, count(*) n FROM q, m WHERE abs(($EFF$ AT TIME ZONE 'UTC')::DATE - q.day) <= 2 GROUP BY ALL"""),
    "grade_cells": _batch(f"WITH {_BATCH}, $GR$ SELECT grade, count(*) n, count(DISTINCT query_id) n_queries FROM gr GROUP BY grade"),
    "title_extract": """SELECT doc_id, CASE WHEN coalesce(trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1)), '') <> '' THEN trim(regexp_extract(text, '(?m)^#\\s+(.+)$', 1))
        ELSE array_to_string(list_transform(string_split(replace(lower(coalesce(title, 'no title')), '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END found, '2024-01-31' AS day FROM documents""",
    "note_ids": "SELECT doc_id, 'n' || substr(sha1(note_id), 1, 10) hashed, note_id || '-c' || substr(lpad(chunk_id::VARCHAR, 2, '0'), 1, 2) AS chunk FROM documents",
    "commit_tags": """SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(['git', 'docs', CASE WHEN doc_id % 3 = 0 THEN 'bugfix' WHEN doc_id % 3 = 1 THEN 'engine' END,
        CASE WHEN coalesce(lower(trim(source)), '.') <> '.' THEN lower(trim(source)) END], lambda x: x IS NOT NULL))), ',') tags FROM documents""",
    "company_slugs": """WITH p AS (SELECT p_partkey, string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') s FROM part),
        c AS (SELECT p_partkey, CASE WHEN len(s) >= 2 AND length(s[1]) > 2 THEN s[1] || ' ' || s[2] ELSE s[1] END c FROM p) SELECT p_partkey, CASE WHEN length(c) >= 5 THEN c END company FROM c""",
    "text_predicates": _sql("""WITH $M$ SELECT * FROM (SELECT id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{M}\\p{N}_])garden($|[^\\p{L}\\p{M}\\p{N}_])') word,
        contains(lower(text), 'met') AND contains(lower(text), 'about') AS both, contains(lower(text), 'kettle') OR contains(lower(text), 'violin') either FROM m) WHERE word OR "both" OR either"""),
    "head_truncate": """WITH c AS (SELECT doc_id, text, text[1:1800] cut FROM documents), p AS (SELECT *, length(regexp_extract(cut, '(?s)^(.*)(?:\\. |!\\n|\\?\\n)', 1)) f FROM c)
        SELECT doc_id, CASE WHEN length(text) <= 1800 THEN length(text) WHEN f > 120 THEN f + 1 ELSE length(cut) END::INTEGER n_chars FROM p""",
    "time_buckets": _sql("""WITH $M$, s AS (SELECT (max(created_at) AT TIME ZONE 'UTC')::DATE - (min(created_at) AT TIME ZONE 'UTC')::DATE d FROM m)
        SELECT strftime(date_trunc(CASE WHEN d <= 60 THEN 'week' ELSE 'month' END, (created_at AT TIME ZONE 'UTC')::DATE), '%Y-%m-%d') bucket, count(*) n FROM m, s GROUP BY ALL"""),
    "iso_times": _sql("WITH $M$ SELECT id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') iso, true same FROM m"),
    "now_fields": """SELECT '2024-03-09T17:05:06.000Z' iso8601, strftime(t, '%Y-%m-%d') AS date, strftime(t, '%H:%M:%S') AS time, 'UTC' timezone, 0 utc_offset_seconds, dayname(t) day_of_week,
        dayofyear(t)::INTEGER day_of_year, weekofyear(t)::INTEGER week_of_year, quarter(t)::INTEGER AS quarter, epoch(t)::BIGINT unix_timestamp FROM (SELECT TIMESTAMP '2024-03-09 17:05:06' t)""",
    "parse_dates": """WITH r AS (SELECT arrival_no id, (created_at AT TIME ZONE 'UTC')::DATE d FROM outbox WHERE last_error IS NOT NULL OR payload IS NOT NULL)
        SELECT id, strftime(d, '%Y-%m-%d') matched_text, strftime(d, '%Y-%m-%d') AS day FROM r UNION ALL SELECT id, strftime(d, '%-d.%-m.%Y'), strftime(d, '%Y-%m-%d') FROM r""",
    "folder_survey": "SELECT lower(trim(source)) folder, count(*) n, epoch_us(min(created_at)) first_us, epoch_us(max(created_at)) last_us FROM documents GROUP BY 1",
    "distinct_months": _sql("WITH $M$ SELECT count(DISTINCT (created_at AT TIME ZONE 'UTC')::DATE) n_days, count(DISTINCT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m')) n_months FROM m"),
    "language_profile": _sql("WITH $M$ SELECT language, count(*) n, round(avg(sentiment), 6) sentiment FROM m GROUP BY language"),
    "outbox_batch": _sql("WITH $OUT$ SELECT id FROM o WHERE sent_at IS NULL ORDER BY created_at, id LIMIT 100"),
    "outbox_marks": _sql("WITH $OUT$ SELECT count(*) FILTER (sent_at IS NULL AND substr(id, 1, 1) >= '8') pending, count(*) FILTER (sent_at IS NULL AND substr(id, 1, 1) >= '8') refused FROM o"),
    "entity_acronyms": _sql("WITH $M$ SELECT id, array_to_string($ACR$, '|') acronyms FROM m WHERE len($ACR$) > 0"),
    "entity_frequency": _sql("""WITH $M$, c AS (SELECT value, count(*) n FROM (SELECT unnest($ACR$) AS value FROM m) GROUP BY value ORDER BY n DESC, value LIMIT 20)
        SELECT (row_number() OVER (ORDER BY n DESC, value))::INTEGER AS rank, value, n FROM c"""),
    "grade_overlap": _sql("""WITH $M$, a AS (SELECT id, unnest(list_distinct($ACR$)) x FROM m), t AS (SELECT id, unnest($TAGS$) x FROM m),
        q AS (SELECT doc_id query_id, unnest(list_filter(w, lambda x, i: list_position(w, x) = i)[1:3]) x FROM (SELECT doc_id, $ACR$ w FROM documents WHERE doc_id % 50 = 0)),
        g AS (SELECT query_id, id, 2 grade FROM q JOIN a USING (x) UNION ALL SELECT doc_id, id, 1 FROM documents, t WHERE doc_id % 50 = 0 AND x = 'voice')
        SELECT query_id, grade, count(*) n FROM (SELECT query_id, id, max(grade) grade FROM g GROUP BY ALL) GROUP BY ALL"""),
    "fine_grid": """WITH s AS (SELECT unnest([0.3::DOUBLE, 0.5]) a0, unnest([0.5::DOUBLE, 0.3]) b0, unnest([0.1::DOUBLE, 0.1]) g0), w AS (SELECT unnest([-0.1::DOUBLE, -0.05, 0.0, 0.05, 0.1]) x), n AS (SELECT unnest([-0.05::DOUBLE, 0.0, 0.05]) y),
        c AS (SELECT least(1.0, greatest(0.0, a0 + p.x)) a, least(1.0, greatest(0.0, b0 + q.x)) b, least(1.0, greatest(0.0, g0 + y)) g FROM s, w p, w q, n), d AS (SELECT *, 1.0::DOUBLE - a - b - g d FROM c)
        SELECT DISTINCT round(a, 3) a, round(b, 3) b, round(g, 3) g, round(d, 3) d FROM d WHERE d BETWEEN 0 AND 1""",
}
SQL["failure_table"] = f"SELECT CASE WHEN query_id % 100 = 0 THEN 'even' ELSE 'odd' END stratum, label, count(*) n FROM ({SQL['failure_labels']}) GROUP BY ALL"
SQL["mirror_stream"] = """
    WITH d AS (SELECT lower(id) change_id, lower(record_id) record_id, lower(trim(operation)) op, created_at, payload,
        row_number() OVER (PARTITION BY lower(id) ORDER BY coalesce(attempt_count, -1) DESC, arrival_no DESC) rn
        FROM outbox WHERE record_type = 'memory' AND record_id IS NOT NULL),
    c AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY created_at NULLS FIRST, change_id) pos FROM d WHERE rn = 1),
    b AS (SELECT record_id, max(pos) base FROM c WHERE op <> 'update' GROUP BY record_id)
    SELECT c.record_id, c.change_id, c.payload FROM b JOIN c k ON k.record_id = b.record_id AND k.pos = b.base AND k.op <> 'delete'
    JOIN c ON c.record_id = b.record_id AND c.pos = (SELECT max(pos) FROM c x WHERE x.record_id = b.record_id)"""
SQL["sampled_days"] = _sql("""WITH $M$, d AS (SELECT DISTINCT strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM m),
    p AS (SELECT day, row_number() OVER (ORDER BY day) - 1 a, greatest(1, count(*) OVER () // 6) s FROM d)
    SELECT (a // s)::INTEGER AS place, day FROM p WHERE a % s = 0 AND a // s < 6""")
