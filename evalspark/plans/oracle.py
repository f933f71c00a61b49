"""SQL counterparts of the registered queries, for a side-by-side check on the same tables."""

from __future__ import annotations

import re

from evalspark.functions.text import (
    BOUNDARY_CLOSE,
    BOUNDARY_OPEN,
    BOUNDARY_STRIPPED,
    CONTROL_CHARS,
    CREDENTIAL_PATTERNS,
    CREDENTIAL_SHOWN,
    ERROR_CHARS,
    GENERIC_ERROR,
    INFRA_PATTERNS,
    INFRA_SHOWN,
    INJECTION_PATTERNS,
    MAX_WRAPPED_CHARS,
    STRIPPED,
)
from evalspark.plans.queries import DAILY_CALLS, METADATA_MEMBERS, PASSES, REQUESTS
from evalspark.sources.adapters import REGISTRY
from evalspark.sources.views import LONG_EVERY, LONG_TIMES, PLANTED


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def cycle(index: str, values: list[str] | tuple[str, ...]) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[({index}) % {len(values)} + 1]"


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


SPLIT = cycle("doc_id", ("train", "validation", "test"))
SUBJECT = "CASE WHEN doc_id % 7 <> 0 THEN lang END"

VIEWS: dict[str, str] = {
    "v_datasets": f"""
        SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS id, source AS name,
          {cycle("CAST(substr(source, 4) AS BIGINT)",
                 ("multiple_choice", "code_generation", "math_reasoning", "science_qa"))} AS task_type
        FROM documents""",
    "v_examples": f"""
        SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS BIGINT) AS dataset_id,
          d.text AS question, CAST(l.quality AS VARCHAR) AS answer,
          {SUBJECT.replace("doc_id", "d.doc_id")} AS subject,
          {SPLIT.replace("doc_id", "d.doc_id")} AS split,
          TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS created_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_joined": """
        SELECT e.*, s.name AS dataset_name, s.task_type
        FROM v_examples e JOIN v_datasets s ON e.dataset_id = s.id""",
    "v_catalog": """
        SELECT p_partkey AS id, p_name AS question, p_brand AS dataset, p_type AS task_type
        FROM part""",
    "v_vectors": """
        SELECT 'emb_' || (label % 3) AS collection, vec_id AS example_id,
          CAST(embedding AS DOUBLE[]) AS vector
        FROM embeddings""",
    "v_users": """
        SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email,
          CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'pro' WHEN 'BUILDING' THEN 'ultra'
            ELSE 'free' END AS tier,
          CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2024-01-05'
            WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-15' END AS trial_ends_at,
          CASE WHEN c_custkey % 2 = 0 THEN 'cus_' || c_custkey END AS customer_id,
          TIMESTAMP '2024-01-02' AS quota_reset_at, c_mktsegment AS segment, c_acctbal AS balance
        FROM customer""",
    "v_api_keys": """
        SELECT o_orderkey AS id, o_custkey AS user_id, 'ck_' || o_orderkey AS key_prefix,
          o_orderstatus <> 'F' AS is_active, o_orderdate AS created_at
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "v_collections": """
        SELECT o_orderkey AS id, 'order ' || o_orderkey AS name, CAST(NULL AS VARCHAR) AS description,
          o_custkey AS user_id, o_orderdate AS created_at
        FROM orders""",
    "v_links": """
        SELECT l_orderkey AS collection_id, l_partkey AS example_id, min(l_shipdate) AS added_at
        FROM lineitem GROUP BY ALL""",
    "v_picks": """
        SELECT l_orderkey AS collection_id, l_partkey AS example_id FROM lineitem""",
    "v_events": """
        SELECT event_id AS id,
          CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'search'
            WHEN 'purchase' THEN 'pick' WHEN 'signup' THEN 'export'
            WHEN 'error' THEN 'remove' END AS event_type,
          'u' || user_id || CASE WHEN event_id % 50 = 0 THEN ' ' ELSE '-' END
            || strftime(ts, '%Y-%m-%d') AS session_id,
          user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS example_id,
          user_id AS collection_id,
          CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS dataset_id,
          CASE WHEN event_type = 'click' THEN 'k' || json_extract_string(props, '$.k') END AS query,
          ts AS created_at
        FROM events""",
    "v_texts": f"""
        SELECT kind, text_id,
          CASE WHEN text_id % {LONG_EVERY} = 0 THEN repeat(text, {LONG_TIMES}) ELSE text END
            || {cycle("text_id", PLANTED)} AS text
        FROM (SELECT 'document' AS kind, doc_id AS text_id, text FROM documents
              UNION ALL
              SELECT 'turn', conv_id * 1000 + turn, text FROM conversations)""",
    "v_answers": """
        SELECT doc_id, text, '{"search_query": "q' || doc_id
          || '", "tool": "keyword_search", "dataset": "src' || (doc_id % 20)
          || '", "subject": null, "task_type": "science_qa", "explanation": "because", "rationale": "r'
          || doc_id || '", "ranked_ids": [' || doc_id || ', "' || (doc_id + 1)
          || '", 3], "relevance_score": ' || (doc_id % 11) || ', "assessment": "fine"}' AS answer
        FROM documents""",
    "v_responses": """
        SELECT doc_id, 'asked ' || doc_id AS original,
          CASE doc_id % 9 WHEN 0 THEN answer
            WHEN 1 THEN '```json' || chr(10) || answer || chr(10) || '```'
            WHEN 2 THEN '{"search_query": '
            WHEN 3 THEN '{"dataset": "src1"}'
            WHEN 4 THEN '[1, 2]'
            WHEN 5 THEN '{"search_query": "", "tool": "x", "ranked_ids": [1, "x"], "relevance_score": 7}'
            WHEN 6 THEN '```' || answer || '```'
            WHEN 7 THEN text
            ELSE '  ' || chr(10) || answer || ' trailing' END AS response
        FROM v_answers""",
    "v_trimmed": """
        SELECT doc_id, original, trim(response, chr(32) || chr(10) || chr(9) || chr(13)) AS body
        FROM v_responses""",
    "v_unfenced": """
        SELECT doc_id, original,
          CASE WHEN NOT starts_with(body, '```') THEN body
            WHEN contains(body, chr(10)) THEN substr(body, instr(body, chr(10)) + 1)
            ELSE substr(body, 4) END AS body, starts_with(body, '```') AS fenced
        FROM v_trimmed""",
    "v_bodies": """
        SELECT doc_id, original,
          trim(CASE WHEN fenced AND contains(body, '```')
            THEN regexp_extract(body, '^(.*)```', 1, 's') ELSE body END,
            chr(32) || chr(10)) AS body
        FROM v_unfenced""",
    "v_parsed": """
        SELECT doc_id, original,
          CASE WHEN starts_with(body, '{') AND json_valid(body) THEN CAST(body AS JSON) END AS j
        FROM v_bodies""",
    "v_raw": f"""
        SELECT doc_id, doc_id AS pos, text, lang, n_chars, {SPLIT} AS split,
          string_split(text, ' ') AS words
        FROM documents""",
}


def _with(sql: str) -> str:
    """Prepends the views a statement uses, each after the ones it needs itself."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\bv_[a-z_]+\b", body):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    recursive = "RECURSIVE " if "recursive" in sql else ""
    if sql.lstrip().upper().startswith("WITH"):
        rest = re.sub(r"^\s*WITH\s+(RECURSIVE\s+)?", "", sql, flags=re.I)
        return f"WITH {recursive}{head},\n{rest}"
    return f"WITH {recursive}{head}\n{sql}"


SQL: dict[str, str] = {}

# -- sources and scans ---------------------------------------------------------------------------

SQL["ingest_scan_splits"] = """
    SELECT 'train' AS split, doc_id, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn,
      NULL::BIGINT AS item_id, lang, text FROM documents
    UNION ALL SELECT 'validation', NULL, conv_id, turn, NULL, NULL, text FROM conversations
    UNION ALL SELECT 'test', NULL, NULL, NULL, item_id, NULL, text FROM benchmark"""
SQL["schema_probe"] = """
    WITH first_rows AS (SELECT * FROM documents ORDER BY doc_id LIMIT 5)
    SELECT CAST(doc_id AS VARCHAR) AS row_key, column_name, column_type, value FROM first_rows,
    LATERAL (VALUES ('doc_id', 'bigint', CAST(doc_id AS VARCHAR)), ('text', 'string', text),
      ('lang', 'string', lang), ('source', 'string', source),
      ('n_chars', 'bigint', CAST(n_chars AS VARCHAR))) AS t(column_name, column_type, value)"""
SQL["list_examples"] = """
    SELECT id, dataset_id, question, answer, subject, split FROM v_examples
    WHERE dataset_id = 3 AND subject = 'en' ORDER BY id LIMIT 20"""
SQL["list_examples_total"] = """
    SELECT count(*) AS total FROM v_examples WHERE dataset_id = 3 AND subject = 'en'"""
SQL["lookup_by_ids"] = """
    SELECT id, dataset_id, question, subject FROM v_examples
    WHERE id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
SQL["list_datasets"] = "SELECT id, name, task_type FROM v_datasets ORDER BY name"
SQL["embedding_audit"] = """
    WITH facts AS (
      SELECT collection, count(*) AS points, min(len(vector)) AS min_dims,
        max(len(vector)) AS max_dims, min(example_id) AS sample_id
      FROM v_vectors GROUP BY collection),
    scored AS (
      SELECT f.collection, v.example_id,
        round(list_cosine_similarity(v.vector, s.vector), 9) AS score
      FROM facts f
      JOIN v_vectors s ON s.collection = f.collection AND s.example_id = f.sample_id
      JOIN v_vectors v ON v.collection = f.collection),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, example_id) AS rank
      FROM scored)
    SELECT f.*, r.rank, r.example_id AS neighbour_id, round(r.score, 6) AS score
    FROM facts f JOIN ranked r ON f.collection = r.collection WHERE r.rank <= 3"""
SQL["ingest_audit"] = """
    SELECT * FROM (
      SELECT dataset_id, id, count(*) OVER (PARTITION BY dataset_id) AS total,
        row_number() OVER (PARTITION BY dataset_id ORDER BY id) AS sample_no
      FROM v_examples) WHERE sample_no <= 3"""

# -- sinks and table upkeep ----------------------------------------------------------------------

SQL["register_datasets"] = """
    SELECT id, name, task_type, false AS is_new FROM v_datasets
    UNION ALL
    SELECT CAST('0x' || substr(md5(name), 1, 15) AS BIGINT), name, 'catalog', true
    FROM (SELECT DISTINCT p_brand AS name FROM part)
    WHERE name NOT IN (SELECT name FROM v_datasets)"""
_PACKED = "(CAST({number} AS BIGINT) << 44) + (CAST({split_no} AS BIGINT) << 40) + pos"


def _split_no(splits: tuple[str, ...]) -> str:
    return f"(list_position([{', '.join(map(lit, splits))}], split) - 1)"


def _normal(name: str, answer: str, choices: str, question: str = "text", extra: str = "") -> str:
    adapter = REGISTRY[name]
    packed = _PACKED.format(number=adapter.number, split_no=_split_no(adapter.splits))
    members = ", ".join(map(lit, adapter.splits))
    return f"""SELECT {packed} AS id, CAST({adapter.number} AS BIGINT) AS dataset_id, pos, split,
        {question} AS question, {answer} AS answer, {choices} AS choices{extra}
        FROM v_raw WHERE split IN ({members})"""


def _letters(expr: str) -> str:
    return f"list_transform({expr}, lambda x, i: chr(CAST(64 + i AS INTEGER)) || ': ' || coalesce(x, ''))"


def _opt(n: int) -> str:
    return f"coalesce(words[{n}], '')"


_HELLA = f"coalesce(TRY_CAST({cycle('doc_id', ('0', '1', '2', '3', 'x', '-1', '7'))} AS INTEGER), 0)"
_GSM = """CASE WHEN doc_id % 4 = 1 THEN text
      WHEN doc_id % 4 = 2 THEN '#### -' || n_chars || '.5'
      ELSE text || ' #### ' || format('{:,}', n_chars) END"""
_NO_CHOICES = "CAST(NULL AS VARCHAR[])"
_MC1_SIZE = "len(words[1:30])"

NORMAL: dict[str, str] = {
    "mmlu": _normal(
        "mmlu",
        "CASE WHEN doc_id % 5 < len(words[1:4]) THEN chr(CAST(65 + doc_id % 5 AS INTEGER)) END",
        _letters("words[1:4]"),
        extra=", lang AS m_subject, split AS m_split, CAST(doc_id % 5 AS VARCHAR) AS m_answer_index,"
        " CAST(len(words[1:4]) AS VARCHAR) AS m_num_choices",
    ),
    "humaneval": _normal(
        "humaneval", "words[1]", _NO_CHOICES,
        extra=", 'HumanEval/' || doc_id AS m_task_id, 'f' || doc_id AS m_entry_point,"
        " 'true' AS m_has_test, split AS m_split",
    ),
    "gsm8k": _normal(
        "gsm8k", _GSM, _NO_CHOICES,
        extra=f", split AS m_split, replace(nullif(regexp_extract({_GSM},"
        r" '####\s*([\d,\.\-]+)', 1), ''), ',', '') AS m_final_answer",
    ),
    "hellaswag": _normal(
        "hellaswag",
        f"CASE WHEN {_HELLA} BETWEEN 0 AND 3 THEN chr(65 + {_HELLA}) ELSE 'A' END",
        _letters("words[1:4]"),
        extra=f", lang AS m_activity_label, split AS m_split, CAST({_HELLA} AS VARCHAR) AS m_answer_index",
    ),
    "truthfulqa": _normal(
        "truthfulqa",
        f"CASE WHEN doc_id % 31 < {_MC1_SIZE} AND doc_id % 31 < 26"
        " THEN chr(CAST(65 + doc_id % 31 AS INTEGER)) END",
        _letters("words[1:26]"),
        extra=", split AS m_split",
    ),
    "arc": _normal(
        "arc", cycle("doc_id", "ABCD"),
        _letters("words[1:CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 4 END]"),
        extra=", 'q' || doc_id AS m_question_id, split AS m_split, 'challenge' AS m_difficulty",
    ),
    "winogrande": _normal(
        "winogrande", "CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END",
        f"['A: ' || {_opt(1)}, 'B: ' || {_opt(2)}]", extra=", split AS m_split",
    ),
    "piqa": _normal(
        "piqa", "CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END",
        f"['A: ' || {_opt(1)}, 'B: ' || {_opt(2)}]", extra=", split AS m_split",
    ),
    "mbpp": _normal(
        "mbpp", "CASE WHEN doc_id % 5 <> 0 THEN nullif(words[1], '') END", _NO_CHOICES,
        extra=", CAST(doc_id AS VARCHAR) AS m_task_id, CASE WHEN doc_id % 4 = 3 THEN '0'"
        " ELSE CAST(least(doc_id % 4, len(words)) AS VARCHAR) END AS m_num_tests,"
        " CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END AS m_has_challenge_tests,"
        " split AS m_split",
    ),
    "boolq": _normal(
        "boolq", "CASE doc_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END", "['A: Yes', 'B: No']",
        extra=", substr(text, 1, 500) AS m_passage, split AS m_split",
    ),
}

for _name, _body in NORMAL.items():
    _members = ", ".join(f"m_{m}" for m in METADATA_MEMBERS[_name])
    SQL[f"norm_{_name}"] = f"""
    SELECT id, dataset_id, md5(question) AS question_md5, md5(answer) AS answer_md5,
      array_to_string(choices, '|') AS choices, {_members} FROM ({_body})"""

_ALL = "\nUNION ALL\n".join(
    f"SELECT id, dataset_id, split, question, answer, choices FROM ({body})"
    for body in NORMAL.values()
)
SQL["ingest_all"] = f"""
    SELECT dataset_id, split, count(*) AS n, count(answer) AS answers,
      CAST(sum(length(question)) AS BIGINT) AS question_chars,
      CAST(sum(length(answer)) AS BIGINT) AS answer_chars,
      CAST(sum(len(choices)) AS BIGINT) AS choices, min(id) AS first_id, max(id) AS last_id
    FROM ({_ALL}) GROUP BY dataset_id, split"""
SQL["reingest_idempotent"] = f"""
    SELECT dataset_id, split, count(*) AS n, count(DISTINCT id) AS ids,
      CAST(sum(length(question)) AS BIGINT) AS chars
    FROM (SELECT id, dataset_id, split, question FROM ({NORMAL["gsm8k"]})
          UNION ALL SELECT id, dataset_id, split, question FROM ({NORMAL["winogrande"]}))
    GROUP BY dataset_id, split"""
SQL["ingest_limit"] = f"""
    SELECT id, split, md5(question) AS question_md5 FROM ({NORMAL["mmlu"]}) ORDER BY id LIMIT 400"""

SQL["cascade_delete"] = """
    WITH gone AS (SELECT id FROM v_catalog WHERE right(dataset, 1) = '3')
    SELECT 'examples' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS checksum
    FROM v_catalog WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'links', count(*), CAST(sum(example_id) AS BIGINT)
    FROM v_links WHERE example_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'events', count(*), CAST(sum(CASE WHEN example_id NOT IN (SELECT id FROM gone)
      THEN example_id END) AS BIGINT) FROM v_events
    UNION ALL SELECT 'event_datasets', count(dataset_id), CAST(sum(dataset_id) AS BIGINT)
    FROM v_events WHERE dataset_id NOT IN (SELECT CAST(regexp_extract(dataset, '[0-9]+$') AS BIGINT) FROM v_catalog WHERE right(dataset, 1) = '3')"""
SQL["vector_collections"] = """
    SELECT v.collection, CAST(64 AS BIGINT) AS dims, ['COSINE', 'EUCLID', 'DOT'][CAST(right(v.collection, 1) AS INT) + 1] AS metric,
      count(*) AS points, CAST(sum(v.example_id) AS BIGINT) AS id_checksum, count(e.subject) AS subjects,
      CAST(sum(length(substr(e.question, 1, 500))) AS BIGINT) AS question_chars,
      round(sum(CAST(v.vector[1] AS DOUBLE) * CASE WHEN v.example_id % 3 = 0 THEN 2 ELSE 1 END), 4) AS first_sum
    FROM v_vectors v LEFT JOIN v_examples e ON e.id = v.example_id GROUP BY v.collection"""
SQL["vector_upsert"] = """
    WITH rows AS (
      SELECT collection, example_id, 0 AS batch, vector[1] AS first FROM v_vectors
      UNION ALL SELECT collection, example_id + 100, 1, vector[1] * 2 FROM v_vectors
      UNION ALL SELECT collection, example_id, 2, vector[1] * 2 FROM v_vectors WHERE collection = 'emb_0')
    SELECT collection, example_id, CAST(batch AS BIGINT) AS batch, CAST(64 AS BIGINT) AS dims,
      round(first, 6) AS first
    FROM rows QUALIFY row_number() OVER (PARTITION BY collection, example_id ORDER BY batch DESC) = 1"""

# The offline provider: the first 32 bits of a word's md5 give its place and sign; vectors of unit length, kept as float.
SQL["embed_dataset"] = r"""
    WITH words AS (SELECT id, unnest(regexp_extract_all(lower(question), '\S+')) AS word FROM v_examples),
    codes AS (SELECT id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS code FROM words),
    sums AS (
      SELECT id, (code >> 1) % 64 AS position, sum(CASE WHEN code % 2 = 1 THEN 1 ELSE -1 END) AS x FROM codes GROUP BY ALL),
    norms AS (SELECT id, sqrt(CAST(sum(x * x) AS DOUBLE)) AS norm FROM sums GROUP BY id)
    SELECT s.id AS example_id, d.name AS dataset_name, e.subject, length(substr(e.question, 1, 500)) AS question_chars,
      s.position, round(CAST(CAST(CAST(s.x AS DOUBLE) / n.norm AS FLOAT) AS DOUBLE), 6) AS value
    FROM sums s JOIN norms n USING (id) JOIN v_examples e USING (id) LEFT JOIN v_datasets d ON d.id = e.dataset_id
    WHERE s.x <> 0"""

VIEWS["v_exported"] = f"""
    SELECT pos AS id, pos % 20 AS dataset_id, question, answer,
      CASE WHEN pos % 6 <> 0 THEN choices END AS choices,
      CASE WHEN pos % 11 <> 0 THEN '{{"subject":' || to_json(m_subject) || ',"split":"' || split
        || '","answer_index":' || m_answer_index || ',"num_choices":' || m_num_choices || '}}'
      END AS metadata,
      CASE WHEN pos % 4 <> 3 THEN 'src' || (pos % 20) END AS dataset_name
    FROM ({NORMAL["mmlu"]})"""
_CHOICES = "coalesce(CAST(to_json(choices) AS VARCHAR), 'null')"
_ANSWER = "coalesce(CAST(to_json(answer) AS VARCHAR), 'null')"
_QUESTION = "CAST(to_json(question) AS VARCHAR)"
_META = "coalesce(metadata, 'null')"
_JSONL = f"""'{{"id":' || id || ',"dataset_id":' || dataset_id || ',"question":' || {_QUESTION}
      || ',"answer":' || {_ANSWER} || ',"choices":' || {_CHOICES}
      || coalesce(',"dataset_name":"' || dataset_name || '"', '')
      || coalesce(',"metadata":' || metadata, '') || '}}'"""
SQL["export_jsonl"] = f"SELECT id, {_JSONL} AS line FROM v_exported"
SQL["export_json"] = f"""
    WITH j AS (SELECT id, {_JSONL} AS line FROM v_exported)
    SELECT '  ' || line || CASE WHEN id = (SELECT max(id) FROM j) THEN '' ELSE ',' END AS line FROM j
    UNION ALL SELECT unnest(['[', ']'])"""
SQL["export_csv"] = """
    SELECT CAST(id AS VARCHAR) AS id, CAST(dataset_id AS VARCHAR) AS dataset_id, dataset_name,
      md5(question) AS question, answer,
      CASE WHEN len(choices) > 0 THEN CAST(to_json(choices) AS VARCHAR) END AS choices, metadata
    FROM v_exported"""
SQL["export_custom"] = """
    SELECT id || chr(9) || coalesce(answer, '') AS line FROM v_exported"""
_IDS = """'"source_id":' || id || ',"dataset_id":' || dataset_id
      || coalesce(',"dataset_name":"' || dataset_name || '"', '') || '}'"""
SQL["export_trace_items"] = f"""
    SELECT id, '{{"input":{{"question":' || {_QUESTION}
      || coalesce(',"choices":' || CAST(to_json(choices) AS VARCHAR), '') || '}},"expected_output":'
      || coalesce('{{"answer":' || CAST(to_json(answer) AS VARCHAR) || '}}', 'null') || ',"metadata":'
      || coalesce(left(metadata, length(metadata) - 1) || ',', '{{') || {_IDS} || '}}' AS line
    FROM v_exported"""
SQL["export_inspect"] = f"""
    SELECT id, '{{"input":' || {_QUESTION} || ',"target":' || {_ANSWER} || ',"choices":' || {_CHOICES}
      || ',"id":"' || id || '","metadata":' || {_META} || '}}' AS line FROM v_exported"""
SQL["export_langsmith"] = f"""
    SELECT id, '{{"inputs":{{"question":' || {_QUESTION} || ',"choices":' || {_CHOICES}
      || '}},"outputs":{{"answer":' || {_ANSWER} || '}},"metadata":' || {_META} || '}}' AS line
    FROM v_exported"""
SQL["export_harness"] = f"""
    SELECT id, '{{"doc_id":' || id || ',"query":' || {_QUESTION} || ',"choices":' || {_CHOICES}
      || ',"gold":' || coalesce(CAST(CASE WHEN choices IS NOT NULL THEN ascii(answer) - 65 END AS VARCHAR), 'null')
      || '}}' AS line FROM v_exported"""
SQL["embedding_text"] = """
    SELECT id, md5(CASE WHEN len(choices) > 0 THEN question || ' ' || array_to_string(choices, ' ')
      ELSE question END) AS text_md5 FROM v_exported"""

SQL["event_normalise"] = r"""
    SELECT id, event_type,
      CASE WHEN regexp_matches(session_id, '^[0-9a-zA-Z\-_]{1,100}$') THEN session_id END AS session_id,
      user_id, example_id, query FROM v_events"""
SQL["user_data_export"] = f"""
    WITH log AS (
      SELECT e.* FROM v_events e WHERE user_id IN (SELECT id FROM v_users))
    SELECT id AS user_id, 'account' AS section, id AS item_id,
      '{{"email":"' || email || '","tier":"' || tier || '","trial_ends_at":'
      || coalesce('"' || {stamp("trial_ends_at")} || '"', 'null') || '}}' AS payload FROM v_users
    UNION ALL
    SELECT user_id, 'collection', id, '{{"name":"' || name || '","description":null,"created_at":"'
      || {stamp("created_at")} || '"}}' FROM v_collections WHERE user_id IN (SELECT id FROM v_users)
    UNION ALL
    SELECT c.user_id, 'collection_example', l.example_id, '{{"collection_id":' || c.id || '}}'
    FROM v_links l JOIN v_collections c ON l.collection_id = c.id
    WHERE c.user_id IN (SELECT id FROM v_users)
    UNION ALL
    SELECT user_id, 'api_key', id, '{{"prefix":"' || key_prefix || '","created_at":"'
      || {stamp("created_at")} || '"}}' FROM v_api_keys WHERE user_id IN (SELECT id FROM v_users)
    UNION ALL
    SELECT user_id, 'event', id, '{{"event_type":"' || event_type || '","query":'
      || coalesce('"' || query || '"', 'null') || ',"example_id":' || example_id
      || ',"collection_id":' || collection_id || ',"created_at":"' || {stamp("created_at")} || '"}}'
    FROM log"""
SQL["user_erasure"] = """
    WITH gone AS (SELECT id FROM v_users WHERE segment = 'MACHINERY' AND balance < 0),
    kept AS (SELECT id FROM v_collections WHERE user_id NOT IN (SELECT id FROM gone)),
    all_rows AS (
      SELECT 'users' AS table_name, id AS k FROM v_users WHERE id NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'collections', id FROM kept
      UNION ALL SELECT 'links', example_id FROM v_links WHERE collection_id IN (SELECT id FROM kept)
      UNION ALL SELECT 'api_keys', id FROM v_api_keys WHERE user_id NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'events', CASE WHEN user_id NOT IN (SELECT id FROM gone) THEN user_id END
      FROM v_events
      UNION ALL SELECT 'events.collection_id',
        CASE WHEN id NOT IN (SELECT id FROM v_collections) OR id IN (SELECT id FROM kept) THEN id END FROM v_events)
    SELECT table_name, count(*) AS n, count(k) AS filled, CAST(sum(k) AS BIGINT) AS checksum
    FROM all_rows GROUP BY table_name
    UNION ALL SELECT 'events.session_id', count(*), count(session_id) FILTER (user_id NOT IN (SELECT id FROM gone)), NULL
    FROM v_events"""
SQL["delete_collections"] = """
    WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0),
    left_over AS (SELECT collection_id, example_id FROM v_links WHERE collection_id NOT IN (SELECT id FROM gone)),
    all_rows AS (
      SELECT 'collections.id' AS column_name, id AS k FROM v_collections WHERE id NOT IN (SELECT id FROM gone)
      UNION ALL SELECT 'links.collection_id', collection_id FROM left_over
      UNION ALL SELECT 'links.example_id', example_id FROM left_over
      UNION ALL SELECT 'events.collection_id', CASE WHEN id NOT IN (SELECT id FROM gone) THEN id END FROM v_events
      UNION ALL SELECT 'events.example_id', example_id FROM v_events
      UNION ALL SELECT 'events.dataset_id', dataset_id FROM v_events)
    SELECT column_name, count(*) AS n, count(k) AS filled, CAST(sum(k) AS BIGINT) AS checksum
    FROM all_rows GROUP BY column_name"""
SQL["record_events"] = f"""
    WITH r AS (SELECT *, CASE WHEN id % 2 = 1 THEN 'odd' ELSE 'even' END AS name FROM v_events)
    SELECT CAST('0x' || substr(md5(name || '/' || id), 1, 15) AS BIGINT) AS id, CASE WHEN id % 97 <> 0 THEN event_type END AS event_type,
      CASE WHEN regexp_matches(session_id, '^[0-9a-zA-Z\\-_]{{1,100}}$') THEN session_id END AS session_id,
      'user' || user_id || CASE WHEN id % 89 = 0 THEN repeat('x', 100) ELSE '' END AS user_id,
      example_id, collection_id, dataset_id, query, {stamp("created_at")} AS created_at,
      CASE WHEN event_type = 'search' THEN {cycle("id", ("keyword", "semantic", "hybrid", "intelligent"))} END AS search_mode,
      CASE WHEN event_type = 'pick' THEN id % 20 END AS result_position,
      CASE WHEN event_type = 'pick' THEN CAST(example_id AS DOUBLE) / 100 END AS result_score,
      CASE WHEN event_type = 'export' THEN {cycle("id", ("json", "jsonl", "csv", "langfuse"))} END AS export_format,
      CASE WHEN event_type = 'view' THEN '{{"source":"s' || id % 3 || '"}}' END AS event_metadata,
      CASE WHEN id % 97 <> 0 AND id % 89 <> 0 THEN name END AS batch
    FROM r"""
SQL["dataset_stats_record"] = """
    SELECT dataset_id, '{"total_examples":' || CAST(sum(n) AS BIGINT) || ',"splits":{'
      || string_agg('"' || split || '":' || n, ',' ORDER BY split) || '}}' AS stats
    FROM (SELECT dataset_id, split, count(*) AS n FROM v_examples GROUP BY ALL) GROUP BY dataset_id"""
SQL["subject_stats"] = """
    SELECT dataset_id, '{"subjects":{' || coalesce(string_agg('"' || subject || '":' || n, ','
      ORDER BY subject) FILTER (subject IS NOT NULL), '') || '}}' AS stats
    FROM (SELECT dataset_id, subject, count(*) AS n FROM v_examples GROUP BY ALL) GROUP BY dataset_id"""
SQL["dataset_stats_custom"] = f"""
    WITH rows AS ({NORMAL["mmlu"]}),
    s AS (SELECT dataset_id, split, count(*) AS n FROM rows GROUP BY ALL),
    m AS (SELECT dataset_id, m_subject, count(*) AS n FROM rows GROUP BY ALL)
    SELECT a.dataset_id, '{{"total_examples":' || total || ',"splits":{{' || splits
      || '}},"subjects":{{' || subjects || '}}}}' AS stats
    FROM (SELECT dataset_id, CAST(sum(n) AS BIGINT) AS total,
            string_agg('"' || split || '":' || n, ',' ORDER BY split) AS splits
          FROM s GROUP BY dataset_id) a
    JOIN (SELECT dataset_id, string_agg('"' || m_subject || '":' || n, ',' ORDER BY m_subject) AS subjects
          FROM m GROUP BY dataset_id) b ON a.dataset_id = b.dataset_id"""
SQL["validate_parsed"] = """
    WITH checked AS (
      SELECT role = 'system' AS a, turn % 3 = 2 OR length(text) = 0 AS b, turn % 4 = 3 AS c
      FROM conversations)
    SELECT error, count(*) AS n FROM (
      SELECT 'missing dataset_id' AS error FROM checked WHERE a
      UNION ALL SELECT 'question is empty or None' FROM checked WHERE b
      UNION ALL SELECT 'missing split' FROM checked WHERE c
      UNION ALL SELECT 'ok' FROM checked WHERE NOT a AND NOT b AND NOT c) GROUP BY error"""
SQL["ingest_custom"] = """
    SELECT conv_id * 1000 + turn AS pos, CAST(77 AS BIGINT) AS dataset_id, text AS question,
      role AS answer, CASE WHEN conv_id % 3 = 0 THEN 'test' ELSE 'train' END AS split,
      CAST(turn AS VARCHAR) AS turn
    FROM conversations"""

SQL["validate_parser"] = """
    SELECT conv_id * 1000 + turn AS pos, md5(text) AS question_md5,
      CASE (conv_id * 1000 + turn) % 7
        WHEN 0 THEN 'parse_row returned list, expected dict'
        WHEN 1 THEN 'missing keys split' || CASE WHEN text = '' THEN '; question is empty or None' ELSE '' END
        WHEN 2 THEN 'KeyError: ''no such column'''
        WHEN 3 THEN 'question is empty or None'
        ELSE CASE WHEN text = '' THEN 'question is empty or None' END END AS error
    FROM conversations"""

# -- search --------------------------------------------------------------------------------------


def _ilike(query: str) -> str:
    pattern = lit(f"%{query}%")
    return f"(question ILIKE {pattern} OR answer ILIKE {pattern})"


def _matched(requests) -> str:
    parts = []
    for r in requests:
        where = _ilike(r.query)
        if r.dataset_name:
            where += f" AND dataset_name = {lit(r.dataset_name)}"
        if r.subject:
            where += f" AND subject = {lit(r.subject)}"
        if r.task_type:
            where += f" AND task_type = {lit(r.task_type)}"
        parts.append(f"SELECT {lit(r.query_id)} AS query_id, * FROM v_joined WHERE {where}")
    return "\nUNION ALL\n".join(parts)


def _up_to(k: int | None) -> str:
    return "true" if k is None else f"rank <= {k}"


def _keyword(requests, k: int | None = None) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank
      FROM ({_matched(requests)})) WHERE {_up_to(k)}"""


def _semantic(requests, k: int | None = None, threshold: float | None = None, subject: str | None = None) -> str:
    asked = ", ".join(
        f"({lit(r.query_id)}, {r.vec_id}, {lit(r.collection)}, {lit(subject or r.subject)})"
        for r in requests
    )
    least = "" if threshold is None else f"AND score >= {threshold}"
    return f"""SELECT query_id, example_id AS id, score, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, example_id) AS rank
      FROM (SELECT a.query_id, v.example_id, e.subject AS found, a.subject AS wanted,
              round(list_cosine_similarity(v.vector, q.vector), 9) AS score
            FROM (VALUES {asked}) AS a(query_id, vec_id, collection, subject)
            JOIN v_vectors q ON q.example_id = a.vec_id
            JOIN v_vectors v ON v.collection = a.collection
            LEFT JOIN v_examples e ON e.id = v.example_id)
      WHERE (wanted IS NULL OR found = wanted) {least}) WHERE {_up_to(k)}"""


def _fused(requests) -> str:
    """Both whole lists, fused."""
    weights = ", ".join(
        f"({lit(r.query_id)}, CAST({r.keyword_weight} AS DOUBLE), CAST({r.semantic_weight} AS DOUBLE))"
        for r in requests
    )
    return f"""SELECT query_id, id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, pos) AS rank,
        count(*) OVER (PARTITION BY query_id) AS total, src
      FROM (SELECT query_id, id, sum(part ORDER BY src) AS score, min(src) AS src,
              arg_min(rank, src) AS pos
            FROM (SELECT k.query_id, k.id, 0 AS src, k.rank, w.kw / (60 + k.rank) AS part
                  FROM ({_keyword(requests)}) k
                  JOIN (VALUES {weights}) AS w(query_id, kw, sw) ON w.query_id = k.query_id
                  UNION ALL
                  SELECT s.query_id, s.id, 1, s.rank, w.sw / (60 + s.rank)
                  FROM ({_semantic(requests)}) s
                  JOIN (VALUES {weights}) AS w(query_id, kw, sw) ON w.query_id = s.query_id)
            GROUP BY query_id, id)"""


def _payload(rows: str, extra: str) -> str:
    """Hits with the row they show: the whole example from the keyword side, else the payload."""
    return f"""SELECT {extra}, r.id, e.dataset_id, coalesce(d.name, '') AS dataset_name,
        md5(CASE WHEN r.src = 0 THEN e.question ELSE coalesce(substr(e.question, 1, 500), '') END)
          AS question_md5,
        CASE WHEN r.src = 0 THEN e.answer END AS answer
      FROM ({rows}) r LEFT JOIN v_examples e ON e.id = r.id
      LEFT JOIN v_datasets d ON d.id = e.dataset_id"""


_FLAT = "id, dataset_id, dataset_name, md5(question) AS question_md5, answer"
SQL["keyword_search"] = f"SELECT query_id, rank, {_FLAT} FROM ({_keyword(REQUESTS, 20)})"
SQL["keyword_search_filtered"] = f"""
    SELECT {_FLAT} FROM v_joined WHERE {_ilike("ion")} AND dataset_name = 'src3' AND subject = 'fr'
      AND task_type = 'science_qa' ORDER BY id LIMIT 20"""
SQL["keyword_search_newest"] = f"""
    SELECT {_FLAT} FROM v_joined WHERE {_ilike("the ")} ORDER BY created_at DESC, id LIMIT 20"""
SQL["keyword_search_by_dataset"] = f"""
    SELECT {_FLAT} FROM v_joined WHERE {_ilike("the ")}
    ORDER BY dataset_name, question, id LIMIT 20"""
SQL["keyword_page2"] = f"""
    SELECT {_FLAT} FROM v_joined WHERE {_ilike("the ")} ORDER BY id LIMIT 20 OFFSET 20"""
SQL["keyword_total"] = f"""
    WITH m AS ({_matched(REQUESTS)})
    SELECT q.query_id, count(m.id) AS total
    FROM (VALUES {", ".join(f"({lit(r.query_id)})" for r in REQUESTS)}) AS q(query_id)
    LEFT JOIN m ON m.query_id = q.query_id GROUP BY q.query_id"""


def _facets(where: str) -> str:
    return f"""
    WITH f AS (SELECT * FROM v_joined WHERE {where})
    SELECT 'dataset' AS facet, dataset_name AS name, CAST(NULL AS VARCHAR) AS dataset, count(*) AS n
    FROM f GROUP BY dataset_name
    UNION ALL SELECT 'subject', subject, dataset_name, count(*) FROM f WHERE subject IS NOT NULL
      GROUP BY subject, dataset_name
    UNION ALL SELECT 'task_type', task_type, NULL, count(*) FROM f GROUP BY task_type
    UNION ALL SELECT 'total', NULL, NULL, count(*) FROM f"""


SQL["facets"] = _facets("true")
SQL["facets_query"] = _facets(_ilike("ion"))


def _semantic_page(rows: str) -> str:
    return f"""
    SELECT r.query_id, r.rank, r.id, e.dataset_id, coalesce(d.name, '') AS dataset_name,
      md5(coalesce(substr(e.question, 1, 500), '')) AS question_md5, e.subject, e.split,
      round(r.score, 6) AS score
    FROM ({rows}) r LEFT JOIN v_examples e ON e.id = r.id
    LEFT JOIN v_datasets d ON d.id = e.dataset_id"""


SQL["semantic_search"] = _semantic_page(_semantic(REQUESTS, 20))
SQL["semantic_search_threshold"] = _semantic_page(_semantic(REQUESTS, 50, threshold=0.25))
SQL["semantic_search_filtered"] = _semantic_page(_semantic(REQUESTS, 20, subject="en"))
_ASKED = ", ".join(f"({lit(r.query_id)}, {r.vec_id}, {lit(r.collection)})" for r in REQUESTS)
SQL["semantic_metrics"] = f"""
    WITH scored AS (
      SELECT a.query_id, v.example_id, q.vector AS x, v.vector AS y
      FROM (VALUES {_ASKED}) AS a(query_id, vec_id, collection)
      JOIN v_vectors q ON q.example_id = a.vec_id JOIN v_vectors v ON v.collection = a.collection),
    measured AS (
      SELECT query_id, example_id, 'EUCLID' AS metric, round(-list_distance(x, y), 9) AS score FROM scored
      UNION ALL SELECT query_id, example_id, 'DOT', round(list_inner_product(x, y), 9) FROM scored),
    ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY metric, query_id ORDER BY score DESC, example_id) AS rank FROM measured)
    SELECT query_id, example_id, metric, rank,
      round(CASE metric WHEN 'EUCLID' THEN abs(score) ELSE score END, 6) AS score
    FROM ranked WHERE rank <= 10"""
SQL["rrf_fusion"] = """
    WITH items AS (
      SELECT l_partkey AS id, p_brand AS query_id, count(*) AS picks, sum(l_quantity) AS quantity
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    lists AS (
      SELECT query_id, id, 0 AS src,
        row_number() OVER (PARTITION BY query_id ORDER BY picks DESC, id) AS rank FROM items
      UNION ALL
      SELECT query_id, id, 1,
        row_number() OVER (PARTITION BY query_id ORDER BY quantity DESC, id) FROM items),
    scored AS (
      SELECT query_id, id, sum(CASE src WHEN 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END
          / (60 + rank) ORDER BY src) AS score, min(src) AS src, arg_min(rank, src) AS pos
      FROM lists WHERE rank <= 20 GROUP BY query_id, id)
    SELECT query_id, id, round(score, 9) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, pos) AS rank FROM scored"""
SQL["hybrid_search"] = _payload(
    f"SELECT * FROM ({_fused(REQUESTS)}) WHERE rank <= 20",
    "r.query_id, r.rank, round(r.score, 9) AS score, r.total",
)
SQL["hybrid_fallback"] = _payload(
    f"""SELECT query_id, id, rank, score, src, 'hybrid' AS mode FROM ({_fused(REQUESTS[:3])})
      WHERE rank <= 20
      UNION ALL SELECT query_id, id, rank, NULL, 0, 'keyword'
      FROM ({_keyword([type(REQUESTS[0])("q4", "er")], 20)})""",
    "r.query_id, r.rank, r.mode, round(r.score, 9) AS score",
)
SQL["hybrid_deep_page"] = _payload(
    f"SELECT * FROM ({_fused(REQUESTS)}) WHERE rank BETWEEN 251 AND 270",
    "r.query_id, r.rank, round(r.score, 9) AS score, r.total",
)
SQL["fallback_deep_page"] = _payload(
    f"""SELECT query_id, id, rank, score, src, 'hybrid' AS mode FROM ({_fused(REQUESTS[:3])})
      WHERE rank BETWEEN 251 AND 270
      UNION ALL SELECT query_id, id, rank, NULL, 0, 'keyword'
      FROM ({_keyword([type(REQUESTS[0])("q4", "er")], 270)}) WHERE rank > 250""",
    "r.query_id, r.rank, r.mode, round(r.score, 9) AS score",
)
_PARSED = [
    type(REQUESTS[0])("q0", "the ", vec_id=3, collection="emb_0", subject="en"),
    type(REQUESTS[0])("q1", "ion", vec_id=17, collection="emb_1", dataset_name="src3"),
    REQUESTS[2],
]
SQL["assisted_search"] = _payload(
    f"""SELECT query_id, id, src, total, final_rank FROM (
        SELECT f.*, row_number() OVER (
          PARTITION BY query_id ORDER BY CASE WHEN x.id IS NOT NULL THEN -x.id END NULLS LAST, f.rank)
          AS final_rank
        FROM (SELECT query_id, id, rank, src, total FROM ({_fused(_PARSED)}) WHERE rank <= 50) f
        LEFT JOIN (SELECT id FROM v_examples WHERE answer = '1') x ON x.id = f.id)
      WHERE final_rank > 10 AND final_rank <= 20""",
    "r.query_id, r.final_rank, r.total",
)


def _passes(offset: int = 0) -> str:
    kw, sem, hyb = (p.request for p in PASSES)
    n = 50 + offset
    return f"""
      SELECT 0 AS pass_no, id, CAST(NULL AS DOUBLE) AS score, rank, 0 AS src FROM ({_keyword([kw], n)})
      UNION ALL SELECT 1, id, score, rank, 1 FROM ({_semantic([sem], n)})
      UNION ALL SELECT 2, id, score, rank, src FROM ({_fused([hyb])}) WHERE rank <= {n}"""


def _merged_passes(limit: int, offset: int = 0) -> str:
    return _payload(
        f"""SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, pass_no, rank) AS position,
          count(*) OVER () AS total
        FROM (SELECT * FROM ({_passes(offset)})
              QUALIFY row_number() OVER (PARTITION BY id ORDER BY pass_no, rank) = 1)
        QUALIFY position > {offset} AND position <= {offset + limit}""",
        "r.position, CAST(r.pass_no AS BIGINT) AS pass_no, round(r.score, 6) AS score, r.total",
    )


SQL["multi_pass_merge"] = _merged_passes(20)
SQL["multi_pass_page2"] = _merged_passes(20, 20)
SQL["pass_trace"] = f"""
    SELECT CAST(t.pass_no AS BIGINT) AS pass_no, t.tool, t.query, count(h.id) AS result_count,
      CASE WHEN count(h.id) > 0 THEN 'score=5/10 — LLM evaluation unavailable.'
        ELSE 'score=0/10 — LLM evaluation unavailable.' END AS evaluation
    FROM (VALUES {", ".join(f"({i}, {lit(p.tool)}, {lit(p.request.query)})" for i, p in enumerate(PASSES))})
      AS t(pass_no, tool, query)
    LEFT JOIN ({_passes()}) h ON h.pass_no = t.pass_no GROUP BY ALL"""
SQL["apply_ranking"] = f"""
    SELECT r.query_id, r.id, r.rank, row_number() OVER (PARTITION BY r.query_id
      ORDER BY CASE WHEN x.id IS NOT NULL THEN -x.id END NULLS LAST, r.rank) AS final_rank
    FROM ({_keyword(REQUESTS, 50)}) r
    LEFT JOIN (SELECT id FROM v_examples WHERE answer = '1') x ON x.id = r.id"""


def _strip(column: str) -> str:
    for pattern in INJECTION_PATTERNS:
        column = f"regexp_replace({column}, {lit(pattern)}, {lit(STRIPPED)}, 'gi')"
    return column


# The same code points written in the other engine's escape notation.
_CONTROL = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", CONTROL_CHARS)


def _control(column: str) -> str:
    return f"regexp_replace({column}, {lit(_CONTROL)}, '', 'g')"


def _snippet(column: str, chars: int) -> str:
    return _strip(_control(f"substr(coalesce({column}, ''), 1, {chars})"))


def _candidates(rows: int, chars: int, answer: bool) -> str:
    shown = f"{_snippet('answer', chars)} AS answer," if answer else ""
    return f"""
    SELECT query_id, rank, id, {_snippet("question", chars)} AS question, {shown}
      dataset_name AS dataset, {_strip(_control("coalesce(subject, '')"))} AS subject
    FROM ({_keyword(REQUESTS, 60)}) WHERE rank <= {rows}"""


SQL["rank_candidates"] = _candidates(50, 120, True)
SQL["evaluate_candidates"] = _candidates(40, 100, False)
SQL["embedding_payload"] = """
    SELECT id, dataset_id, dataset_name, substr(question, 1, 500) AS question, subject, split
    FROM v_joined"""

# -- counting ------------------------------------------------------------------------------------

SQL["dataset_counts"] = """
    SELECT d.id, d.name, d.task_type, count(e.id) AS example_count
    FROM v_datasets d LEFT JOIN v_examples e ON e.dataset_id = d.id GROUP BY ALL"""
SQL["dataset_subjects"] = """
    SELECT dataset_id, subject, count(*) AS n FROM v_examples WHERE subject IS NOT NULL GROUP BY ALL"""


def _stats(scope: str, queries: bool) -> str:
    out = f"""
    WITH e AS (SELECT * FROM v_events {scope})
    SELECT 'total' AS stat, CAST(NULL AS VARCHAR) AS key, count(*) AS n FROM e
    UNION ALL SELECT 'type', event_type, count(*) FROM e GROUP BY event_type
    UNION ALL SELECT 'pick', CAST(example_id AS VARCHAR), n FROM (
      SELECT example_id, count(*) AS n FROM e WHERE event_type = 'pick' AND example_id IS NOT NULL
      GROUP BY example_id ORDER BY n DESC, example_id LIMIT 10)"""
    if queries:
        out += """
    UNION ALL SELECT 'query', query, n FROM (
      SELECT query, count(*) AS n FROM e WHERE event_type = 'search' AND query IS NOT NULL
      GROUP BY query ORDER BY n DESC, query LIMIT 10)"""
    return out


SQL["event_stats_global"] = _stats("", False)
SQL["event_stats_user"] = _stats("WHERE user_id = 42", True)
SQL["top_queries"] = """
    SELECT user_id, query, n, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, query) AS rank
      FROM (SELECT user_id, query, count(*) AS n FROM v_events
            WHERE event_type = 'search' AND query IS NOT NULL GROUP BY ALL)) WHERE rank <= 10"""
SQL["pick_counts"] = """
    SELECT c.id, count(p.example_id) AS pick_count
    FROM v_catalog c LEFT JOIN v_picks p ON p.example_id = c.id GROUP BY c.id"""
SQL["popular_examples"] = """
    SELECT example_id, count(*) AS pick_count FROM v_picks GROUP BY example_id
    ORDER BY pick_count DESC, example_id LIMIT 20"""
SQL["co_picked"] = """
    SELECT example_id, count(*) AS co_pick_count FROM v_picks
    WHERE example_id <> 155
      AND collection_id IN (SELECT collection_id FROM v_picks WHERE example_id = 155)
    GROUP BY example_id ORDER BY co_pick_count DESC, example_id LIMIT 10"""
SQL["co_picked_popular"] = """
    WITH anchors AS (SELECT example_id FROM v_picks GROUP BY example_id
      ORDER BY count(*) DESC, example_id LIMIT 10),
    holding AS (SELECT DISTINCT collection_id, example_id AS anchor_id FROM v_picks
      WHERE example_id IN (SELECT example_id FROM anchors))
    SELECT * FROM (
      SELECT anchor_id, example_id, co_pick_count, row_number() OVER (
        PARTITION BY anchor_id ORDER BY co_pick_count DESC, example_id) AS rank
      FROM (SELECT h.anchor_id, p.example_id, count(*) AS co_pick_count
            FROM v_picks p JOIN holding h ON h.collection_id = p.collection_id
            WHERE p.example_id <> h.anchor_id GROUP BY ALL)) WHERE rank <= 10"""
_TIER = """CASE WHEN tier = 'free' AND trial_ends_at > TIMESTAMP '2024-01-10' THEN 'ultra'
      ELSE tier END"""
SQL["effective_tier"] = f"SELECT id, tier, {_TIER} AS effective_tier FROM v_users"
SQL["limit_audit"] = f"""
    WITH t AS (SELECT id AS user_id, {_TIER} AS tier FROM v_users),
    usage AS (
      SELECT user_id, user_id AS subject_id, count(*) AS used, 'max_collections' AS limit_name
      FROM v_collections GROUP BY user_id
      UNION ALL SELECT c.user_id, c.id, count(*), 'max_examples_per_collection'
      FROM v_collections c JOIN v_links l ON l.collection_id = c.id GROUP BY c.user_id, c.id
      UNION ALL SELECT user_id, user_id, count(*), 'max_api_keys' FROM v_api_keys WHERE is_active
      GROUP BY user_id),
    limits(tier, limit_name, allowed) AS (VALUES
      ('free', 'max_collections', 10), ('free', 'max_examples_per_collection', 1000),
      ('free', 'max_api_keys', 1), ('pro', 'max_collections', -1),
      ('pro', 'max_examples_per_collection', -1), ('pro', 'max_api_keys', 10),
      ('ultra', 'max_collections', -1), ('ultra', 'max_examples_per_collection', -1),
      ('ultra', 'max_api_keys', 10))
    SELECT u.user_id, t.tier, u.limit_name, u.subject_id, u.used, CAST(l.allowed AS BIGINT) AS allowed,
      l.allowed <> -1 AND u.used >= l.allowed AS at_limit,
      l.allowed <> -1 AND u.used > l.allowed AS over
    FROM usage u JOIN t ON t.user_id = u.user_id
    JOIN limits l ON l.tier = t.tier AND l.limit_name = u.limit_name"""

# -- curation ------------------------------------------------------------------------------------


def _listed(where: str) -> str:
    return f"""
    SELECT c.id, c.name, c.description, c.user_id, {stamp("c.created_at")} AS created_at,
      count(l.example_id) AS example_count
    FROM v_collections c LEFT JOIN v_links l ON l.collection_id = c.id {where} GROUP BY ALL"""


SQL["list_collections"] = _listed("")
SQL["list_collections_owner"] = _listed("WHERE c.user_id = 42")
SQL["collection_contents"] = f"""
    SELECT l.example_id, l.collection_id, {stamp("l.added_at")} AS added_at, c.question, c.dataset,
      c.task_type FROM v_links l JOIN v_catalog c ON c.id = l.example_id"""
SQL["collection_datasets"] = """
    SELECT DISTINCT l.collection_id, c.dataset FROM v_links l JOIN v_catalog c ON c.id = l.example_id"""
VIEWS["v_requests"] = """
    SELECT l_orderkey AS collection_id, l_partkey AS example_id FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT o_orderkey, o_custkey % 2500 FROM orders
    UNION ALL SELECT o_orderkey, o_custkey % 2500 FROM orders
    UNION ALL SELECT o_orderkey, -1 - o_custkey FROM orders"""
VIEWS["v_classified"] = """
    SELECT r.collection_id, r.example_id, r.times, CAST(substr(c.dataset, 7) AS BIGINT) AS dataset_id,
      CASE WHEN l.example_id IS NOT NULL THEN 'present' WHEN c.id IS NOT NULL THEN 'added'
        ELSE 'not_found' END AS outcome
    FROM (SELECT collection_id, example_id, count(*) AS times FROM v_requests GROUP BY ALL) r
    LEFT JOIN v_links l ON l.collection_id = r.collection_id AND l.example_id = r.example_id
    LEFT JOIN v_catalog c ON c.id = r.example_id"""
SQL["add_examples"] = """
    SELECT collection_id, count(*) FILTER (outcome = 'added') AS added,
      CAST(sum(CASE outcome WHEN 'present' THEN times WHEN 'added' THEN times - 1 ELSE 0 END) AS BIGINT)
        AS skipped_duplicates,
      CAST(sum(CASE outcome WHEN 'not_found' THEN times ELSE 0 END) AS BIGINT) AS not_found
    FROM v_classified GROUP BY collection_id"""
SQL["pick_events"] = """
    SELECT 'pick' AS event_type, collection_id, example_id, dataset_id FROM v_classified
    WHERE outcome = 'added'"""
VIEWS["v_removals"] = """
    SELECT DISTINCT l_orderkey AS collection_id, l_partkey + l_linenumber % 2 AS example_id
    FROM lineitem WHERE l_returnflag = 'R'"""
SQL["bulk_remove"] = """
    SELECT l.collection_id, l.example_id FROM v_links l ANTI JOIN v_removals r
    ON r.collection_id = l.collection_id AND r.example_id = l.example_id"""
SQL["remove_events"] = """
    SELECT 'remove' AS event_type, l.collection_id, l.example_id FROM v_links l SEMI JOIN v_removals r
    ON r.collection_id = l.collection_id AND r.example_id = l.example_id"""
SQL["update_collections"] = """
    SELECT o_orderkey AS id,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent ' || o_orderkey
        ELSE 'order ' || o_orderkey END AS name,
      CASE WHEN o_orderpriority < '3' THEN o_orderpriority END AS description, o_custkey AS user_id
    FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT -1 - s_suppkey, s_name, 'created', s_suppkey FROM supplier"""

# -- text guards and model answers ---------------------------------------------------------------


def _sql_pattern(pattern: str) -> tuple[str, str]:
    """The pattern without its inline flags, and the flags for the SQL function."""
    return (pattern[6:], "gi") if pattern.startswith("(?iuU)") else (pattern, "g")


def _replace_all(column: str, patterns, shape: str) -> str:
    for name, pattern in patterns:
        body, flags = _sql_pattern(pattern)
        column = f"regexp_replace({column}, {lit(body)}, {lit(shape.format(name=name))}, '{flags}')"
    return column


def _guarded(expr: str) -> str:
    return f"""
    SELECT kind, text_id, md5(out) AS out_md5, length(out) AS chars
    FROM (SELECT kind, text_id, {expr} AS out FROM v_texts)"""


SQL["strip_injections"] = _guarded(_strip("text"))
SQL["strip_unicode_control"] = _guarded(_control("text"))
SQL["sanitize_literal"] = _guarded(_strip(_control("text")))
_MARKED = (
    f"replace(replace(text, {lit(BOUNDARY_CLOSE)}, {lit(BOUNDARY_STRIPPED)}), "
    f"{lit(BOUNDARY_OPEN)}, {lit(BOUNDARY_STRIPPED)})"
)
SQL["wrap_untrusted"] = f"""
    SELECT kind, text_id, md5(out) AS out_md5, length(out) AS chars FROM (
      SELECT kind, text_id, {lit(BOUNDARY_OPEN + " source=data_row>>>")} || chr(10)
        || CASE WHEN length(body) > {MAX_WRAPPED_CHARS}
             THEN left(body, {MAX_WRAPPED_CHARS}) || chr(10) || '[TRUNCATED]' ELSE body END
        || chr(10) || {lit(BOUNDARY_CLOSE)} AS out
      FROM (SELECT kind, text_id, {_control(_strip(_MARKED))} AS body FROM v_texts))"""
SQL["redact_secrets"] = _guarded(_replace_all("text", CREDENTIAL_PATTERNS, "[REDACTED:{name}]"))
_ANY_SECRET = " OR ".join(
    f"regexp_matches(text, {lit(_sql_pattern(p)[0])}, '{_sql_pattern(p)[1][1:] or 'c'}')"
    for _, p in CREDENTIAL_PATTERNS
)
SQL["sanitize_errors"] = f"""
    SELECT kind, text_id, md5(out) AS out_md5, length(out) AS chars FROM (
      SELECT kind, text_id, CASE WHEN {_ANY_SECRET} THEN {lit(GENERIC_ERROR)}
        WHEN length(body) > {ERROR_CHARS} THEN left(body, {ERROR_CHARS}) || '...' ELSE body END AS out
      FROM (SELECT kind, text_id, text, {_replace_all("text", INFRA_PATTERNS, "[{name}]")} AS body
            FROM v_texts))"""


def _findings() -> str:
    parts = []
    kinds = [("credential", CREDENTIAL_PATTERNS, CREDENTIAL_SHOWN), ("infra", INFRA_PATTERNS, INFRA_SHOWN)]
    for kind, patterns, shown in kinds:
        for name, pattern in patterns:
            body, flags = _sql_pattern(pattern)
            option = "i" if "i" in flags else "c"
            parts.append(
                f"SELECT kind, text_id, '{kind}:{name}' AS type, left(unnest(regexp_extract_all("
                f"text, {lit(body)}, 0, '{option}')), {shown}) || '...' AS match FROM v_texts"
            )
    return "\nUNION ALL\n".join(parts)


SQL["leak_scan"] = _findings()
SQL["leak_summary"] = f"""
    SELECT kind, type, count(*) AS n FROM ({_findings()}) GROUP BY kind, type"""


def _member(name: str) -> str:
    return f"json_extract_string(j, '$.{name}')"


def _default_text(name: str, fallback: str) -> str:
    return f"CASE WHEN ok THEN CASE WHEN json_exists(j, '$.{name}') THEN {_member(name)} ELSE '' END ELSE {lit(fallback)} END"


SQL["parse_model_json"] = f"""
    SELECT doc_id, CASE WHEN ok THEN coalesce(nullif({_member("search_query")}, ''), original)
        ELSE original END AS search_query,
      CASE WHEN ok THEN {_member("dataset")} END AS dataset,
      CASE WHEN ok THEN {_member("subject")} END AS subject,
      CASE WHEN ok THEN {_member("task_type")} END AS task_type,
      {_default_text("explanation", "Fallback: LLM call failed or returned invalid response.")} AS explanation
    FROM (SELECT *, coalesce(json_exists(j, '$.search_query'), false) AS ok FROM v_parsed)"""
SQL["parse_rank_json"] = f"""
    SELECT doc_id, CASE WHEN ok THEN array_to_string(ids, ',') ELSE '' END AS ranked_ids,
      {_default_text("explanation", "")} AS explanation
    FROM (SELECT *, coalesce(json_exists(j, '$.ranked_ids')
            AND len(list_filter(ids, lambda x: TRY_CAST(x AS BIGINT) IS NULL)) = 0, false) AS ok
          FROM (SELECT *, CAST(json_extract(j, '$.ranked_ids') AS VARCHAR[]) AS ids FROM v_parsed))"""
SQL["parse_plan_json"] = f"""
    SELECT doc_id, CASE WHEN ok THEN {_member("tool")} ELSE 'hybrid_search' END AS tool,
      CASE WHEN ok THEN coalesce(nullif({_member("search_query")}, ''), original)
        ELSE original END AS search_query,
      CASE WHEN ok THEN {_member("dataset")} END AS dataset,
      CASE WHEN ok THEN {_member("subject")} END AS subject,
      {_default_text("rationale", "Fallback: LLM call failed.")} AS rationale,
      CASE WHEN coalesce(json_exists(j, '$.relevance_score'), false)
        THEN 'score=' || {_member("relevance_score")} || '/10 — '
          || CASE WHEN json_exists(j, '$.assessment') THEN {_member("assessment")} ELSE '' END
        WHEN doc_id % 2 > 0 THEN 'score=5/10 — LLM evaluation unavailable.'
        ELSE 'score=0/10 — LLM evaluation unavailable.' END AS evaluation
    FROM (SELECT *, coalesce(json_exists(j, '$.tool'), false) AS ok FROM v_parsed)"""

# -- ordered and stateful jobs -------------------------------------------------------------------

VIEWS["v_subscriptions"] = f"""
    SELECT event_id, ts, {cycle("event_id", ("created", "updated", "canceled", "revoked", "trial_ended"))} AS kind,
      CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'nobody@example.com'
        ELSE 'user' || user_id || '@example.com' END AS email,
      CASE WHEN event_id % 3 = 0 THEN '' ELSE 'cus_' || user_id END AS customer_id,
      'sub_' || event_id AS subscription_id,
      {cycle("event_id", ("active", "trialing", "past_due", "canceled"))} AS status,
      CASE WHEN event_type = 'view' THEN 'ultra' ELSE 'pro' END AS product
    FROM events"""
SQL["subscription_fold"] = f"""
    WITH m AS (
      SELECT s.*, coalesce(a.id, b.id) AS user_id, kind IN ('created', 'updated') AS starts,
        kind IN ('canceled', 'revoked') AS ends, status IN ('active', 'trialing') AS live
      FROM v_subscriptions s LEFT JOIN v_users a ON a.customer_id = s.customer_id
      LEFT JOIN v_users b ON b.email = s.email
      WHERE s.email <> '' AND coalesce(a.id, b.id) IS NOT NULL AND kind <> 'trial_ended'),
    f AS (
      SELECT user_id, count(*) AS applied,
        last(CASE WHEN ends THEN 'free' ELSE product END ORDER BY ts, event_id)
          FILTER (ends OR (starts AND live)) AS tier,
        bool_or(starts AND live) AS superseded, last(status ORDER BY ts, event_id) AS status,
        last(customer_id ORDER BY ts, event_id) FILTER (starts) AS customer_id,
        last(subscription_id ORDER BY ts, event_id) FILTER (starts) AS subscription_id
      FROM m GROUP BY user_id)
    SELECT u.id, coalesce(f.tier, u.tier) AS tier,
      CASE WHEN NOT coalesce(f.superseded, false) THEN {stamp("u.trial_ends_at")} END AS trial_ends_at,
      coalesce(f.customer_id, u.customer_id) AS customer_id, f.subscription_id,
      f.status AS subscription_status, coalesce(f.applied, 0) AS applied
    FROM v_users u LEFT JOIN f ON f.user_id = u.id"""
SQL["list_examples_after"] = """
    SELECT CAST((n - 1) // 15 AS BIGINT) AS page, id, dataset_id, subject, md5(question) AS question
    FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM v_examples WHERE dataset_id = 3) WHERE n <= 45"""
SQL["subscription_stream"] = SQL["subscription_fold"]
SQL["admission_replay"] = f"""
    WITH RECURSIVE calls AS (
      SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
      FROM events),
    recursive_log AS (
      SELECT user_id, event_id, n, [ts] AS log, true AS admitted FROM calls WHERE n = 1
      UNION ALL
      SELECT c.user_id, c.event_id, c.n,
        CASE WHEN len(list_filter(r.log, lambda t: t > c.ts - INTERVAL 1 DAY)) < {DAILY_CALLS}
          THEN list_append(list_filter(r.log, lambda t: t > c.ts - INTERVAL 1 DAY), c.ts)
          ELSE list_filter(r.log, lambda t: t > c.ts - INTERVAL 1 DAY) END,
        len(list_filter(r.log, lambda t: t > c.ts - INTERVAL 1 DAY)) < {DAILY_CALLS}
      FROM recursive_log r JOIN calls c ON c.user_id = r.user_id AND c.n = r.n + 1)
    SELECT user_id, event_id, admitted FROM recursive_log"""
SQL["quota_replay"] = f"""
    WITH RECURSIVE calls AS (
      SELECT e.user_id, e.event_id, e.ts, CASE WHEN e.event_type = 'view' THEN 0 ELSE 1 END AS kind,
        CASE WHEN u.tier = 'ultra' THEN -1 WHEN u.tier = 'free' AND e.event_type <> 'view' THEN 0
          ELSE {DAILY_CALLS} END AS allowed, u.quota_reset_at,
        row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS n
      FROM events e JOIN v_users u ON u.id = e.user_id),
    recursive_days AS (
      SELECT user_id, event_id, kind, allowed, n, ts,
        CASE WHEN quota_reset_at <= ts THEN ts + INTERVAL 1 DAY ELSE quota_reset_at END AS reset_at
      FROM calls WHERE n = 1
      UNION ALL
      SELECT c.user_id, c.event_id, c.kind, c.allowed, c.n, c.ts,
        CASE WHEN r.reset_at <= c.ts THEN c.ts + INTERVAL 1 DAY ELSE r.reset_at END
      FROM recursive_days r JOIN calls c ON c.user_id = r.user_id AND c.n = r.n + 1)
    SELECT user_id, event_id, allowed = -1 OR row_number() OVER (
      PARTITION BY user_id, reset_at, kind ORDER BY ts, event_id) <= allowed AS admitted
    FROM recursive_days"""
SQL["admission_stream"] = SQL["admission_replay"]
SQL["quota_stream"] = SQL["quota_replay"]
SQL["stream_event_counts"] = """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type,
      count(*) AS n FROM events GROUP BY ALL"""

ORACLE_SQL: dict[str, str] = {name: _with(sql) for name, sql in SQL.items()}
