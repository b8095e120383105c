"""Inputs derived from the given tables.

The texts are SQL that Spark and DuckDB read alike, so both engines start from the same rows.
``{name}`` stands for a given table or another view.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    # Question/answer rows: a user turn and the assistant turn after it.
    "qa": """
        SELECT u.conv_id * 1000 + u.turn AS task_id, d.lang || ' ' || d.source AS context,
               u.text AS question, a.text AS answer, d.lang AS split
        FROM {conversations} u
        JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        JOIN {documents} d ON d.doc_id = u.conv_id
        WHERE u.role = 'user'""",
    # Free-text generation answers around whole documents.
    "responses": """
        SELECT doc_id AS task_id, source AS model, lang AS split,
          CASE doc_id % 9
            WHEN 0 THEN text || chr(10) || '```sql' || chr(10) || ' SELECT ' || n_chars || ' FROM docs WHERE id = ' || doc_id
                        || ';' || chr(10) || '```' || chr(10) || 'done'
            WHEN 1 THEN text || '``` select a from t' || doc_id || chr(10) || '``` and ```tail'
            WHEN 2 THEN '```a``` ' || text || ' ```select b from t' || doc_id || '``` end'
            WHEN 3 THEN text || chr(10) || '```SQL' || chr(10) || 'SELECT c FROM t' || doc_id || chr(10) || '```'
            WHEN 4 THEN text || ' so Select x from t' || doc_id || '; the tail ' || lang
            WHEN 5 THEN text || chr(10) || 'select y' || chr(10) || 'from t' || doc_id || chr(10)
            WHEN 6 THEN CASE WHEN doc_id % 2 = 0 THEN '{"gen_sql": "VALUES (' || doc_id || ')", "reasoning": "short"}'
                        ELSE '{"gen_sql": "SELECT ' || doc_id || '", "description": "one row"}' END
            WHEN 7 THEN text
            ELSE CASE WHEN doc_id % 18 = 8 THEN '' ELSE text || chr(10) || '```sql ``` SELECT ' || doc_id END
          END AS content
        FROM {documents}""",
    # Verdict answers in many forms around whole documents.
    "verdicts": """
        SELECT task_id, model, split, yn AS truth,
          CASE task_id % 8
            WHEN 0 THEN '{"resolve_yn": " ' || upper(yn) || ' "}'
            WHEN 1 THEN text || ' ```json' || chr(10) || '{"resolve_yn":"' || yn || '"}' || chr(10) || '``` yes'
            WHEN 2 THEN text || ' {' || chr(39) || 'resolve_yn' || chr(39) || ': ' || chr(39) || yn || chr(39) || '}'
            WHEN 3 THEN text || ' Resolve_YN : ' || yn
            WHEN 4 THEN 'The answer is ' || yn || '. ' || text
            WHEN 5 THEN CASE WHEN yn = 'yes' THEN 'Yes, same. ' ELSE 'not sure. ' END || text
            WHEN 6 THEN text
            ELSE 'none ' || text
          END AS content
        FROM (
          SELECT l.doc_id AS task_id, d.source AS model, d.lang AS split, d.text,
                 CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS yn
          FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id
        ) x""",
    # One row per model call; three calls belong to a task.
    "attempts": """
        SELECT event_id, CAST(floor(event_id / 3) AS BIGINT) AS task_id, event_id % 3 + 1 AS attempt,
               'm' || (floor_user % 6) AS model, ts, ts AS start_ts, ts AS end_ts, tokens, error, api_error,
               error IS NULL AND api_error IS NULL AS ok
        FROM (
          SELECT event_id, user_id AS floor_user, ts, CAST(floor(value) AS BIGINT) AS tokens,
            CASE WHEN event_type = 'error' THEN
              CASE event_id % 5 WHEN 0 THEN 'Rate limit reached' WHEN 1 THEN 'code rate_limit_exceeded'
                WHEN 2 THEN 'HTTP error 500: overloaded' ELSE 'TimeoutError ' || props END
            END AS error,
            CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN
              CASE WHEN event_id % 2 = 0 THEN 'Rate limit hit' ELSE 'bad request ' || props END
            END AS api_error
          FROM {events}
        ) x""",
    # Run statistics.
    "runs": """
        SELECT o_orderkey AS run_id, o_orderdate AS timestamp,
               CASE WHEN o_orderkey % 97 <> 0 THEN o_orderpriority END AS tested_model,
               'judge' || (o_custkey % 4) AS evaluator_model, o_orderstatus AS test_dataset,
               o_custkey AS test_size, o_custkey % 50 AS successful_count,
               CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice % 100 END AS accuracy,
               CAST(o_orderkey % 7 AS DOUBLE) AS avg_processing_time,
               CAST(o_custkey % 11 AS DOUBLE) AS batch_throughput
        FROM {orders}""",
    # Latency tests; every tenth one has no load time.
    "tests": """
        SELECT 'model-' || user_id AS model, CAST(event_id + 1 AS BIGINT) AS test_no,
               CASE WHEN event_id % 10 <> 0 THEN value / 7 END AS load_s, value / 3 AS first_token_s,
               value / 3 + 1 AS total_s, CAST(floor(value * 3) AS BIGINT) AS tokens,
               CAST(floor(value * 2) AS DOUBLE) AS tokens_per_s
        FROM {events}""",
    # SQL texts with one dialect marker each, and the dialects an external checker accepts.
    "sqls": """
        SELECT p_partkey AS id, p_name,
          CASE p_partkey % 14
            WHEN 0 THEN 'SELECT * FROM t LIMIT 5, ' || p_partkey
            WHEN 1 THEN 'SELECT IFNULL (a, 0) FROM t'
            WHEN 2 THEN 'SELECT `' || p_brand || '`, `a` FROM t'
            WHEN 3 THEN 'SELECT a FROM t WHERE b ILIKE ' || chr(39) || p_name || chr(39)
            WHEN 4 THEN 'SELECT ' || chr(39) || p_name || chr(39) || '::text'
            WHEN 5 THEN 'INSERT INTO t VALUES (1) RETURNING id'
            WHEN 6 THEN 'PRAGMA table_info(t)'
            WHEN 7 THEN 'SELECT rowid FROM t'
            WHEN 8 THEN 'SELECT TOP 5 * FROM t WHERE name = ' || chr(39) || p_name || chr(39)
            WHEN 9 THEN 'SELECT ISNULL(a, 0), [b c] FROM t'
            WHEN 10 THEN 'SELECT x FROM dual WHERE ROWNUM < 5'
            WHEN 11 THEN 'SELECT NVL(a, 0), [b] FROM t'
            WHEN 12 THEN 'SELECT [a] FROM dual WHERE b ILIKE c OFFSET ' || p_size
            ELSE 'SELECT ' || p_size
          END AS sql,
          CASE p_size % 5
            WHEN 0 THEN '' WHEN 1 THEN 'MySQL,SQLite' WHEN 2 THEN 'Oracle'
            WHEN 3 THEN 'MySQL,Oracle,PostgreSQL,SQL Server,SQLite' ELSE 'PostgreSQL,SQL Server'
          END AS candidates
        FROM {part}""",
    # Prompt/completion rows, some of them in no known form.
    "prompts": """
        SELECT conv_id * 1000 + turn AS id, role,
          CASE (conv_id + turn) % 6
            WHEN 0 THEN 'question: ' || text || ' metadata: ```' || chr(10) || role || ' DDL' || chr(10) || '``` '
            WHEN 1 THEN 'question: short ' || role || ' metadata:  ' || text || chr(10)
            WHEN 2 THEN 'metadata: ' || role || ' question: ' || text
            WHEN 3 THEN text
            WHEN 4 THEN 'question: ' || text
            ELSE 'Intro. question: ' || text || ' metadata: ```sql' || chr(10) || text || '``` and ``` end'
          END AS prompt,
          '  SELECT ' || turn || ' FROM t LIMIT ' || conv_id || ', ' || turn || chr(10) AS completion
        FROM {conversations}""",
    # Model names as they occur in run configurations.
    "models": """
        SELECT event_id,
          CASE event_id % 10
            WHEN 0 THEN 'gemma3:27b' WHEN 1 THEN 'qwen2.5-coder:7b' WHEN 2 THEN 'GPT-4o' WHEN 3 THEN 'o1-mini'
            WHEN 4 THEN 'sqlcoder:70b' WHEN 5 THEN 'phi4:14b' WHEN 6 THEN 'tulu3:8b' WHEN 7 THEN 'o3-' || user_id
            WHEN 8 THEN 'llama:' || (user_id % 80) || 'b-' || event_type ELSE 'nul'
          END AS model, event_type
        FROM {events}""",
    # Request URLs around the given page URLs.
    "urls": """
        SELECT page_id, url AS page_url,
          CASE page_id % 6
            WHEN 0 THEN 'https://h' || page_id || '.example/openai/deployments/d' || page_id || '/chat/completions?api=1'
            WHEN 1 THEN 'https://api.example/v' || page_id || '/embeddings'
            WHEN 2 THEN 'http://localhost:' || (8000 + page_id) || '/api/generate'
            WHEN 3 THEN 'http://localhost/api/generate'
            WHEN 4 THEN 'http://10.0.0.1:11434/api/chat'
            ELSE url
          END AS url
        FROM {pages}""",
}

#: Calls up to the one that ends a task: a refused request is not repeated. ``slice`` cuts the month into four.
VIEWS["calls"] = f"""
        SELECT event_id, task_id, attempt, model, ts, start_ts, end_ts, error, api_error, ok, final,
               CAST(floor((day(ts) - 1) / 8) AS INT) AS slice
        FROM (
          SELECT b.*, sum(CASE WHEN ok OR final THEN 1 ELSE 0 END)
            OVER (PARTITION BY task_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_before
          FROM (SELECT a.*, coalesce(api_error LIKE 'bad request%', false) AS final FROM ({VIEWS['attempts']}) a) b
        ) c
        WHERE coalesce(over_before, 0) = 0"""


def _names(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z]+)\}", sql)))


def duckdb_text(sql: str) -> str:
    """SQL with the placeholders resolved for DuckDB, where the given tables are views."""
    for name in _names(sql):
        if name in VIEWS:
            sql = sql.replace("{" + name + "}", f"({duckdb_text(VIEWS[name])})")
        elif name in TABLES:
            sql = sql.replace("{" + name + "}", name)
    return sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A view over the given DataFrames (also streaming ones)."""
    sql, made = VIEWS[name], []
    for t, df in tables.items():
        alias = f"{t}_{uuid.uuid4().hex}"
        df.createTempView(alias)
        made.append(alias)
        sql = sql.replace("{" + t + "}", alias)
    try:
        return spark.sql(sql)
    finally:
        for alias in made:
            spark.catalog.dropTempView(alias)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return derive(spark, name, {t: table(spark, sf_dir, t) for t in _names(VIEWS[name]) if t in TABLES})
