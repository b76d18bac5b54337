"""Registration of queries: a function of (spark, folder of tables) and, where SQL can express it, the SQL for its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Words taken as known, and words ranked as goals after them, where a query derives both from the corpus.
KNOWN, GOALS = 300, 3000

#: The corpus in SQL: sentences, their distinct units, unit counts, known words, goals and unknown counts.
CORPUS = rf"""
WITH parts AS (SELECT doc_id, source, lang, regexp_split_to_array(text, '[.!?\n]+') AS p FROM documents),
cut AS (SELECT doc_id, source, lang, unnest(p) AS part, generate_subscripts(p, 1) AS pos FROM parts),
sent AS (SELECT doc_id * 1000000 + pos AS sentence_id, doc_id AS video_id, source AS channel, lang AS language, trim(part) AS text FROM cut WHERE trim(part) <> ''),
toks AS (SELECT sentence_id, video_id, channel, string_split(lower(text), ' ') AS t FROM sent),
spread AS (SELECT sentence_id, video_id, channel, unnest(t) AS key FROM toks),
unit AS (SELECT DISTINCT sentence_id, video_id, channel, key FROM spread WHERE key <> ''),
cnt AS (SELECT key, count(*) AS said FROM unit GROUP BY key),
ranked AS (SELECT key, said, row_number() OVER (ORDER BY said DESC, key) AS rn FROM cnt),
known AS (SELECT key FROM ranked WHERE rn <= {KNOWN}),
goals AS (SELECT key, rn - {KNOWN + 1} AS rank FROM ranked WHERE rn > {KNOWN} AND rn <= {KNOWN + GOALS}),
gap AS (SELECT u.sentence_id, u.video_id, u.channel, count(*) AS units, count(*) FILTER (WHERE k.key IS NULL) AS unknown,
               min(u.key) FILTER (WHERE k.key IS NULL) AS lo, max(u.key) FILTER (WHERE k.key IS NULL) AS hi
        FROM unit u LEFT JOIN known k USING (key) GROUP BY ALL)
"""


def query(name: str, sql: str | None = None, corpus: bool = False):
    """Register the decorated function under name; `corpus` puts the corpus's SQL before its own."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = CORPUS + sql if corpus else sql
        return f

    return add
