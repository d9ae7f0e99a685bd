"""The registry of queries, and the SQL of the relations they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEG = r"""c AS (SELECT *, CASE WHEN text IS NULL OR trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(text), '\s+')) END AS n_words FROM conversations),
t AS (SELECT *, sum(n_words) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM c),
seg AS (SELECT conv_id AS meeting_id, turn AS seg_idx, n_words::BIGINT AS n_words, (t - n_words) * 0.4::DOUBLE AS start_s, t * 0.4::DOUBLE AS end_s, floor((t - n_words) * 0.4::DOUBLE / 30)::BIGINT AS win,
  CASE role WHEN 'user' THEN 'S01' WHEN 'assistant' THEN 'S02' ELSE 'S03' END AS local_label, CASE role WHEN 'user' THEN 'G00' WHEN 'assistant' THEN 'G01' ELSE 'G02' END AS gid, text FROM t)"""
ATOM = """atom AS (SELECT (vec_id % 25)::BIGINT AS meeting_id, floor(floor(vec_id / 25.0) / 3)::BIGINT AS win, 'S0' || (floor(vec_id / 25.0)::BIGINT % 3 + 1) AS local_label,
  (1 + (vec_id * 7) % 60)::DOUBLE AS sec, embedding::DOUBLE[] AS v, label, vec_id FROM embeddings),
bank AS (SELECT label AS person, v AS bv, k FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM atom)),
score AS (SELECT meeting_id, win, local_label, sec, label, vec_id, person, max(CASE WHEN label = person THEN 0.65 ELSE 0 END::DOUBLE + 0.35::DOUBLE * list_inner_product(v, bv)) AS sim FROM atom, bank WHERE k = 1 GROUP BY ALL)"""
SPAN = "span AS (SELECT user_id AS meeting_id, event_id AS seg_idx, epoch_us(ts) / 1e6 AS start_s, epoch_us(ts) / 1e6 + value * 600 AS end_s, event_type AS local_label FROM events)"
STORE = """spk AS (SELECT DISTINCT label::BIGINT AS id, 'Speaker_' || label AS name FROM embeddings WHERE label % 2 = 0),
grp AS (SELECT DISTINCT label::BIGINT AS group_id, CASE WHEN label % 2 = 0 THEN label END::BIGINT AS speaker_id FROM embeddings),
clu AS (SELECT meeting_id, label::BIGINT AS group_id, sum(sec) AS seconds, count(*) AS n_atoms, 'G0' || label AS cluster FROM atom GROUP BY meeting_id, label),
exe AS (SELECT label::BIGINT AS speaker_id, CASE WHEN k = 1 THEN 'room' ELSE 'phone' END AS condition, v, sec AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM atom) WHERE k <= 2 AND label % 2 = 0)"""
LINES = "line AS (SELECT doc_id AS meeting_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_idx, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep
