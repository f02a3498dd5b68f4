"""The operators as queries over the tables, and DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import chat, crosstoken, html, mixing, packing, pii, quality, sentencepiece_fst, simhash, topk, toxicity, vectorcodes, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(turns.unionByName(more))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_digest(_table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op12_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compressed(_table(spark, sf_dir, "embeddings"))


def op13_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.aligned(_table(spark, sf_dir, "documents"))


_ALL = (op1_chat, op2_toxicity, op3_sentencepiece, op4_topk, op5_simhash, op6_quality, op7_warc, op8_mixing, op9_html, op10_pii, op11_packing, op12_vectorcodes, op13_crosstoken)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


_OP4 = """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT vec_id, arg_min(e, embedding) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
    list_reduce(list_transform(range(8), lambda g: list_reduce(list_transform(range(4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, (5 * g + 1)::INT, 5))::BIGINT >> (15 - 5 * k)::INT) & 31) + 1)::INT, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest
  FROM p),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts
"""

# The windows of `chat` in SQL: costs from lengths, windows from prefix sums.
_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, length(regexp_replace(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<([|/s<])', '<\\\1', 'g'), '<([|/s<])', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g')) AS body,
    9 + 1 + 8 + length(role) AS frame FROM t),
cost AS (
  SELECT *, body + frame AS chars, ceil((body + frame) / 4.0)::BIGINT AS tokens,
    row_number() OVER o - 1 AS pos FROM esc WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
pre AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) - tokens AS beg FROM cost),
sys AS (SELECT conv_id, min(pos) AS s_pos, arg_min(tokens, pos) AS s_tokens, arg_min(chars, pos) AS s_chars FROM pre WHERE role = 'system' GROUP BY conv_id),
str AS (SELECT p.*, s.s_pos, greatest((1024 - 256 - coalesce(s.s_tokens, 0)) // 2, 1) AS stride FROM pre p LEFT JOIN sys s ON p.conv_id = s.conv_id),
run AS (SELECT *, (tokens > stride)::BIGINT AS big, sum((tokens > stride)::BIGINT) OVER (PARTITION BY conv_id ORDER BY pos) AS bigs FROM str),
win AS (SELECT *, min(pos) OVER w AS first, min(beg) OVER w AS start FROM run WINDOW w AS (PARTITION BY conv_id, beg // stride, 2 * (bigs - big) + big)),
starts AS (SELECT DISTINCT conv_id, first, start FROM win),
old AS (
  SELECT s.conv_id, sum(w.chars) AS n FROM starts s JOIN win w ON w.conv_id = s.conv_id AND s.start > w.beg AND s.start - w.beg <= 256 AND (w.s_pos IS NULL OR w.pos <> w.s_pos) GROUP BY s.conv_id),
kept AS (SELECT s.conv_id, sum(y.s_chars) AS n FROM starts s JOIN sys y ON y.conv_id = s.conv_id AND y.s_pos < s.first GROUP BY s.conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(chars) AS n
  FROM cost GROUP BY conv_id)
SELECT d.conv_id, d.n_turns, d.turns_sha256, d.loss_chars, d.loss_sha256, (d.n + coalesce(o.n, 0) + coalesce(k.n, 0))::BIGINT AS formatted_chars
FROM said d LEFT JOIN old o ON o.conv_id = d.conv_id LEFT JOIN kept k ON k.conv_id = d.conv_id
"""


# Two rounds over all entries, without the annuli.
_NEAREST = """
{0} AS MATERIALIZED (
  SELECT r, p, min(d * 64 + k) % 64 AS k, min(d * 64 + k) // 64 AS d, any_value(x) AS x FROM (
    SELECT r, x.p, k, x.x AS x, list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM cut x JOIN {1} b ON b.p = x.p) GROUP BY r, p)"""
_MEANS = """
{0} AS MATERIALIZED (
  SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM {1} b LEFT JOIN (
    SELECT p, k, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM (
      SELECT p, k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT p, k, x, unnest(range(1, len(x) + 1)) AS i FROM {2}) GROUP BY p, k, i) GROUP BY p, k) m ON m.p = b.p AND m.k = b.k)"""
_OP12 = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS MATERIALIZED (SELECT r, p, e[(p * len(e) // 16 + 1):((p + 1) * len(e) // 16)] AS x FROM v, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS k, x AS c FROM cut WHERE r <= 64),
{_NEAREST.format("a1", "b0")}, {_MEANS.format("b1", "b0", "a1")}, {_NEAREST.format("a2", "b1")}, {_MEANS.format("b2", "b1", "a2")}, {_NEAREST.format("a3", "b2")},
named AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b2),
coded AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN v USING (r), named
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": _OP1, "op4_topk": _OP4, "op7_warc": _OP7, "op12_vectorcodes": _OP12}
