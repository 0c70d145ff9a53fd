"""The opN queries: each applies its operator with production parameters to its whole table and digests the result."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hnsw, kdshard, langid, lmscore, mixing, neardup, substring, token_codes
from .base import cleared, crc32_of_id, save, table

TOKENIZERS = os.environ.get("QUILLON_TOKENIZERS", "/opt/tokenizers")
EXTRA_CONVERSATION = -7
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_codes.write_codes(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_codes.read_digests(spark, folder, files)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc32_of_id() % 5 == 0)
    model = langid.fit(docs, ~F.col("held_out"))
    return langid.identify(docs, model, ["held_out"]).select("doc_id", "held_out", "lang_pred", "score", "mixture")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = crc32_of_id() % 10 != 0
    with cleared(spark):
        model, counts = lmscore.fit(docs, train, tokenizer_path())
        return save(lmscore.score(docs, train, model, counts), "scores", keep=True)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    more = spark.createDataFrame([(EXTRA_CONVERSATION, 0, "user", EXTRA_TEXT), (EXTRA_CONVERSATION, 1, "assistant", EXTRA_TEXT)], rows.schema)
    return chat.read_back(chat.format_turns(rows.unionAll(more)))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), max_repeat=3.0).select("doc_id", "source", "n_tokens", "pass", "place")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents"), k=20)


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=80)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdshard.sharded(table(spark, sf_dir, "documents"), shards=24)


QUERIES = {f.__name__: f for f in (op1_token_codes, op2_langid, op3_lm_score, op4_chat_format, op5_mix_sources, op6_substring_dedup, op7_hnsw, op8_minhash_dedup, op9_decontaminate, op10_kd_shards)}

_SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op4_chat_format": r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS x FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(length('### ' || role || ': ' || x || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op5_mix_sources": rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM w GROUP BY source),
p AS (SELECT tokens::DOUBLE / (SELECT sum(tokens) FROM s)::DOUBLE AS p FROM s WHERE tokens > 0),
c1 AS (SELECT a FROM (SELECT i / 1000.0::DOUBLE AS a FROM range(1001) r(i)), p GROUP BY a HAVING pow(min(p), a - 1) / sum(pow(p, a)) <= 3.0),
c2 AS (SELECT a FROM (SELECT ((SELECT round(min(a) * 1000) FROM c1) * 1000 - 1000 + i) / 1000000.0::DOUBLE AS a FROM range(1001) r(i)), p WHERE a >= 0 GROUP BY a HAVING pow(min(p), a - 1) / sum(pow(p, a)) <= 3.0),
alpha AS (SELECT CASE WHEN (SELECT min(tokens) = max(tokens) FROM s WHERE tokens > 0) THEN 1.0 ELSE min(a) END AS a FROM c2),
q AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN floor(pow(tokens::DOUBLE, a) / (SELECT sum(pow(tokens::DOUBLE, a)) FROM s, alpha WHERE tokens > 0) * (SELECT sum(tokens) FROM s)::DOUBLE + 0.000001)::BIGINT ELSE 0 END AS quota FROM s, alpha),
r AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes FROM q),
x AS (SELECT w.doc_id, w.source, w.n_tokens, r.tokens, r.passes, CASE WHEN r.tokens > 0 THEN r.quota - r.passes * r.tokens ELSE 0 END AS rest, unnest(range(0, r.passes + 1)) AS pass FROM w JOIN r USING (source)),
y AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, pass ORDER BY md5(pass::VARCHAR || '|' || doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM x)
SELECT doc_id, source, n_tokens, pass::BIGINT AS pass, (pass * tokens + ahead)::BIGINT AS place FROM y WHERE pass < passes OR ahead < rest""",
    "op6_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win),
hit AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(20) r(j) WHERE k > 1),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) AS t FROM word ANTI JOIN hit ON word.doc_id = hit.doc_id AND word.p = hit.p GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS c FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.c, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op8_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '{_SPACE_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 3], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * shared >= 80 * (m.c + o.c - shared)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, comp.component_id, d.doc_id = comp.component_id AS kept
FROM d JOIN comp ON d.doc_id = comp.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op9_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(w[i:i + 9], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.c, 0)::BIGINT AS n_hit, coalesce(it.c, 0)::BIGINT AS n_items,
  sha256(coalesce(it.t, '')) AS items_sha256, coalesce(hit.c, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id""",
}
# roles are written with a capital but are as long, so the oracle's lengths hold
