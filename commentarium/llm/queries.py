"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.llm import (
    byte_bpe,
    chat_format,
    collocations,
    fingerprints,
    jaccard_join,
    lattice,
    line_dedup,
    mixing,
    prefix_bpe,
    token_counts,
    toxicity,
    warc,
    whitening,
)
from commentarium.llm.common import table

TOKEN_LIMIT = 2048


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, unnest(parts) AS line, unnest(range(len(parts))) AS pos
  FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
)
SELECT k.doc_id AS doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (s.key IS NOT NULL AND k.doc_id <> s.first_doc)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (s.key IS NULL OR k.doc_id = s.first_doc), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s USING (key) GROUP BY k.doc_id, k.rid
"""


def chat_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = given.limit(0).unionByName(
        spark.range(2).select(
            F.lit(-7).cast("long").alias("conv_id"),
            F.col("id").alias("turn"),
            F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
            F.lit(probe).alias("text"),
        )
    )
    messages = given.unionByName(extra).withColumn("parts", chat_format.text_part(F.col("text")))
    read = chat_format.read_back(chat_format.format_conversations(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


CHAT_FORMAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn role="' || replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
           || '">' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')
           || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprints_with_neighbours(table(spark, sf_dir, "documents"), with_text=False)
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def jaccard_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH rows AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM rows
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_page < page_id THEN first_page END AS refers_to
FROM firsts
"""


def byte_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.joined_ids(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def lattice_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def whitening_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^ \t]+') AS words FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
    FROM documents)
), placed AS (
  SELECT piece, lang, unnest(words) AS word, unnest(range(len(words))) AS spot FROM pieces
), rows AS (
  SELECT lang, word AS w1, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3, lead(word, 3) OVER p AS w4
  FROM placed WINDOW p AS (PARTITION BY piece ORDER BY spot)
), sizes AS (
  SELECT lang, count(*)::BIGINT AS n FROM rows GROUP BY lang
), grams AS (
  SELECT lang, 1 AS m, w1 AS phrase, count(*)::BIGINT AS f FROM rows GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM rows WHERE w2 IS NOT NULL GROUP BY lang, phrase HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM rows WHERE w3 IS NOT NULL
            GROUP BY lang, phrase HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM rows WHERE w4 IS NOT NULL
            GROUP BY lang, phrase HAVING count(*) >= 30
), cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS head,
         array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM grams WHERE m >= 2)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f::HUGEINT + t.f))::BIGINT AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_parts AS (
  SELECT lang, f, array_to_string(list_slice(string_split(phrase, ' '), first, last), ' ') AS phrase
  FROM grams JOIN (VALUES (3, 1, 2), (3, 2, 3), (4, 1, 2), (4, 2, 3), (4, 3, 4), (4, 1, 3), (4, 2, 4)) AS v(m, first, last) USING (m)
), swallowed AS (
  SELECT DISTINCT i.lang, i.phrase FROM inner_parts i JOIN grams g ON g.lang = i.lang AND g.phrase = i.phrase
  WHERE 100::HUGEINT * i.f >= 80::HUGEINT * g.f
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b WHERE NOT EXISTS (SELECT 1 FROM swallowed s WHERE s.lang = b.lang AND s.phrase = b.phrase)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""


def prefix_bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = prefix_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(byte_bpe.joined_ids(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_line_dedup": (line_dedup_query, LINE_DEDUP_SQL),
    "op2_chat_format": (chat_format_query, CHAT_FORMAT_SQL),
    "op3_fingerprints": (fingerprints_query, None),
    "op4_mixing": (mixing_query, None),
    "op5_token_counts": (token_counts_query, None),
    "op6_jaccard_join": (jaccard_join_query, None),
    "op7_warc": (warc_query, WARC_SQL),
    "op8_byte_bpe": (byte_bpe_query, None),
    "op9_toxicity": (toxicity_query, None),
    "op10_lattice": (lattice_query, None),
    "op11_whitening": (whitening_query, None),
    "op12_collocations": (collocations_query, COLLOCATIONS_SQL),
    "op13_prefix_bpe": (prefix_bpe_query, None),
}
