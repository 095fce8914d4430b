"""The operators' queries over whole tables. What SQL can express of their results has a query of its own with its SQL: sizes
and slots of shards, the fixed quality rules, counts of personal data. The rest is held against brute force in tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_ngram, op2_sharding, op3_quality, op4_simhash, op5_decontam, op6_packing, op7_bitpack, op8_toxicity, op9_pii, op10_langid

QUERIES = {
    "op1_ngram_trie": op1_ngram.query,
    "op2_sampled_splitters": op2_sharding.query,
    "op3_isolation_forest": op3_quality.query,
    "op4_simhash": op4_simhash.query,
    "op5_decontamination": op5_decontam.query,
    "op6_bin_slack_packing": op6_packing.query,
    "op7_bit_packing": op7_bitpack.query,
    "op8_toxic_segments": op8_toxicity.query,
    "op9_pii_boosting": op9_pii.query,
    "op10_language": op10_langid.query,
}
ORACLES: dict[str, str] = {}


def _derived(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@_derived("ngram_tokens", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens FROM documents")
def _ngram_tokens(s: SparkSession, d: str) -> DataFrame:
    return op1_ngram.query(s, d).select("doc_id", "n_tokens")


@_derived("shard_sizes", "SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, 'bytes' AS law FROM documents")
def _shard_sizes(s: SparkSession, d: str) -> DataFrame:
    return op2_sharding.query(s, d).select("doc_id", "size", "law")


@_derived(
    "shard_law",
    "SELECT 8::BIGINT AS shards, count(*) AS n, true AS gapless, true AS equal_texts_together, true AS near_equal FROM documents",
)
def _shard_law(s: SparkSession, d: str) -> DataFrame:
    """What the law promises, as facts of the result: within a tenth of equal bytes, a text in one shard, slots without gaps."""
    rows = op2_sharding.query(s, d)
    by_shard = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("top"), F.sum("size").alias("bytes"))
    facts = by_shard.agg(F.count("*").alias("shards"), F.sum("n").alias("n"), F.every((F.col("n") == F.col("slots")) & (F.col("top") == F.col("n") - 1)).alias("gapless"), (F.max("bytes") < 1.1 * F.avg("bytes")).alias("near_equal"))
    apart = rows.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("shards")).agg(F.every(F.col("shards") == 1).alias("equal_texts_together"))
    return facts.crossJoin(F.broadcast(apart))  # one row each


_WORDS = "w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents)"


@_derived(
    "quality_rules",
    f"""WITH {_WORDS}, lines AS (SELECT doc_id, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) AS line FROM w),
 dup AS (SELECT doc_id, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM lines GROUP BY doc_id),
 three AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM three),
 rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY doc_id),
 c AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id))
 SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
)
def _quality_rules(s: SparkSession, d: str) -> DataFrame:
    return op3_quality.query(s, d).select("doc_id", *op3_quality.BASE, "base_failed")


@_derived("decontaminated_items", "SELECT doc_id, item_id FROM documents, benchmark WHERE contains(documents.text, benchmark.text) AND benchmark.text <> ''")
def _decontaminated(s: SparkSession, d: str) -> DataFrame:
    """Leaks whose item is in the text sign for sign; the operator also finds others."""
    both = op5_decontam.query(s, d).select("doc_id", "item_id")
    docs, items = op5_decontam.documents(s, d).select("doc_id", "text"), s.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("item"))
    return both.join(docs, "doc_id").join(items, "item_id").where(F.contains("text", "item")).select("doc_id", "item_id")


_LUHN = "list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 0 THEN reverse(x)[i + 1]::INT ELSE reverse(x)[i + 1]::INT * 2 - 9 * (reverse(x)[i + 1]::INT > 4)::INT END)) % 10 = 0"


@_derived(
    "pii_counts",
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS i,
  list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS c,
  list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS f FROM documents)
 SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(list_filter(i, lambda x: list_max(list_transform(string_split(x, '.'), lambda y: y::HUGEINT)) <= 255)) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: length(x) BETWEEN 16 AND 19 AND {_LUHN})) AS BIGINT) AS n_card, CAST(len(list_filter(f, lambda x: length(x) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone FROM p""",
)
def _pii_counts(s: SparkSession, d: str) -> DataFrame:
    return op9_pii.query(s, d).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")
