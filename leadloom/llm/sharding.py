"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, sequence_number

#: Bits of a hash: as many as a double holds exactly, less one.
BITS = 52


def key_hash(*parts: Column) -> Column:
    """``BITS`` bits of the MD5 of the parts, as a long; nulls count as left out.  SQL engines can follow it."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def scores(key: list[Column], weights: list[float], seed: int = 0) -> Column:
    """For each shard from 0 the struct of its score for ``key`` and its negative number.

    The score of shard s is -weight / ln(u) with u in (0, 1) from a hash of the
    key and s: shards win in proportion to their weights, and a shard added at
    the end takes rows only into itself.  A weight of 0 or less wins nothing.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one weight must be positive")

    def score(s: int) -> Column:
        u = (key_hash(F.lit(seed), F.lit(s), *key).cast("double") + F.lit(0.5)) * F.lit(2.0**-BITS)
        worth = -F.lit(float(weights[s])) / F.log(u) if weights[s] > 0 else F.lit(-1.0)
        return F.struct(worth.alias("score"), F.lit(-s).alias("s"))

    return F.array(*[score(s) for s in range(len(weights))])


def winner(found: Column) -> Column:
    """The shard with the highest score; of equal ones the lowest."""
    return (-F.array_max(found)["s"]).cast("int")


def shard(df: DataFrame, key: str, weights: list[float], seed: int = 0, shard_column: str = "shard", slot_column: str = "slot", grown_column: str | None = None) -> DataFrame:
    """``df`` with a shard for each row and a slot, gapless from 0 in each shard.

    The key and the weights alone decide the shard; rows of one key, nulls
    included, share it.  Slots follow a hash of the key and are numbered by spread
    sub-groups, so no shard is sorted in one task; if one key has a great many
    rows they are split by their other columns, so that only rows equal in every
    column are numbered together.  ``grown_column`` adds the shard that the row
    would have with one more shard of the last weight.  Input columns named like
    the new ones are replaced; repeated rows get slots of their own; an empty
    table gives an empty one.
    """
    kept = [c for c in df.columns if c not in (shard_column, slot_column, grown_column)]
    n = len(weights)
    scored = df.select(*kept, scores([F.col(key)], [*weights, *([weights[-1]] if grown_column else [])], seed).alias("_scores"), key_hash(F.lit(seed), F.col(key)).alias("_h"))
    grown = [winner(F.col("_scores")).alias(grown_column)] if grown_column else []
    placed = scored.select(*kept, winner(F.slice("_scores", 1, n)).alias(shard_column), *grown, "_h")
    numbered = sequence_number(placed, [shard_column], ["_h", key], slot_column, sub=lambda spread: F.shiftright("_h", BITS - (spread.bit_length() - 1)))
    return numbered.drop("_h")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return shard(digest, "doc_id", [1.0] * 16, grown_column="grown_shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: The checksum goes byte by byte over a table that is made by the polynomial 0xEDB88320.
ORACLE_SQL = """
WITH crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i)
)), bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS b FROM documents
), digest AS (
  SELECT doc_id, len(b)::BIGINT + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM bytes, crc_table
), scored AS (
  SELECT doc_id, s, -1 / ln((('0x' || substr(md5(concat_ws('/', 0, s, doc_id)), 1, 13))::BIGINT::DOUBLE + 0.5) * pow(2, -52)) AS score
  FROM documents, range(17) r(s)
), placed AS (
  SELECT doc_id, arg_max(s, score) FILTER (WHERE s < 16)::INT AS shard, arg_max(s, score)::INT AS grown_shard FROM scored GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(concat_ws('/', 0, doc_id)), 1, 13))::BIGINT, doc_id) - 1 AS slot, grown_shard
FROM digest JOIN placed USING (doc_id)
"""
