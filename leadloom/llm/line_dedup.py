"""Line dedup by the number of distinct sites that a line is found on.

HyperLogLog sketches of the sites merge by aggregation per line hash.  Lines
whose estimate lies near the threshold get an exact distinct count, all others
are decided by the sketch; boilerplate lines then go from every document.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

#: log2 of the sketch's buckets; the relative standard error is about 1.04 / sqrt(2 ** K).
K = 10
#: Half-width of the band around the threshold: over six standard errors.
BAND = 0.2


def trimmed(line: Column) -> Column:
    """A line without the white space and control characters at its ends."""
    return F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def line_key(line: Column) -> Column:
    """96 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"))


def boilerplate(lines: DataFrame, min_sites: int, sites_column: str = "site") -> DataFrame:
    """Keys (``h``, ``g``) of the lines on at least ``min_sites`` distinct sites; ``lines`` has h, g and the site."""
    site = F.col(sites_column)
    sketched = lines.groupBy("h", "g").agg(F.hll_sketch_agg(site, K).alias("s"), F.count(site).alias("n"))
    low, high = min_sites * (1 - BAND), min_sites * (1 + BAND)
    estimated = sketched.where(F.col("n") >= min_sites).select("h", "g", F.hll_sketch_estimate("s").alias("sites"))
    # few lines reach the threshold: as a table of known size they are broadcast if small, and a hot line's join can be split if not
    estimated = materialize(estimated.where(F.col("sites") >= low), "line-estimates")
    sure = estimated.where(F.col("sites") > high).select("h", "g")
    near = estimated.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("h", "g")
    exact = lines.join(near, ["h", "g"], "left_semi").distinct().groupBy("h", "g").agg(F.count(site).alias("sites"))
    return materialize(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("h", "g")), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = 10, id_column: str = "doc_id", text_column: str = "text", site_column: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_removed``.

    Lines are parted by \\n and compared without the white space at their ends;
    blank lines are never removed.  A null site counts as no site; a null text
    stays null with 0 lines; a document of nothing but boilerplate becomes
    empty.  Rows with equal or null ids each keep their own text.  Input columns
    named ``n_lines`` or ``n_removed`` are replaced; an empty table gives an
    empty one.
    """
    kept = docs.drop("n_lines", "n_removed")
    names = kept.columns
    line = F.explode(F.split(F.col(text_column), "\n", -1)).alias("line")
    # id and text hash name a row, so that rows without an id don't come together
    mark = F.xxhash64(F.col(text_column)).alias("tk")
    exploded = kept.select(F.col(site_column).cast("string").alias("site"), F.col(id_column).alias("id"), mark, line)
    keyed = exploded.select("site", "id", "tk", trimmed(F.col("line")).alias("line")).where("line <> ''").select("site", "id", "tk", line_key(F.col("line")).alias("k")).select("site", "id", "tk", "k.h", "k.g")
    bad = boilerplate(keyed.select("h", "g", "site"), min_sites)
    # the keys to remove from a document, at most its distinct lines
    per_doc = keyed.select("id", "tk", "h", "g").join(bad, ["h", "g"]).groupBy("id", "tk").agg(F.collect_set(F.struct("h", "g")).alias("_keys"))
    row = F.struct(*[F.col(c) for c in names]).alias("row")
    rows = kept.select(F.col(id_column).alias("_id"), F.xxhash64(F.col(text_column)).alias("_tk"), row)
    joined = rows.join(per_doc, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_tk") == F.col("tk")), "left")
    lines = F.split(F.col("row")[text_column], "\n", -1)

    def stays(x: Column) -> Column:
        t = trimmed(x)
        return (t == "") | ~F.array_contains(F.col("_keys"), line_key(t))

    some = F.col("_keys").isNotNull()
    out = joined.select("row", lines.alias("_all"), F.when(some, F.filter(lines, stays)).otherwise(lines).alias("_left"))
    text = F.array_join("_left", "\n")
    columns = [text.alias(c) if c == text_column else F.col("row")[c].alias(c) for c in names]
    n = F.coalesce(F.size("_all"), F.lit(0))
    return out.select(*columns, F.greatest(n, F.lit(0)).cast("long").alias("n_lines"), F.greatest(n - F.size("_left"), F.lit(0)).cast("long").alias("n_removed"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", "text")


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, u.i, u.line, regexp_replace(u.line, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS t
  FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i) u
), bad AS (
  SELECT t FROM lines WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.*, b.t IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON l.t = b.t
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
