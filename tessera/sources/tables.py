"""Sources: the supplied tables and the manifest that is derived from them, files, and tolerant CSV and log readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Tiers a scores file may name.
TIERS = ("queue", "review", "archive_candidate", "route_identity", "route_nsfw")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each part: four quality signals (means of its line items), identity, safety and gaming scores, content,
    a 256-bit hash that up to four parts in five share but for some bits, and a unit vector."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*(F.avg(c).alias(n) for n, c in (("s1", "l_quantity"), ("s2", "l_extendedprice"), ("s3", "l_discount"), ("s4", "l_tax"))))
    p = table(spark, sf_dir, "part").join(s, F.col("p_partkey") == F.col("l_partkey"), "left")
    k = F.col("p_partkey")
    base, cut = F.sha2(F.concat(F.lit("g"), F.floor(k / 5).cast("string")), 256), F.element_at(F.array(*(F.lit(n) for n in (0, 1, 3, 5, 64))), (k % 5 + 1).cast("int"))
    hashed = F.when(k % 5 == 4, F.sha2(F.concat(F.lit("x"), k.cast("string")), 256)).otherwise(F.rpad(F.substring(base, F.lit(1), 64 - cut), 64, "0"))
    side = (k % 2) / 2.0
    return p.select(
        k.alias("position"), F.sha2(k.cast("string"), 256).alias("sha256"), F.col("p_brand").alias("brand"), "s1", "s2", "s3", "s4",
        ((k * 37 % 1000) / 1000).alias("identity_sim"), F.when(k % 7 != 0, (k * 13 % 100) / 1000).alias("confusable_margin"), ((k * 73 % 997) / 997).alias("nsfw_prob"), ((k * 11 % 101) / 250).alias("gaming_delta"),
        hashed.alias("hash"), F.transform(F.array(F.lit(1.0), side), lambda x: x / F.sqrt(1 + side * side)).alias("v"),
    )


MANIFEST_SQL = """
manifest AS (
  SELECT p_partkey AS position, sha256(CAST(p_partkey AS VARCHAR)) AS sha256, p_brand AS brand, avg(l_quantity) AS s1, avg(l_extendedprice) AS s2, avg(l_discount) AS s3, avg(l_tax) AS s4,
    (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS identity_sim, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey * 13 % 100) / 1000.0::DOUBLE END AS confusable_margin,
    (p_partkey * 73 % 997) / 997.0::DOUBLE AS nsfw_prob, (p_partkey * 11 % 101) / 250.0::DOUBLE AS gaming_delta,
    CASE WHEN p_partkey % 5 = 4 THEN sha256('x' || p_partkey) ELSE rpad(substr(sha256('g' || p_partkey // 5), 1, 64 - [0, 1, 3, 5][p_partkey % 5 + 1]), 64, '0') END AS hash,
    [1.0::DOUBLE / sqrt(1 + pow(p_partkey % 2 / 2.0, 2)), p_partkey % 2 / 2.0 / sqrt(1 + pow(p_partkey % 2 / 2.0, 2))] AS v
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_brand)"""


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified of image files below root, without backups; contents are not read unless asked for."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.filter(F.lower("path").rlike(r"\.(png|jpg|jpeg|webp)$") & ~F.col("path").rlike(r"/\.backup-baseline-")).select("path", "length", F.col("modificationTime").alias("modified"))


def hashed_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, sha256, sha16 and the first 8 bytes of all files below root."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.select("path", "length", F.sha2("content", 256).alias("sha256"), F.substring(F.sha2("content", 256), 1, 16).alias("sha16"), F.hex(F.substring("content", 1, 8)).alias("signature"))


def scores_csv(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """A scores file with trimmed cells: empty is null, a bad number or tier fails the read, absent tier and family get defaults."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cell = {c: F.nullif(F.trim(F.col(c)), F.lit("")) for c in d.columns}

    def number(c: str):
        x = cell[c].try_cast("double")
        bad = cell[c].isNotNull() & (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{c}: not a finite number: "), cell[c])).cast("double")).otherwise(x)

    tier = F.coalesce(cell.get("proposed_tier", F.lit(None).cast("string")), F.lit("review"))
    out = {c: number(c) if c in numbers else cell[c] for c in d.columns} | {n: F.lit(None).cast("double") for n in numbers if n not in d.columns}
    out["proposed_tier"] = F.when(tier.isin(*TIERS), tier).otherwise(F.raise_error(F.concat(F.lit("unknown tier: "), tier)).cast("string"))
    out["family_id"] = F.coalesce(cell.get("family_id", F.lit(None).cast("string")), F.lit("unassigned"))
    flags = F.split(F.coalesce(cell.get("flags", F.lit(None).cast("string")), F.lit("")), r"\|")
    out["flags"] = F.array_distinct(F.filter(F.transform(flags, lambda x: F.trim(x)), lambda x: x != ""))
    return d.select(*(v.alias(k) for k, v in out.items()))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """sequence, kind, digest, previous, ok of a JSON-lines log whose records carry the digest of the one before."""
    d = spark.read.text(path).select(F.from_json("value", "sequence bigint, kind string, digest string, previous string").alias("r"), F.col("value").alias("raw"))
    return d.select("r.*", F.col("r.sequence").isNotNull().alias("ok"), "raw")
