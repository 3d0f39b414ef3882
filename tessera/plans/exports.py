"""Queries of exports: the frozen projection, faces by character, the filter by character, a Markdown table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import sinks
from ..sources.tables import table


def frozen_projection(spark, d):
    """Documents as rows of a score export; what they don't have is null."""
    docs = table(spark, d, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(
        sha.alias("sha256"), F.substring(sha, 1, 16).alias("sha16"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path_rel"), F.col("doc_id").cast("string").alias("filename"), F.col("n_chars").alias("filesize"),
        F.array_compact(F.array(F.when(F.col("lang") == "en", "english"), F.when(F.col("n_chars") > 2000, "long"))).alias("flags"), F.lit("extra").alias("extra"),
    )
    return sinks.frozen(rows)


def _faces(spark, d):
    """Events as faces on images of users: a label for some, and the role of the others."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    return e.select(k.alias("face"), F.col("user_id").alias("image"), F.when(F.col("value") > 20, F.col("event_type")).alias("label"), F.lit("unknown").alias("role"), F.round(F.col("value") / 1000, 6).alias("sim"), F.round(F.col("value") / 5000, 6).alias("margin"))


def _images(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("image"), F.col("c_name").alias("filename"))


def character_faces(spark, d):
    return sinks.by_character(_faces(spark, d), _images(spark, d))


def character_images(spark, d):
    """Images of one character, and those that wait for one."""
    images, faces = _images(spark, d), _faces(spark, d)
    named, waiting = sinks.of_character(images, faces, "purchase"), sinks.of_character(images, faces, None)
    return named.withColumn("filter", F.lit("purchase")).union(waiting.withColumn("filter", F.lit("unassigned")))


def label_report(spark, d):
    """Every brand's parts and prices as a Markdown table."""
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("parts"), F.round(F.avg("p_size"), 2).cast("decimal(10,2)").alias("size"))
    return sinks.markdown(g, ["p_brand", "p_type", "parts", "size"], "p_brand", "p_type")


QUERIES = {f.__name__: f for f in (frozen_projection, character_faces, character_images, label_report)}
_FACES = "f AS (SELECT event_id AS face, user_id AS image, CASE WHEN value > 20 THEN event_type END AS label, round(value / 1000, 6) AS sim, round(value / 5000, 6) AS margin FROM events)"
_GIVEN = {
    "sha256": "sha256(coalesce(text, ''))", "sha16": "substr(sha256(coalesce(text, '')), 1, 16)", "path_rel": "concat_ws('/', source, doc_id)", "filename": "CAST(doc_id AS VARCHAR)", "filesize": "n_chars",
    "flags": "array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 2000 THEN 'long' END], lambda x: x IS NOT NULL), '|')",
}
ORACLE = {
    "frozen_projection": "SELECT " + ", ".join(f"{_GIVEN.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in sinks.COLUMNS) + " FROM documents",
    "character_faces": f"""
WITH {_FACES}
SELECT coalesce(label, 'unknown') AS character, image, c_name AS filename, face, sim, margin, CASE WHEN label IS NULL THEN 'abstained' ELSE 'assigned' END AS decision
FROM f LEFT JOIN customer ON c_custkey = image
""",
    "character_images": f"""
WITH {_FACES}, i AS (SELECT c_custkey AS image, c_name AS filename FROM customer)
SELECT image, filename, 'purchase' AS filter FROM i WHERE image IN (SELECT image FROM f WHERE label = 'purchase')
UNION ALL SELECT image, filename, 'unassigned' FROM i
WHERE image NOT IN (SELECT image FROM f WHERE label IS NOT NULL) OR image IN (SELECT image FROM f WHERE label IS NULL)
""",
    "label_report": """
WITH g AS (SELECT p_brand, p_type, count(*) AS parts, CAST(round(avg(p_size), 2) AS DECIMAL(10, 2)) AS size FROM part GROUP BY 1, 2)
SELECT 0 AS place, '| p_brand | p_type | parts | size |' AS line UNION ALL SELECT 1, '|-|-|-:|-:|'
UNION ALL SELECT row_number() OVER (ORDER BY p_brand, p_type) + 1, '| ' || p_brand || ' | ' || p_type || ' | ' || parts || ' | ' || size || ' |' FROM g
""",
}
