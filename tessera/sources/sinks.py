"""Sinks: frozen exports, many-to-many exports, one-row-per-candidate exports, content-addressed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import placed


#: Fixed: the columns of a score export, in their order.
COLUMNS = (
    "sha16", "abs_path", "path_rel", "filename", "width", "height", "filesize", "phash",
    "family_id", "aes_v25", "topiq_iaa", "topiq_nr", "qrealign", "hpsv3_mu", "hpsv3_sigma", "nsfw_prob", "identity_sim",
    "confusable_margin", "novelty", "consensus_z", "disagreement", "gaming_delta",
    "flags", "proposed_tier", "thumb_rel", "sha256",
)


def frozen(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The export's columns in their order and no others; columns that rows lack are null, lists of flags are joined by |."""
    kinds = dict(rows.dtypes)

    def cell(c: str):
        if c not in kinds:
            return F.lit(None).cast("string").alias(c)
        return F.array_join(c, "|").alias(c) if kinds[c].startswith("array") else F.col(c)

    return rows.select(*(cell(c) for c in columns))


def markdown(rows: DataFrame, columns: list[str], *order: str) -> DataFrame:
    """place, line of a Markdown table: its head, and a line for each row in order; bars and line ends in cells are escaped."""
    numbers = {c for c, t in rows.dtypes if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")}
    text = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit(""))
    lines = placed(rows, *order).select((F.col("place") + 2).alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(text, columns)), F.lit(" |")).alias("line"))
    head = [(0, "| " + " | ".join(columns) + " |"), (1, "|" + "|".join("-:" if c in numbers else "-" for c in columns) + "|")]
    return rows.sparkSession.createDataFrame(head, "place long, line string").union(lines)


def by_character(faces: DataFrame, images: DataFrame) -> DataFrame:
    """character, image, filename, face, sim, margin, decision of every face; a face without a label is abstained, under its role.

    faces: face, image, label, role, sim, margin; images: image, filename.
    """
    d = faces.join(images.select("image", "filename"), "image", "left")
    decision = F.when(F.col("label").isNotNull(), "assigned").otherwise("abstained")
    return d.select(F.coalesce("label", "role").alias("character"), "image", "filename", "face", "sim", "margin", decision.alias("decision"))


def of_character(images: DataFrame, faces: DataFrame, character: str | None) -> DataFrame:
    """The images with a face of a character; without one, those that have no assigned face, or one that is not assigned."""
    if character is not None:
        return images.join(faces.filter(F.col("label") == character).select("image").distinct(), "image", "left_semi")
    g = faces.groupBy("image").agg(F.count("label").alias("_assigned"), F.count("*").alias("_faces"))
    j = images.join(g, "image", "left")
    return j.filter(F.coalesce(F.col("_assigned") == 0, F.lit(True)) | (F.col("_assigned") < F.col("_faces"))).drop("_assigned", "_faces")


def export_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """The given columns in their order, every cell quoted; columns that rows lack are empty."""
    have = set(rows.columns)
    rows.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def by_image(images: DataFrame, roles: DataFrame) -> DataFrame:
    """image, roles: the sorted distinct roles joined by |; images without one stay, with an empty cell."""
    g = roles.groupBy("image").agg(F.array_join(F.sort_array(F.collect_set("role")), "|").alias("roles"))
    return images.select("image").distinct().join(g, "image", "left").select("image", F.coalesce("roles", F.lit("")).alias("roles"))


def candidate_rows(faces: DataFrame) -> DataFrame:
    """One row for each ranked candidate, and one with nulls for a face without any. faces: face, candidates."""
    return faces.select("face", F.posexplode_outer("candidates").alias("rank", "c")).select("face", (F.col("rank") + 1).alias("rank"), "c.*")


def add_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key isn't in the table at path yet; a key that repeats in rows is written once."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = rows.select(key).limit(0)
    new = rows.dropDuplicates([key]).join(there, key, "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count()
