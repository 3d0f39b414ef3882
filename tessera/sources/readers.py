"""Readers that refuse what they can't trust: scans of image files, typed documents, sealed artifacts, vectors, logs, caches.

Documents that describe a run are small and read whole; tables of files, lines and vectors stay DataFrames.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.skew import importable
from .images import SIGNATURE, decoded, perceptual_hash

def inspect_image(data: bytes) -> tuple[int | None, int | None, str | None, str | None, str | None]:
    """width, height, mode, perceptual hash and what is wrong. A PNG's pixels are decoded; of a JPEG, whose pixels and hash
    need a library, the frame header and the end are read."""
    nothing = (None,) * 4
    if data[:8] == SIGNATURE:
        try:
            pixels, mode = decoded(data)
        except ValueError as e:
            return *nothing, str(e)
        return pixels.shape[1], pixels.shape[0], mode, perceptual_hash(pixels), None
    if data[:2] != b"\xff\xd8":
        return *nothing, "unknown signature"
    at = 2
    try:
        while data[at] == 0xFF:
            kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width, n = struct.unpack(">HHB", data[at + 5 : at + 10])
                if not data.rstrip(b"\0").endswith(b"\xff\xd9"):
                    break
                return width, height, {1: "L", 3: "RGB", 4: "CMYK"}.get(n), None, None
            at += 2 + size
        else:
            return *nothing, "no frame"
    except (struct.error, IndexError):
        pass
    return *nothing, "cut off"


def scanned(files: DataFrame) -> DataFrame:
    """path, size, sha256, sha16, width, height, mode, phash (null where no pixels were decoded), reason of files (path,
    content); a row with a reason was refused."""
    schema = "path string, size long, sha256 string, sha16 string, width int, height int, mode string, phash string, reason string"

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"], strict=True):
                sha = hashlib.sha256(data).hexdigest()
                out.append((path, len(data), sha, sha[:16], *inspect_image(bytes(data))))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    importable(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, schema)


def scan(files: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): of each distinct content the first path, in order of its digest, and then the limit; refused rows keep their reason."""
    s = scanned(files)
    first = s.filter("reason IS NULL").groupBy("sha256").agg(F.min(F.struct("path", "size", "sha16", "width", "height", "mode", "phash")).alias("r")).select("sha256", "r.*").orderBy("sha256")
    return (first if most is None else first.limit(most)), s.filter("reason IS NOT NULL").select("path", "reason")


def collisions(manifest: DataFrame) -> DataFrame:
    """sha16, contents of short digests that stand for more than one content."""
    return manifest.groupBy("sha16").agg(F.count_distinct("sha256").alias("contents")).filter("contents > 1")


def score_view(manifest: DataFrame, columns: dict[str, str]) -> DataFrame:
    """position and the frozen columns (name to type) of a manifest whose rows are JSON (position, payload)."""
    return manifest.select("position", *(F.get_json_object("payload", f"$.{c}").cast(t).alias(c) for c, t in columns.items())).orderBy("position")


def tag_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """name, category of a vocabulary; a category that is no number, or a name that is missing, fails the read."""
    d = spark.read.option("header", True).option("escape", '"').csv(path)
    category = F.col("category").try_cast("int")
    return d.select(F.coalesce("name", F.raise_error(F.lit("a tag without a name")).cast("string")).alias("name"), F.when(category.isNotNull(), category).otherwise(F.raise_error(F.concat(F.lit("no category: "), F.coalesce("category", F.lit("")))).cast("int")).alias("category"))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return bytes(spark.read.format("binaryFile").load(path).first()["content"]).decode("utf-8")


def _unknown(value, schema) -> list[str]:
    """Names in a JSON value that its schema lacks."""
    if isinstance(schema, StructType) and isinstance(value, dict):
        return [k for k in value if k not in schema.names] + [f"{k}.{x}" for k in value if k in schema.names for x in _unknown(value[k], schema[k].dataType)]
    if hasattr(schema, "elementType") and isinstance(value, list):
        return [x for v in value for x in _unknown(v, schema.elementType)]
    return []


def typed_document(spark: SparkSession, path: str, schema: str, open_fields: bool = False) -> DataFrame:
    """A JSON document as one row; a wrong type fails, and so does an unknown field unless they are allowed."""
    text = read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    kind = StructType.fromDDL(schema)
    value = json.loads(text)
    if not open_fields and (extra := _unknown(value, kind)):
        raise ValueError(f"unknown fields in {path}: {', '.join(extra)}")
    return spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def sidecar(spark: SparkSession, path: str, schema: str, silent: bool = False) -> DataFrame:
    """Rows of an optional JSON array or object of rows: absent, none; malformed, an error, or none if it may be silent."""
    kind = StructType.fromDDL(schema)
    text = read_text(spark, path)
    if text is None:
        return spark.createDataFrame([], kind)
    try:
        value = json.loads(text)
    except ValueError:
        if silent:
            return spark.createDataFrame([], kind)
        raise
    rows = value if isinstance(value, list) else [{"id": k} | (v if isinstance(v, dict) else {"value": v}) for k, v in value.items()]
    return spark.createDataFrame([(json.dumps(r),) for r in rows], "t string").select(F.from_json("t", schema).alias("d")).select("d.*")


@dataclass(frozen=True)
class Vectors:
    """What a matrix must be: its file's digest, its rows' ids in order, its dtype."""

    digest: str
    ids: tuple[str, ...]
    dtype: str = "float16"


def vectors(spark: SparkSession, path: str, want: Vectors) -> DataFrame:
    """id, position, v of a saved matrix, if its payload, shape and dtype are what they should be."""
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    if hashlib.sha256(data).hexdigest() != want.digest:
        raise ValueError(f"{path}: not the payload that was saved")
    m = np.load(io.BytesIO(data), allow_pickle=False)
    if m.ndim != 2 or len(m) != len(want.ids) or str(m.dtype) != want.dtype or not np.isfinite(m).all():
        raise ValueError(f"{path}: {m.dtype} of {m.shape} for {len(want.ids)} rows")
    return spark.createDataFrame(pd.DataFrame({"id": want.ids, "position": range(len(m)), "v": m.astype("float32").tolist()}), "id string, position long, v array<float>")


def sealed(files: DataFrame, seal: dict[str, str]) -> DataFrame:
    """name, status of what a seal enumerates (name to digest): verified, changed or missing; other files are not seen. files: name, content."""
    s = files.sparkSession.createDataFrame(sorted(seal.items()), "name string, digest string")
    j = s.join(files.select("name", F.sha2("content", 256).alias("_d")), "name", "left")
    return j.select("name", F.when(F.col("_d").isNull(), "missing").when(F.col("_d") == F.col("digest"), "verified").otherwise("changed").alias("status"))


def reference_files(files: DataFrame, root: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """path, character: files right under the root have none, files under a folder of it have the folder's name; excluded folders are left out."""
    rel = F.split(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"), "/")
    below = files.filter(F.col("path").startswith(root.rstrip("/") + "/"))
    name = F.when(F.size(rel) > 1, F.get(rel, F.lit(0)))
    return below.select("path", name.alias("character")).filter(F.col("character").isNull() | ~F.col("character").isin(list(excluded)))


def log_progress(lines: DataFrame, pattern: str, names: dict[str, str]) -> DataFrame:
    """The groups of a pattern (name to type) in the lines of a log; lines that don't match are left out."""
    hit = lines.filter(F.col("value").rlike(pattern))
    return hit.select(*(F.regexp_extract("value", pattern, i).cast(t).alias(n) for i, (n, t) in enumerate(names.items(), 1)))


def short_cache(entries: DataFrame, handshake: str, contents: DataFrame) -> DataFrame:
    """sha256, key, value, status of old entries (key, value) that were stored under a digest of the handshake and a short hash.

    status: reused, ambiguous if a short hash stands for several contents, orphan if no content has it.
    """
    c = contents.select("sha256", F.substring("sha256", 1, 16).alias("sha16"))
    n = c.groupBy("sha16").agg(F.count_distinct("sha256").alias("n"), F.min("sha256").alias("sha256"))
    keyed = n.withColumn("key", F.sha2(F.concat_ws("|", F.lit(handshake), "sha16"), 256))
    j = entries.join(keyed, "key", "left")
    return j.select(F.when(F.col("n") == 1, F.col("sha256")).alias("sha256"), "key", "value", F.when(F.col("n").isNull(), "orphan").when(F.col("n") > 1, "ambiguous").otherwise("reused").alias("status"))


@dataclass(frozen=True)
class Settings:
    """Fixed limits as the configuration names them; a value out of its range is refused."""

    profile: str = "four-means-v1"
    uncertain: float = 1.2
    gaming: float = 0.35
    workers: int = 8

    RANGES = {"uncertain": (0.0, 100.0), "gaming": (0.0, 1.0), "workers": (1, 64)}


def settings(text: str) -> Settings:
    """Settings from `name: value` lines; unknown names, wrong types and values out of range fail."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    got: dict[str, object] = {}
    for line in text.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        name, colon, raw = line.partition(":")
        name, raw = name.strip(), raw.strip().strip("'\"")
        if not colon or name not in kinds or name in got:
            raise ValueError(f"no such setting: {line}")
        value = kinds[name](raw)
        low, high = Settings.RANGES.get(name, (None, None))
        if low is not None and not low <= value <= high:
            raise ValueError(f"{name}: {value} isn't between {low} and {high}")
        got[name] = value
    return Settings(**got)
