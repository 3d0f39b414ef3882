"""Digests, identifiers and text forms that other programs must read the same way."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType



def canonical_json(**fields: Column) -> Column:
    """Compact JSON of the fields by sorted name, nulls kept, characters as they are."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def ascii_json(text: Column) -> Column:
    """JSON text with every character beyond ASCII as \\uXXXX of its UTF-16 units, in lower case."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))  # one pass
    one = lambda u: F.when(u < "0080", F.decode(F.unhex(F.substring(u, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.array_join(F.transform(units, one), ""))


def html_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    for raw, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        json = F.replace(json, F.lit(raw), F.lit(escaped))
    return json


def face_id(image_sha256: Column, box: Column) -> Column:
    """f_ and the first eight digits of the digest of the image's digest and its box as a compact JSON array."""
    return F.concat(F.lit("f_"), F.substring(F.sha2(F.concat(image_sha256, F.lit("["), F.array_join(F.transform(box, lambda x: x.cast("string")), ","), F.lit("]")), 256), 1, 8))


def crop_path(face: Column) -> Column:
    return F.concat(F.lit("faces/"), face, F.lit(".jpg"))


def cache_namespace(name: Column, revision: Column, preparation: Column, variant: Column, execution: Column) -> Column:
    """Digest of a cache's lineage: the model and its revision, its preparation and variant, and what runs it."""
    model, prepared = F.sha2(F.concat_ws("@", name, revision), 256), F.sha2(F.concat_ws("|", preparation, variant), 256)
    return F.sha2(F.concat(F.lit('["cache-v2", "'), model, F.lit('", "'), prepared, F.lit('", "outputs-v1", "'), execution, F.lit('"]')), 256)


def folder_id(path: Column) -> Column:
    return F.sha2(F.concat(F.lit("directory-v1:"), path), 256)


def occurrence_id(path: Column, sha256: Column) -> Column:
    return F.sha2(F.concat(F.lit("occurrence-v1:"), path, F.lit(":"), sha256), 256)


def cluster_snapshot_id(members: Column, parents: Column, context: Column) -> Column:
    """Digest of a cluster by what its members are bound to (struct image, subject, crop, profile), its parents and its context."""
    lines = F.transform(F.array_sort(members), lambda m: F.concat_ws(":", m["image"], F.coalesce(m["subject"], F.lit("")), m["crop"], m["profile"]))
    return F.sha2(F.concat(F.lit("cluster-members-v1\n"), F.array_join(lines, "\n"), F.lit("\n"), F.array_join(F.array_sort(parents), "\n"), F.lit("\n"), F.coalesce(context, F.lit(""))), 256)


def decode_bytes(file_bytes: Column, width: Column, height: Column) -> Column:
    """Memory to set aside for decoding an image: its file four times, its pixels in all their forms, and a reserve."""
    return 4 * file_bytes + 48 * width * height + 16 * 1024 * 1024


def host_budget(tier: Column, installed: Column, available: Column) -> Column:
    return F.floor(F.least(tier.cast("double"), 0.65 * installed, 0.75 * available))


def device_budget(total: Column, free: Column) -> Column:
    return F.floor(F.least(0.80 * total, 0.85 * free))


def shown(value: Column) -> Column:
    """Three decimals; a dash where there is nothing."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.3f", F.round(value, 3)))


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.format_string("%.1f", F.round(100 * part / F.greatest(whole, F.lit(1)), 1)), F.lit("%"))


def floats_to_base64(values: Column) -> Column:
    """Little-endian 32-bit floats as base64; Spark has no function from a float to its bytes."""

    @F.pandas_udf(StringType())
    def encoded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode("ascii"))

    return encoded(values)


def base64_to_floats(text: Column) -> Column:
    """The floats of such a string; bad base64, a part of a float, or a value that isn't finite fails."""

    def one(t: str | None) -> np.ndarray | None:
        if t is None:
            return None
        v = np.frombuffer(base64.b64decode(t, validate=True), "<f4")
        if not np.isfinite(v).all():
            raise ValueError("scores that aren't finite")
        return v

    @F.pandas_udf(ArrayType(FloatType()))
    def decoded(text: pd.Series) -> pd.Series:
        return text.map(one)

    return decoded(text)
