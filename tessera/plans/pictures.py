"""Queries from pixels to families: PNG bytes that each supplier's numbers give, decoded, hashed and linked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators.neardup import theta_families
from ..operators.skew import importable, kept
from ..sources import images, readers
from ..sources.tables import table


def _drawn(key: int) -> bytes:
    """A grey picture of 64 x 64; four keys share a pattern, but for a few pixels."""
    x, y = np.arange(64)[None], np.arange(64)[:, None]
    g, m = key // 4, key % 4
    return images.encoded((x * (g % 13 + 1) * 3 + y * (g % 7 + 2) * 5 + x * y * (g % 11 + 1) % 97 + np.where((x < 4) & (y == 9), 40 * m, 0)) % 256)


def _pictures(spark, d):
    """path and content; every ninth file is cut off."""
    importable(spark)

    @F.pandas_udf("binary")
    def content(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: _drawn(k)[: -30 if k % 9 == 0 else None])

    s = table(spark, d, "supplier")
    return s.select(F.format_string("%09d.png", "s_suppkey").alias("path"), content("s_suppkey").alias("content"))


def picture_hashes(spark, d):
    return readers.scanned(_pictures(spark, d)).select("path", "width", "height", "mode", "phash", "reason")


def picture_families(spark, d):
    scanned = kept(readers.scanned(_pictures(spark, d)).filter("reason IS NULL"))
    rows = scanned.select(F.col("path").alias("k"), F.sha2("path", 256).alias("sha256"), F.col("phash").alias("hash"), F.lit(None).cast("array<double>").alias("v"))
    return theta_families(rows)


QUERIES = {f.__name__: f for f in (picture_hashes, picture_families)}
_HASHES = """
s AS (SELECT s_suppkey AS key, s_suppkey // 4 AS g, s_suppkey % 4 AS m FROM supplier WHERE s_suppkey % 9 <> 0),
n AS (SELECT unnest(range(64)) AS i),
p AS (
  SELECT key, x.i AS x, y.i AS y,
    (x.i * (g % 13 + 1) * 3 + y.i * (g % 7 + 2) * 5 + x.i * y.i * (g % 11 + 1) % 97 + CASE WHEN x.i < 4 AND y.i = 9 THEN 40 * m ELSE 0 END) % 256 AS v
  FROM s, n x, n y),
c AS (SELECT k.i AS k, n.i AS n, 2 * cos(pi() * k.i * (2 * n.i + 1) / 128) AS c FROM n k, n WHERE k.i < 16),
a AS (SELECT key, y, k AS u, sum(v * c) AS v FROM p JOIN c ON n = x GROUP BY key, y, k),
f AS (SELECT key, k AS w, u, round(sum(v * c), 6) AS v FROM a JOIN c ON n = y GROUP BY key, k, u),
b AS (SELECT *, v > median(v) OVER (PARTITION BY key) AS bit FROM f),
q AS (
  SELECT key, (w * 16 + u) // 4 AS digit, sum(CASE WHEN bit THEN 1 << CAST(3 - (w * 16 + u) % 4 AS INTEGER) ELSE 0 END) AS d FROM b GROUP BY key, digit),
h AS (SELECT key, printf('%09d.png', key) AS k, string_agg(lower(to_hex(CAST(d AS BIGINT))), '' ORDER BY digit) AS phash FROM q GROUP BY key)"""
ORACLE = {
    "picture_hashes": f"""
WITH {_HASHES}
SELECT k AS path, 64 AS width, 64 AS height, 'L' AS mode, phash, CAST(NULL AS VARCHAR) AS reason FROM h
UNION ALL SELECT printf('%09d.png', s_suppkey), NULL, NULL, NULL, NULL, 'cut off' FROM supplier WHERE s_suppkey % 9 = 0
""",
    "picture_families": f"""
WITH RECURSIVE {_HASHES},
x AS (SELECT k, list_transform([1, 17, 33, 49], lambda i: ('0x' || substr(phash, i, 16))::UBIGINT) AS h FROM h),
e AS MATERIALIZED (
  SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.k <> b.k
  WHERE list_sum(list_transform(list_zip(a.h, b.h), lambda p: bit_count(xor(p[1], p[2])::BIT))) <= 6),
r AS (SELECT k AS n, k AS c FROM x UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n),
part AS (SELECT n AS k, min(c) AS component FROM r GROUP BY n),
named AS (
  SELECT component, sha256('["theta-v1",["' || string_agg(DISTINCT sha256(k), '","' ORDER BY sha256(k)) || '"]]') AS family_id FROM part GROUP BY component)
SELECT k, component, family_id FROM part JOIN named USING (component)
""",
}
