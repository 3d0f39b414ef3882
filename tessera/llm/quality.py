"""Quality rules with thresholds from mergeable quantile sketches of each language and source.

DataFrame operations only. A row's measures come from its own text in one pass and are written to the shared folder.
The sketch of a group is the number of its rows in each bucket of relative width: bucket b holds the values in
(GAMMA^(b-1), GAMMA^b], zero has a bucket of its own, and a quantile is the bucket's middle, so it is off by ACCURACY
of its value at most. Counts add up, so sketches merge exactly, in any order and with the same result in every run.
Sketches of the ratios over the rows that pass the base rules are built for each (lang, source), added up to languages
and to the whole, and the fences are joined back. A fence is q75 + REACH * (q75 - q25), for word lengths also
q25 - REACH * (q75 - q25). Most texts have no symbol, repeated line or repeated words at all, so quartiles of all rows
say nothing of these shares: the buckets above zero give quartiles of their own.

- Repeats and duplicate lines are ordinary where they occur, so their quartiles are those of the part above zero.
- Symbols are not: the quartiles are those of all rows, and the fence is at least half the lower quartile of the part
  above zero over q75. Where nothing is above zero, FLOORS are the only spread; they are far below that of the tables.

Groups of fewer than FEW rows (of such rows above zero for that part) use their language's fences, and languages of
fewer than FEW the whole's. A ratio on its fence is within it.

Null texts have no words and fail the base rules; a null lang or source is a group of its own; repeated rows are each
judged; texts may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT, HOT_ROWS, cut, joined, let, table

FEW, REACH = 200, 4.0
#: Relative error of a quantile, and the growth of the buckets' bounds that gives it.
ACCURACY = 0.005
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: The bucket of zero; all others are above it.
ZERO = -(1 << 30)
#: Groups (of 60 bytes and their names) up to which the fences are broadcast.
BROADCAST = 100_000
#: Least distance of a fence from its quartile.
FLOORS = {"symbol_share": 0.02, "dup_line_share": 0.02, "repeat_share": 0.02, "word_length": 0.2}
#: Ratios whose part above zero has quartiles of its own.
SHARES = ["symbol_share", "dup_line_share", "repeat_share"]


def _repeats(words: Column) -> Column:
    """Words inside 3-word windows found twice or more. Equal 40-bit hashes only nominate; the words themselves decide."""

    def nominated(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - 2, F.lit(1))), lambda i: F.shiftleft(F.xxhash64(F.slice(ws, i, 3)), 24) + i.cast("long"))
        return let(F.sort_array(grams), lambda g: F.transform(
            F.filter(F.transform(g, lambda x, j: F.when(
                (F.shiftright(x, 24) == F.shiftright(F.get(g, j - 1), 24)) | (F.shiftright(x, 24) == F.shiftright(F.get(g, j + 1), 24)), x)), lambda x: x.isNotNull()),
            lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")))

    def decided(ws: Column, at: Column) -> Column:
        named = F.array_sort(F.transform(at, lambda i: F.struct(F.array_join(F.slice(ws, i, 3), " ").alias("t"), i.alias("i"))))
        return let(named, lambda g: F.array_sort(F.transform(
            F.filter(F.transform(g, lambda x, j: F.when((x["t"] == F.get(g, j - 1)["t"]) | (x["t"] == F.get(g, j + 1)["t"]), x)), lambda x: x.isNotNull()),
            lambda x: x["i"])))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    count = lambda at: F.aggregate(at, start, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])
    exact = lambda ws, at: F.when(F.size(at) == 0, F.lit(0)).otherwise(count(decided(ws, at)))
    all_places = lambda ws: F.sequence(F.lit(1), F.size(ws) - 2)
    # beyond 2^24 words a place no longer fits beside its hash; then every window is compared as text
    return let(words, lambda ws: F.when(F.size(ws) < 3, F.lit(0)).when(F.size(ws) < (1 << 24), let(nominated(ws), lambda at: exact(ws, at))).otherwise(exact(ws, all_places(ws))))


def measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"), F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    return d.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.octet_length("t") - F.octet_length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        _repeats(F.col("w")).cast("long").alias("n_repeat_words"),
    )


def _ratios(df: DataFrame) -> DataFrame:
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return df.withColumns({"symbol_share": share("n_symbols", "word_chars"), "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")})


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def bucket(value: Column) -> Column:
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(log(GAMMA))).cast("int")).otherwise(ZERO)


def middle(b: Column) -> Column:
    """The value that stands for a bucket."""
    return F.when(b == ZERO, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b.cast("double")) * (2 / (GAMMA + 1)))


def _group() -> Column:
    """(lang, source) as one string that differs for any two pairs, nulls too; it serves as a key where null would not."""
    part = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")))
    return F.concat(part("lang"), part("source"))


def sketches(rated: DataFrame) -> DataFrame:
    """lang, source, m, b, c: how many rows that pass the base rules have the measure m in bucket b."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("m"), bucket(F.col(c)).alias("b")) for c in FLOORS))).alias("x")
    return rated.filter(~_base_failed()).select("lang", "source", each).groupBy("lang", "source", "x.m", "x.b").agg(F.count("*").alias("c"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, m, n, q25, q75 of sketches that are added up by the keys; for SHARES also of the part above zero, as m = some_..."""
    some = sketch.filter((F.col("b") != ZERO) & F.col("m").isin(SHARES)).withColumn("m", F.concat(F.lit("some_"), "m"))
    s = sketch.union(some).groupBy(*keys, "m", "b").agg(F.sum("c").alias("c"))
    w = Window.partitionBy(*keys, "m")  # as many rows as a sketch has buckets
    s = s.withColumns({"n": F.sum("c").over(w), "upto": F.sum("c").over(w.orderBy("b"))})
    q = lambda p: middle(F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("b"))))
    return s.groupBy(*keys, "m").agg(F.max("n").alias("n"), q(0.25).alias("q25"), q(0.75).alias("q75"))


def thresholds(rated: DataFrame) -> DataFrame:
    """g (the group's key), lang, source and the fences of each group, from sketches merged upwards where a group is small."""
    own = cut(sketches(rated))
    groups = rated.select("lang", "source").distinct()
    parts = [*FLOORS, *(f"some_{c}" for c in SHARES)]

    def wide(q: DataFrame, p: str, *keys: str) -> DataFrame:
        of = lambda c, m: F.max(F.when(F.col("m") == m, F.col(c))).alias(f"{p}_{c}_{m}")
        got = q.groupBy(*keys) if keys else q.groupBy()
        return got.agg(*(of(c, m) for c in ("n", "q25", "q75") for m in parts)).withColumnsRenamed({k: f"{p}_{k}" for k in keys})

    levels = [wide(quartiles(own, "lang", "source"), "o", "lang", "source"), wide(quartiles(own, "lang"), "l", "lang"), wide(quartiles(own), "w")]
    j = groups.join(levels[0], F.col("lang").eqNullSafe(F.col("o_lang")) & F.col("source").eqNullSafe(F.col("o_source")), "left")
    j = j.join(levels[1], F.col("lang").eqNullSafe(F.col("l_lang")), "left").crossJoin(F.broadcast(levels[2]))  # one row
    pick = lambda m, q: F.coalesce(*(F.when(F.col(f"{p}_n_{m}") >= FEW, F.col(f"{p}_{q}_{m}")) for p in "ol"), F.col(f"w_{q}_{m}"), F.lit(0.0))
    reach = lambda m, floor: F.greatest((pick(m, "q75") - pick(m, "q25")) * REACH, F.lit(floor))
    fences = {f"most_{c}": pick(f"some_{c}", "q75") + reach(f"some_{c}", FLOORS[c]) for c in ("dup_line_share", "repeat_share")}
    fences["most_symbol_share"] = pick("symbol_share", "q75") + F.greatest(reach("symbol_share", FLOORS["symbol_share"]), pick("some_symbol_share", "q25") / 2)
    fences["most_word_length"] = pick("word_length", "q75") + reach("word_length", FLOORS["word_length"])
    fences["least_word_length"] = pick("word_length", "q25") - reach("word_length", FLOORS["word_length"])
    return j.select(_group().alias("g"), "lang", "source", *(v.alias(k) for k, v in fences.items()))


def quality(docs: DataFrame) -> DataFrame:
    """The measures of every document, base_failed and kept, with the ratios that were over their fences."""
    rated = _ratios(cut(measures(docs)))
    t = cut(thresholds(rated)).drop("lang", "source")
    base = _base_failed()
    over = F.array_compact(F.array(*(F.when(F.col(c) > F.col(f"most_{c}"), F.lit(c)) for c in FLOORS), F.when(F.col("word_length") < F.col("least_word_length"), F.lit("short_words"))))
    keyed = rated.withColumn("g", _group())
    if t.count() <= BROADCAST:
        j = keyed.join(F.broadcast(t), "g")
    else:
        sizes = rated.groupBy(_group().alias("g")).agg(F.count("*").alias("n"))
        hot = cut(sizes.filter(F.col("n") > max(HOT_ROWS, rated.count() // HOT)).select("g"))
        j = joined(keyed, t, ["g"], "inner", hot)
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (F.size(over) == 0)).alias("kept"), F.array_join(over, ",").alias("over"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts = [*FLOORS, *(f"some_{c}" for c in SHARES)]
    pick = lambda m, q: f"coalesce(CASE WHEN on_{m} >= {FEW} THEN o{q}_{m} END, CASE WHEN ln_{m} >= {FEW} THEN l{q}_{m} END, w{q}_{m}, 0.0)"
    reach = lambda m, floor: f"greatest(({pick(m, 'q75')} - {pick(m, 'q25')}) * {REACH}, {floor})"
    most = {c: f"{pick('some_' + c, 'q75')} + {reach('some_' + c, FLOORS[c])}" for c in ("dup_line_share", "repeat_share")}
    most["symbol_share"] = f"{pick('symbol_share', 'q75')} + greatest({reach('symbol_share', FLOORS['symbol_share'])}, {pick('some_symbol_share', 'q25')} / 2)"
    most["word_length"] = f"{pick('word_length', 'q75')} + {reach('word_length', FLOORS['word_length'])}"
    least = f"{pick('word_length', 'q25')} - {reach('word_length', FLOORS['word_length'])}"
    over = ", ".join([*(f"CASE WHEN {c} > {most[c]} THEN '{c}' END" for c in FLOORS), f"CASE WHEN word_length < {least} THEN 'short_words' END"])
    # a level: own (o), language (l) or whole (w); g names the group at that level
    level = lambda p, g: f"SELECT '{p}' AS lv, {g} AS g, m, b, sum(c) AS c FROM sk GROUP BY ALL"
    wide = lambda p: ", ".join(f"max(CASE WHEN m = '{m}' THEN {c} END) AS {p}{c}_{m}" for c in ("n", "q25", "q75") for m in parts)
    mid = lambda b: f"CASE WHEN {b} = {ZERO} THEN 0.0 ELSE pow({GAMMA!r}, {b}) * {2 / (GAMMA + 1)!r} END"
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT row_number() OVER () AS row, *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g3 AS (SELECT row, i, w[i:i + 2] AS x FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT row, i, count(*) OVER (PARTITION BY row, x) AS n FROM g3),
rep AS (SELECT row, count(DISTINCT p) AS r FROM (SELECT row, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY row),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (row)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share, word_chars / greatest(n_words, 1) AS word_length FROM m),
s0 AS (SELECT lang, source, unnest([{", ".join(f"{{'m': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in FLOORS)}]) AS x FROM r WHERE NOT base_failed),
s1 AS (SELECT lang, source, x.m AS m, CASE WHEN x.v > 0 THEN CAST(ceil(ln(x.v) / {log(GAMMA)!r}) AS INTEGER) ELSE {ZERO} END AS b, count(*) AS c FROM s0 GROUP BY ALL),
sk AS (SELECT * FROM s1 UNION ALL SELECT lang, source, 'some_' || m, b, c FROM s1 WHERE b <> {ZERO} AND m <> 'word_length'),
lv AS ({level('o', "{'a': lang, 'b': source}")} UNION ALL {level('l', "{'a': lang, 'b': NULL}")} UNION ALL {level('w', "{'a': NULL, 'b': NULL}")}),
cu AS (SELECT lv, g, m, b, sum(c) OVER (PARTITION BY lv, g, m) AS n, sum(c) OVER (PARTITION BY lv, g, m ORDER BY b) AS upto FROM lv),
qb AS (SELECT lv, g, m, max(n) AS n, min(CASE WHEN upto > floor(0.25 * (n - 1)) THEN b END) AS b25, min(CASE WHEN upto > floor(0.75 * (n - 1)) THEN b END) AS b75 FROM cu GROUP BY ALL),
q AS (SELECT lv, g, m, n, {mid('b25')} AS q25, {mid('b75')} AS q75 FROM qb),
o AS (SELECT g.a AS o_lang, g.b AS o_source, {wide('o')} FROM q WHERE lv = 'o' GROUP BY ALL),
la AS (SELECT g.a AS l_lang, {wide('l')} FROM q WHERE lv = 'l' GROUP BY ALL),
wh AS (SELECT {wide('w')} FROM q WHERE lv = 'w'),
j AS (SELECT * FROM r LEFT JOIN o ON o_lang IS NOT DISTINCT FROM lang AND o_source IS NOT DISTINCT FROM source LEFT JOIN la ON l_lang IS NOT DISTINCT FROM lang CROSS JOIN wh),
f AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, list_filter([{over}], lambda x: x IS NOT NULL) AS o FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(o) = 0 AS kept, array_to_string(o, ',') AS "over" FROM f
"""


OP5_SQL = _sql()
