"""Quality rules with thresholds that follow the corpus, from DataFrame functions only.

A few measures are taken of every whole text. Two fixed rules (the base) reject texts that no source should hold. The
others have no fixed cutoff: for each language and source a mergeable quantile sketch of each measure is kept - counts
on a grid of bounded size, which add up whatever the partitioning - and a threshold lies a number of spreads
beyond the median, where the spread is the distance from the 10th percentile to the median. Half of a source may be
junk before its median moves, and a source of clean documents loses none of them. A source with few documents
borrows its language's sketch, a small language the sketch of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.session import materialise

#: White space between words, and characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Measures with an adaptive threshold: numerator, denominator, grid steps a unit, largest grid cell, least spread in
#: cells, and the sides that reject. A cell is an integer division, so sketches are exact to one cell everywhere.
MEASURES = (
    ("symbols", "n_symbols", "word_chars", 1000, 1000, 10, "upper"),
    ("dup_lines", "n_dup_lines", "n_lines", 1000, 1000, 80, "upper"),
    ("word_length", "word_chars", "n_words", 100, 10_000, 80, "both"),
)
SPREADS = 6
#: Groups under this many documents use a wider sketch.
MIN_GROUP = 50
#: Threshold rows up to this count (about 20 MB) are broadcast; more are joined by shuffle, with skew split by AQE.
BROADCAST_GROUPS = 200_000


def _coverage(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more; windows is the array of window hashes by position."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        at = lambda k: F.get(s, k)["h"]
        twice = F.filter(s, lambda e, i: F.coalesce(at(i - 1) == e["h"], F.lit(False)) | F.coalesce(at(i + 1) == e["h"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda e: e["i"]))

    # positions p1 < p2 < ...: each window adds the words up to the next one's start, at most WINDOW; the last adds WINDOW
    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda acc, x: acc + x.cast("long"))

    # one-element arrays bind an intermediate result, so that it is computed once
    bound = F.transform(F.transform(F.array(ordered), repeated), covered)
    return bound[0]


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words and base_failed, of whole texts.

    Null text counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({"__words": words, "__lines": lines})
    hashes = F.transform("__words", lambda w: F.xxhash64(w))
    df = df.select(
        *docs.columns,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        hashes.alias("__h"),
    )
    n = F.size("__h")
    window = F.transform(F.slice("__h", 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(F.get("__h", i + k) for k in range(1, WINDOW))))
    df = df.withColumn("__w", window)
    repeats = F.when(F.size(F.array_distinct("__w")) < F.size("__w"), _coverage(F.col("__w"))).otherwise(F.lit(0).cast("long"))
    df = df.withColumn("n_repeat_words", repeats).drop("__h", "__w")
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _cell(top: str, bottom: str, steps: int, largest: int) -> Column:
    return F.when(F.col(bottom) > 0, F.least(F.expr(f"({top} * {steps}) div {bottom}"), F.lit(largest))).otherwise(F.lit(0)).cast("int")


def sketch(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, cell, n): quantile sketches that merge by adding n; at most one row for each cell of the grid."""
    cells = F.array(*(F.struct(F.lit(name).alias("measure"), _cell(top, bottom, steps, largest).alias("cell")) for name, top, bottom, steps, largest, *_ in MEASURES))
    rows = measured.select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(cells))
    return rows.groupBy("lang", "source", "measure", "cell").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Size, 10th percentile and median of each merged sketch: the first cell that reaches the share."""
    merged = sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    running = merged.withColumns({"size": F.sum("n").over(group), "upto": F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))})
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("size") * percent, F.col("cell")))
    return running.groupBy(*keys, "measure").agg(F.first("size").alias("size"), at(10).alias("p10"), at(50).alias("p50"))


def thresholds(sketches: DataFrame) -> DataFrame:
    """One row for each (lang, source): <measure>_low and <measure>_high in grid cells, from the narrowest sketch of MIN_GROUP documents."""
    own = _quantiles(sketches, ["lang", "source"])
    by_lang = _quantiles(sketches, ["lang"]).select(F.col("lang").alias("l"), F.col("measure").alias("m"), F.col("size").alias("l_size"), F.col("p10").alias("l10"), F.col("p50").alias("l50"))
    overall = _quantiles(sketches, []).select(F.col("measure").alias("am"), F.col("p10").alias("a10"), F.col("p50").alias("a50"))
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("measure") == F.col("m")))
    both = both.join(F.broadcast(overall), F.col("measure") == F.col("am"))  # one row for each measure
    pick = lambda a, b, c: F.when(F.col("size") >= MIN_GROUP, F.col(a)).when(F.col("l_size") >= MIN_GROUP, F.col(b)).otherwise(F.col(c))
    p10, p50 = pick("p10", "l10", "a10"), pick("p50", "l50", "a50")
    least = F.create_map(*(F.lit(x) for name, *_, floor, _side in MEASURES for x in (name, floor)))
    spread = SPREADS * F.greatest(p50 - p10, F.element_at(least, F.col("measure")))
    fences = both.select("lang", "source", "measure", (p50 - spread).alias("low"), (p50 + spread).alias("high"))
    wide = [F.max(F.when(F.col("measure") == name, F.col(side))).alias(f"{name}_{side}") for name, *_ in MEASURES for side in ("low", "high")]
    return fences.groupBy("lang", "source").agg(*wide)


def judge(measured: DataFrame, fences: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured with kept: not base_failed and every measure within its group's thresholds."""
    t = fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in fences.columns if c not in ("lang", "source")))
    small = fences.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = measured.join(F.broadcast(t) if small else t, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")))
    inside = ~F.col("base_failed")
    for name, top, bottom, steps, largest, _floor, side in MEASURES:
        cell = _cell(top, bottom, steps, largest)
        inside = inside & (cell <= F.col(f"__{name}_high"))
        if side == "both":
            inside = inside & (cell >= F.col(f"__{name}_low"))
    return joined.select(*measured.columns, inside.alias("kept"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, the counts, base_failed and kept for each row of docs.

    Null text: all counts 0, base_failed. Null languages and sources are groups of their own. Null or repeated keys:
    each row is rated by itself. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    measured = materialise(measure(narrow).drop("text"), "measures")
    rated = judge(measured, materialise(thresholds(sketch(measured)), "fences"))
    return rated.select(F.col("key").alias(key), *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that pass, with their columns as they were."""
    renamed = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)))
    name = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    measured = materialise(measure(renamed, name[text]), "measured")
    fences = materialise(thresholds(sketch(measured, name[lang], name[source])), "fences")
    kept = judge(measured, fences, name[lang], name[source]).where("kept")
    return kept.select(*(F.col(n).alias(c) for c, n in name.items()))


#: DuckDB's version of rate().
SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, COALESCE(text, '') AS t FROM documents),
words AS (SELECT r, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base),
win AS (SELECT r, i, w[i:i + 4] AS s FROM (SELECT r, w, UNNEST(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, COUNT(DISTINCT i + k) AS n FROM twice, range(0, 5) g(k) GROUP BY r),
m AS (
  SELECT words.r, doc_id, lang, source, len(w) AS n_words, CAST(COALESCE(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, COALESCE(covered.n, 0) AS n_repeat_words
  FROM words JOIN lines USING (r) LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN LEAST(n_symbols * 1000 // word_chars, 1000) ELSE 0 END AS c1,
         CASE WHEN n_lines > 0 THEN LEAST(n_dup_lines * 1000 // n_lines, 1000) ELSE 0 END AS c2,
         CASE WHEN n_words > 0 THEN LEAST(word_chars * 100 // n_words, 10000) ELSE 0 END AS c3 FROM m),
q AS (
  SELECT r, COUNT(*) OVER g AS gn, COUNT(*) OVER h AS hn,
    quantile_disc(c1, 0.1) OVER g AS g1a, quantile_disc(c1, 0.5) OVER g AS g1b, quantile_disc(c2, 0.1) OVER g AS g2a, quantile_disc(c2, 0.5) OVER g AS g2b, quantile_disc(c3, 0.1) OVER g AS g3a, quantile_disc(c3, 0.5) OVER g AS g3b,
    quantile_disc(c1, 0.1) OVER h AS h1a, quantile_disc(c1, 0.5) OVER h AS h1b, quantile_disc(c2, 0.1) OVER h AS h2a, quantile_disc(c2, 0.5) OVER h AS h2b, quantile_disc(c3, 0.1) OVER h AS h3a, quantile_disc(c3, 0.5) OVER h AS h3b,
    quantile_disc(c1, 0.1) OVER () AS a1a, quantile_disc(c1, 0.5) OVER () AS a1b, quantile_disc(c2, 0.1) OVER () AS a2a, quantile_disc(c2, 0.5) OVER () AS a2b, quantile_disc(c3, 0.1) OVER () AS a3a, quantile_disc(c3, 0.5) OVER () AS a3b
  FROM f WINDOW g AS (PARTITION BY lang, source), h AS (PARTITION BY lang)),
p AS (SELECT r, CASE WHEN gn >= 50 THEN g1a WHEN hn >= 50 THEN h1a ELSE a1a END AS q1a, CASE WHEN gn >= 50 THEN g1b WHEN hn >= 50 THEN h1b ELSE a1b END AS q1b,
    CASE WHEN gn >= 50 THEN g2a WHEN hn >= 50 THEN h2a ELSE a2a END AS q2a, CASE WHEN gn >= 50 THEN g2b WHEN hn >= 50 THEN h2b ELSE a2b END AS q2b,
    CASE WHEN gn >= 50 THEN g3a WHEN hn >= 50 THEN h3a ELSE a3a END AS q3a, CASE WHEN gn >= 50 THEN g3b WHEN hn >= 50 THEN h3b ELSE a3b END AS q3b FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND c1 <= q1b + 6 * GREATEST(q1b - q1a, 10) AND c2 <= q2b + 6 * GREATEST(q2b - q2a, 80)
  AND c3 <= q3b + 6 * GREATEST(q3b - q3a, 80) AND c3 >= q3b - 6 * GREATEST(q3b - q3a, 80) AS kept
FROM f JOIN p USING (r)
"""
