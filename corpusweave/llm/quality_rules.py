"""Quality rules with adaptive thresholds (native).

Per language and source, each metric has a mergeable quantile sketch: a histogram over buckets of fixed
relative width, kept as (bucket, count) rows. Sketches merge by adding counts, so partial sketches are made
before the shuffle, results don't depend on the order, and the sketch of a language or of everything is the
sum of its parts. Quartiles from the sketch set Tukey fences, which replace fixed cutoffs; a joined filter
applies them. Every group's sketch is merged with its language's, which weighs as ``PRIOR`` rows, and a language's with
that of all rows likewise: the fewer rows a group has, the nearer are its fences to its language's, at every size.

A fence lies ``FENCE`` spreads beyond a quartile; the spread is the distance of the quartiles, but not less than the
metric's floor, as most texts have no symbols, shouts or repeats at all.

Edge cases: a null or blank text has no words, fails the base rules and enters no sketch; a null language or
source is a group of its own; repeated rows count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import let, materialize

SPACE = r"[\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
PRIOR = 200
FENCE = 4
#: Metric -> (numerator, denominator, least spread in thousandths, whether low values are fenced too).
METRICS = {
    "word_length": ("word_chars", "n_words", 400, True),
    "symbols": ("n_symbols", "n_words", 20, False),
    "dup_lines": ("n_dup_lines", "n_lines", 90, False),
    "repeats": ("n_repeat_words", "n_words", 60, False),
    "shouting": ("n_shouts", "n_words", 40, False),
}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text; windows are sorted, never compared pairwise."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            again = F.filter(s, lambda e, i: same(e, i + 1) | ((i > 0) & same(e, i - 1)))
            return F.sort_array(F.transform(again, lambda e: e["i"]))

        return let(let(ranked, starts), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x))

    def per_text(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(repeats)

    return let(words, per_text)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(BLANK)) != "")
    drop = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = words_of(text)
    base = docs.select(
        "doc_id", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, BLANK, "")).cast("long").alias("word_chars"),
        drop(SYMBOLS).cast("long").alias("n_symbols"),
        drop("!").cast("long").alias("n_shouts"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"))
    return base.select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_shouts")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(value: Column) -> Column:
    """Lower edge of the bucket of a non-negative whole number: exact below 1024, then 10 leading bits (relative error under 0.2 %)."""
    shift = F.greatest(F.length(F.bin(value)) - 10, F.lit(0))
    step = F.pow(F.lit(2), shift).cast("long")
    return value - F.pmod(value, step)


def thousandths(metric: str) -> Column:
    top, bottom, *_ = METRICS[metric]
    return F.floor(1000 * F.col(top) / F.col(bottom)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, bucket, n: one sparse sketch per language, source and metric."""
    entry = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), bucket(thousandths(m)).alias("bucket")) for m in METRICS)))
    return (measured.where(F.col("n_words") > 0).select("lang", "source", entry.alias("e"))
            .groupBy("lang", "source", "e.metric", "e.bucket").agg(F.count("*").alias("n")))


def merged(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, metric, bucket, weight: each group's sketch with its language's as ``prior`` rows, that one's with all rows' as ``prior`` rows.

    Weights are whole numbers over a common denominator, so no order of addition changes them. A language has at most as
    many rows here as its groups have buckets.
    """
    exact = lambda c: c.cast("decimal(38,0)")
    whole = sketch.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))
    total = whole.groupBy("metric").agg(F.sum("n").alias("rows"))
    whole = whole.join(total, "metric")
    lang = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("own"))
    size = lang.groupBy("lang", "metric").agg(F.sum("own").alias("lang_rows"))
    every = size.join(whole, "metric").select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("bucket").alias("b"), "n", "rows", "lang_rows")
    same = lambda x, y, keys: [x[k].eqNullSafe(y[k[0]]) for k in keys]
    lang = every.join(lang, same(lang, every, ("lang", "metric", "bucket")), "left")
    lang = lang.select("l", "m", "b", (exact(F.coalesce("own", F.lit(0))) * F.col("rows") + prior * exact(F.col("n"))).alias("lang_weight"), (exact(F.col("rows")) * (F.col("lang_rows") + prior)).alias("scale"))
    groups = sketch.select("lang", "source", "metric").distinct()
    spread = groups.join(lang, [groups["lang"].eqNullSafe(lang["l"]), groups["metric"] == lang["m"]]).select(F.col("lang").alias("g"), F.col("source").alias("s"), F.col("metric").alias("m"), F.col("b"), "lang_weight", "scale")
    own = sketch.select("lang", "source", "metric", "bucket", "n")
    both = spread.join(own, [spread["g"].eqNullSafe(own["lang"]), spread["s"].eqNullSafe(own["source"]), spread["m"] == own["metric"], spread["b"] == own["bucket"]], "left")
    weight = exact(F.coalesce("n", F.lit(0))) * F.col("scale") + prior * F.col("lang_weight")
    return both.select(F.col("g").alias("lang"), F.col("s").alias("source"), F.col("m").alias("metric"), F.col("b").alias("bucket"), weight.cast("decimal(38,0)").alias("weight"))


def quartiles(weighted: DataFrame) -> DataFrame:
    """lang, source, metric, q1, q3. A window's partition holds the buckets of one sketch, a bounded number."""
    by = ["lang", "source", "metric"]
    upto, rows = Window.partitionBy(*by).orderBy("bucket"), Window.partitionBy(*by)
    ranked = weighted.withColumn("upto", F.sum("weight").over(upto)).withColumn("rows", F.sum("weight").over(rows))
    at = lambda quarter: F.min(F.when(4 * F.col("upto") >= quarter * F.col("rows"), F.col("bucket")))
    return ranked.groupBy(*by).agg(at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and, for each metric, the lowest and highest value kept."""
    q = quartiles(merged(sketch, prior))
    out = []
    for m, (_, _, spread, low) in METRICS.items():
        here, width = F.col("metric") == m, F.greatest(F.col("q3") - F.col("q1"), F.lit(spread))
        out.append(F.max(F.when(here, F.col("q3") + FENCE * width)).alias(f"{m}_max"))
        if low:
            out.append(F.max(F.when(here, F.col("q1") - FENCE * width)).alias(f"{m}_min"))
    return q.groupBy("lang", "source").agg(*out)


def apply_rules(docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed and kept, for every row of ``docs``. Texts are read once and never shuffled."""
    measured = materialize(measure(docs), "quality-counts")
    sketch = materialize(sketches(measured), "sketches")
    limits = thresholds(sketch, prior).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    joined = measured.join(limits, measured["lang"].eqNullSafe(limits["t_lang"]) & measured["source"].eqNullSafe(limits["t_source"]), "left")
    fine = F.lit(True)
    for m, (_, _, _, low) in METRICS.items():
        fine &= thousandths(m) <= F.col(f"{m}_max")
        if low:
            fine &= thousandths(m) >= F.col(f"{m}_min")
    failed = base_failed()
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                         F.when(failed, F.lit(False)).otherwise(fine).alias("kept"))
