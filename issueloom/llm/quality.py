"""Quality rules with adaptive thresholds, in Spark's own functions only.

Every whole text is measured once. The measures of texts that pass the base rules go to a mergeable quantile
sketch per (lang, source): each value falls into a bucket of about 3 % width, and a sketch is the number of
rows per bucket. Counts add up, so sketches of tasks, sources and languages merge by summing, in any order and
with the same result. A fence, beyond which a text is odd for its group, stands at a quantile of the group's
sketch, moved outwards by `reach` times the distance of a second quantile, or of `least` where they are equal.

Every group's sketch is merged with that of its language, weighted to count as PRIOR rows, and that of a language
with the one of all texts in the same way. So a group of few rows is judged much as its language is, a large one
by itself, and there is no size at which the rule changes. Weights are whole numbers, in units of 1 / UNIT.

Measures, all whole numbers: symbols per 1,000 characters of words, repeated lines per 1,000 words, words
in repeated windows per 1,000 words, and characters per 100 words (both sides).

Defined cases: null text counts as empty and fails; null lang or source is a group like any other; repeated
rows count as often as they come and share a verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from issueloom.llm.common import spare_name
from issueloom.operators.durable import durable
from issueloom.operators.skew import lookup_join

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20
SYMBOLS = "[#*$%&|<>]"
PRIOR = 50
UNIT = 4096
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Fixed shape of a sketch: values below FINE have a bucket each, larger ones share one with those that
#: agree in their leading bits (5 after the first).
FINE = 64
#: (measure, side, percentile of the fence, percentile that tells the distance, reach, least distance). Junk is
#: a share of most sources, so measures that tell junk stand on percentiles that it doesn't reach.
FENCES = [
    ("symbol_rate", "high", 85, 50, 6, 5),
    ("line_rate", "high", 99, 95, 1, 2),
    ("repeat_rate", "high", 99, 95, 1, 10),
    ("word_size", "low", 15, 50, 6, 10),
    ("word_size", "high", 85, 50, 6, 10),
]
MEASURES = list(dict.fromkeys(f[0] for f in FENCES))
#: A character of a word, for Java's patterns.
WORD = r"[^\x20\x09-\x0D]"


def with_base(rows: DataFrame, text: str) -> DataFrame:
    """Add the base measures, columns named in BASE, of a text column that has no nulls.

    Words are split once, at plain spaces after the other white space was replaced by them (a split at one
    character needs no pattern). Repeated windows: windows are hashed, and only texts with fewer distinct
    hashes than windows go on to sort them. A word counts once however many windows hold it, so each
    repeated window adds the words up to the next one.
    """
    spaced = F.col(text)
    for code in range(9, 14):
        spaced = F.replace(spaced, F.lit(chr(code)), F.lit(" "))
    split = rows.withColumn("words", F.array_remove(F.split(spaced, " "), ""))
    hashed = "xxhash64(" + ", ".join(f"m[i + {k}]" for k in range(WINDOW)) + ")"
    windows = (
        f"transform(array(transform(words, w -> xxhash64(w))), m -> CASE WHEN size(m) < {WINDOW} THEN array() "
        f"ELSE transform(sequence(0, size(m) - {WINDOW}), i -> {hashed}) END)[0]"
    )
    starts = (
        "transform(array(sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))), s -> "
        "sort_array(transform(filter(sequence(0, size(s) - 1), "
        "j -> s[j].h = get(s, j - 1).h OR s[j].h = get(s, j + 1).h), j -> s[j].i)))[0]"
    )
    repeated = (
        f"transform(array({windows}), h -> CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE "
        f"transform(array({starts}), d -> aggregate(transform(d, (x, k) -> "
        f"least({WINDOW}, coalesce(get(d, k + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x))[0] END)[0]"
    )
    lines = rf"filter(split(`{text}`, '\n'), l -> l rlike r'{WORD}')"
    return split.select(
        *[c for c in rows.columns if c != text],
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col(text), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(f"transform(array({lines}), l -> cast(size(l) - size(array_distinct(l)) AS long))[0]").alias("n_dup_lines"),
        F.expr(repeated).alias("n_repeat_words"),
    )


def rates() -> dict[str, Column]:
    """The judged measures, from the base measures."""
    per = lambda part, scale, whole: F.expr(f"{part} * {scale} div greatest({whole}, 1)")
    return {
        "symbol_rate": per("n_symbols", 1000, "word_chars"),
        "line_rate": per("n_dup_lines", 1000, "n_words"),
        "repeat_rate": per("n_repeat_words", 1000, "n_words"),
        "word_size": per("word_chars", 100, "n_words"),
    }


def bucket(value: str) -> Column:
    """The lowest value of a whole number's bucket; numbers below FINE are exact."""
    shift = f"greatest(length(bin({value})) - 6, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})")


def sketches(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Rows (lang, source, measure, bucket, n): one sketch per group and measure, of texts inside the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in MEASURES])).alias("m")
    narrow = measured.filter(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), *MEASURES)
    return (
        narrow.select("lang", "source", each)
        .select("lang", "source", "m.measure", bucket("m.value").alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def shares(sketch: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of each group as shares of its rows, in units of 1 / UNIT, rounded down."""
    total = F.sum("n").over(Window.partitionBy(*by, "measure"))
    return sketch.withColumn("_total", total).select(*by, "measure", "bucket", F.expr(f"n * {UNIT} div _total").alias("share"))


def with_prior(sketch: DataFrame, by: list[str], prior: DataFrame, of: list[str]) -> DataFrame:
    """Sketches of groups, in units of 1 / UNIT, merged with PRIOR rows that are spread as `prior` is.

    `prior` has shares per group of the columns `of`; a group's shares, a bounded number, are one array here.
    """
    entry = F.collect_list(F.struct("measure", "bucket", "share")).alias("shares")
    packed = prior.groupBy(F.struct(F.lit(0).alias("_all"), *of).alias("_of")).agg(entry)
    groups = sketch.select(*by).distinct().withColumn("_of", F.struct(F.lit(0).alias("_all"), *of))
    spread = lookup_join(groups, packed, ["_of"], "inner", by).select(*by, F.explode("shares").alias("s"))
    added = spread.select(*by, "s.measure", "s.bucket", (F.col("s.share") * PRIOR).alias("n"))
    own = sketch.select(*by, "measure", "bucket", (F.col("n") * UNIT).alias("n"))
    return merged(own.unionByName(added), by)


def fences(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row per group, with `<measure>_low` and `<measure>_high` from its sketch."""
    group = Window.partitionBy(*by, "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = sketch.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(group)})
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bucket")))
    percents = sorted({p for f in FENCES for p in f[2:4]})
    quantiles = ranks.groupBy(*by, "measure").agg(*[at(p).alias(f"q{p}") for p in percents])
    columns = []
    for name, side, stand, far, reach, least in FENCES:
        sign = "-" if side == "low" else "+"
        value = F.expr(f"q{stand} {sign} {reach} * greatest(abs(q{stand} - q{far}), {least})")
        columns.append(F.max(F.when(F.col("measure") == name, value)).alias(f"{name}_{side}"))
    return quantiles.groupBy(*by).agg(*columns)


def thresholds(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """Fences per (lang, source)."""
    sketch = durable(sketches(measured, lang, source), "sketches")
    by_lang = merged(sketch, ["lang"])
    langs = durable(with_prior(by_lang, ["lang"], shares(merged(sketch, []), []), []), "lang-sketches")
    return fences(with_prior(sketch, ["lang", "source"], shares(langs, ["lang"]), ["lang"]), ["lang", "source"])


def verdict() -> Column:
    inside = F.lit(True)
    for name, side, *_ in FENCES:
        fence = F.col(f"{name}_{side}")
        inside = inside & (F.col(name) >= fence if side == "low" else F.col(name) <= fence)
    return F.coalesce(inside, F.lit(False))


def base_failed() -> Column:
    words, repeat = F.col("n_words"), F.col("n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_SHARE * words)


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Columns `carry` of `docs`, the base measures, base_failed and kept.

    The measured rows are written once; the sketches read only their narrow columns, and the thresholds,
    a row per group, are joined back (broadcast where their counted rows are few).
    """
    slim = docs.select(
        F.struct(*carry).alias("row"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
        F.col("lang").cast("string"),
        F.col("source").cast("string"),
    )
    measured = with_base(slim, "body")
    measured = durable(measured.withColumns(rates()), "measured")
    limits = durable(thresholds(measured, "lang", "source"), "thresholds")
    names = [c for c in limits.columns if c not in ("lang", "source")]
    limits = limits.select(F.struct("lang", "source").alias("group"), *names)
    both = lookup_join(measured.withColumn("group", F.struct("lang", "source")), limits, ["group"], "left", ["row"])
    failed = base_failed()
    return both.select("row.*", *BASE, failed.alias("base_failed"), (~failed & verdict()).alias("kept"))


def judge_documents(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept of every row."""
    return judged(docs.select(F.col("doc_id").cast("long"), "text", "lang", "source"), ["doc_id"])


def without_odd(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all columns of `docs`."""
    whole = spare_name(docs, "whole_row")
    bundled = docs.withColumn(whole, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return judged(bundled, [whole]).filter("kept").select(f"{whole}.*")
