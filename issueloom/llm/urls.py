"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Only Spark's own functions and feature transformers are used. Host and path are cut out of the url as text: the host is what follows
the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; the path goes on up to "?", "#" or the
end. A rule fits its host and all subdomains if the path starts with the rule's; the longest rule decides.

The small labelled table for the model holds urls and whether they are blocked. `labelled_by_rules` makes
one from the distinct (host, path) that the rules decide, at most `per_class` of each verdict, those with
the smallest hash. A row's features are its distinct n-grams (3 to 5 characters, digits all taken for 0),
hashed into buckets by Spark's HashingTF; Spark's LogisticRegression fits and scores them inside the JVM.

Defined cases: a null url, or one without "://", has empty host and path and is judged by its few n-grams;
repeated rows are judged alike; without labelled urls of both verdicts the model allows all (only rules
block); an empty table gives no rows; columns besides page_id and url are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issueloom.operators.durable import checkpoint_dir, durable

#: The rules (host, path, verdict) of the query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
ORDERS = (3, 4, 5)
BUCKETS = 4_096
PER_CLASS = 2_000
STEPS = 50
RIDGE = 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of columns host and path; null without a fitting rule."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule is asked before
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def grams() -> Column:
    """The distinct character n-grams of columns host and path, which are marked apart; digits are all 0."""
    text = "regexp_replace(concat('^', host, '|', path, '$'), '[0-9]', '0')"
    each = ", ".join(f"transform(sequence(1, greatest(length(t) - {n - 1}, 1)), i -> substr(t, i, {n}))" for n in ORDERS)
    return F.expr(f"transform(array({text}), t -> array_distinct(concat({each})))[0]")


def judged_by_rules(pages: DataFrame, rules=RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    host, path = host_and_path()
    cut = pages.select(*carry, host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(rules)
    return cut.withColumns({"rule": name, "rule_verdict": verdict})


def labelled_by_rules(pages: DataFrame, rules=RULES, per_class: int = PER_CLASS) -> DataFrame:
    """(host, path, blocked 0/1), at most `per_class` rows of each."""
    known = judged_by_rules(pages, rules).filter("rule_verdict IS NOT NULL").select("host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked")).distinct()
    order = [F.xxhash64("host", "path"), F.col("host"), F.col("path")]
    some = lambda value: known.filter(F.col("blocked") == value).orderBy(*order).limit(per_class)
    return some(0).unionByName(some(1))


def hashed(rows: DataFrame, buckets: int) -> DataFrame:
    """Add `features`: which buckets the hashes of the n-grams fall into."""
    tf = HashingTF(numFeatures=buckets, binary=True, inputCol="grams", outputCol="features")
    return tf.transform(rows.withColumn("grams", grams())).drop("grams")


def train(labelled: DataFrame, buckets: int = BUCKETS, ridge: float = RIDGE, steps: int = STEPS) -> LogisticRegressionModel | None:
    """Fit to rows (host, path, blocked 0/1); classes weigh alike. None unless both verdicts occur."""
    rows = durable(labelled.select("host", "path", F.col("blocked").cast("double").alias("label")), "url-labels")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    share = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values())
    fit = LogisticRegression(regParam=ridge, maxIter=steps, standardization=False, weightCol="share")
    fitted = fit.fit(hashed(rows.withColumn("share", share), buckets))
    # Written and read back: the fitted object holds its training summary, which tasks can't be sent.
    spark = labelled.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/url-model-{uuid.uuid4().hex}"
    fitted.write().save(path)
    return LogisticRegressionModel.load(path)


def judge(pages: DataFrame, model: LogisticRegressionModel | None, rules=RULES, buckets: int = BUCKETS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (the model's, of every row; 0 without a model)."""
    ruled = judged_by_rules(pages.select(F.col("page_id").cast("long"), "url"), rules, ("page_id",))
    if model is None:
        scored = ruled.withColumn("score", F.lit(0.0))
    else:
        scored = model.transform(hashed(ruled, buckets)).withColumn("score", vector_to_array("probability")[1])
    by_model = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "score")
