"""Small inputs that every operator must bear: nulls, empty and long texts, ties, repeated rows, odd columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, score string, kept int, part string, `row` string, fp string, words string, whole_row int, toxic_score int"
EXTRA = (1, "a", "b", 2, "c", "d", "e", "f", 3, 4)


def texts(n=60, seed=5):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "delta.", "épsilon", "zeta", "日本", "x1", "eta\n", "THETA"]
    made = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 40, 120]))) for _ in range(n)]
    return [*made, None, "", "   ", "\n\t", made[0], made[0], "word " * 30_000, "don't  stop\x1cit's\x85 "]


def rows(extra_ids=True):
    found = [(i, t, ["en", "de", None][i % 3], "src0" if i % 3 else None, 1, *EXTRA) for i, t in enumerate(texts())]
    repeated = [found[3], found[3], found[3]]
    nulls = [(None, "no id", None, None, None, *EXTRA), (None, None, None, None, None, *EXTRA)] if extra_ids else []
    return found + repeated + nulls


def docs(spark, **kwargs):
    return spark.createDataFrame(rows(**kwargs), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
