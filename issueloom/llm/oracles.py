"""DuckDB SQL for the operators that SQL can express. Kept apart from the Spark code on purpose."""

from __future__ import annotations

from issueloom.llm.quality import FENCES, MAX_REPEAT_SHARE, MEASURES, MIN_WORDS, PRIOR, UNIT

CLUSTERS, ROUNDS = 16, 3
STRIPPED = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

PERCENTS = sorted({p for f in FENCES for p in f[2:4]})


def _fence(name: str, side: str, stand: int, far: int, reach: int, least: int) -> str:
    sign = "-" if side == "low" else "+"
    return f"max(q{stand} {sign} {reach} * greatest(abs(q{stand} - q{far}), {least})) FILTER (measure = '{name}') AS {name}_{side}"


QUALITY = rf"""
WITH v_doc AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body, lang, source FROM documents),
v_split AS (
  SELECT *, list_filter(regexp_split_to_array(body, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM v_doc),
v_start AS (
  SELECT row_id, words, unnest(range(1, len(words) - 3)) AS spot FROM v_split WHERE len(words) >= 5),
v_window AS (
  SELECT row_id, spot, count(*) OVER (PARTITION BY row_id, array_to_string(words[spot:spot + 4], ' ')) AS times FROM v_start),
v_gap AS (
  SELECT row_id, least(5, coalesce(lead(spot) OVER (PARTITION BY row_id ORDER BY spot) - spot, 5)) AS adds
  FROM v_window WHERE times > 1),
v_repeat AS (SELECT row_id, CAST(sum(adds) AS BIGINT) AS n FROM v_gap GROUP BY row_id),
v_base AS (
  SELECT s.row_id, doc_id, lang, source, len(words) AS n_words,
         coalesce(CAST(list_sum(list_transform(words, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM v_split s LEFT JOIN v_repeat r USING (row_id)),
v_rate AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_words, 1) AS line_rate,
         n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 100 // greatest(n_words, 1) AS word_size,
         n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_SHARE} * n_words AS base_failed
  FROM v_base),
v_value AS (
  UNPIVOT (SELECT lang, source, {", ".join(MEASURES)} FROM v_rate WHERE NOT base_failed)
  ON {", ".join(MEASURES)} INTO NAME measure VALUE v),
v_sketch AS (
  SELECT lang, source, measure, bucket, count(*) AS n FROM (
    SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM v_value)
  GROUP BY lang, source, measure, bucket),
v_all AS (SELECT measure, bucket, sum(n) * {UNIT} // sum(sum(n)) OVER (PARTITION BY measure) AS share FROM v_sketch GROUP BY measure, bucket),
v_lang AS (
  SELECT lang, measure, bucket, sum(n) AS n FROM (
    SELECT lang, measure, bucket, n * {UNIT} AS n FROM v_sketch
    UNION ALL SELECT lang, measure, bucket, share * {PRIOR} FROM (SELECT DISTINCT lang FROM v_sketch) CROSS JOIN v_all)
  GROUP BY lang, measure, bucket),
v_share AS (SELECT *, n * {UNIT} // sum(n) OVER (PARTITION BY lang, measure) AS share FROM v_lang),
v_group AS (
  SELECT lang, source, measure, bucket, sum(n) AS n FROM (
    SELECT lang, source, measure, bucket, n * {UNIT} AS n FROM v_sketch
    UNION ALL SELECT g.lang, g.source, s.measure, s.bucket, s.share * {PRIOR}
    FROM (SELECT DISTINCT lang, source FROM v_sketch) g JOIN v_share s ON g.lang IS NOT DISTINCT FROM s.lang)
  GROUP BY lang, source, measure, bucket),
v_quantile AS (
  SELECT lang, source, measure, {", ".join(f"min(bucket) FILTER (upto * 100 >= total * {p}) AS q{p}" for p in PERCENTS)} FROM (
    SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total
    FROM v_group) GROUP BY lang, source, measure),
v_limit AS (SELECT lang, source, {", ".join(_fence(*f) for f in FENCES)} FROM v_quantile GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"{f[0]} {'>=' if f[1] == 'low' else '<='} {f[0]}_{f[1]}" for f in FENCES)} AS kept
FROM v_rate r LEFT JOIN v_limit l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source"""


def _round(k: int) -> str:
    """Every vector compared with every centroid, and the centroids that follow."""
    apart = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"""
v_near{k} AS (
  SELECT row_id, vec_id, v, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, c) AS place
    FROM (SELECT x.row_id, x.vec_id, x.v, c.c, CAST({apart} AS BIGINT) AS d FROM v_vec x CROSS JOIN v_c{k} c)) WHERE place = 1),
v_c{k + 1} AS (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM v_c{k} o LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n
          FROM (SELECT c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM v_near{k}) GROUP BY c, i)
    GROUP BY c) m USING (c))"""


CLUSTERING = f"""
WITH v_vec AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v_c0 AS (
  SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v_vec) WHERE c < {CLUSTERS}),
{",".join(_round(k) for k in range(ROUNDS + 1))}
SELECT vec_id, CAST(n.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM v_near{ROUNDS} n JOIN v_c{ROUNDS} o ON n.c = o.c"""

LINES = rf"""
WITH v_line AS (
  SELECT row_id, doc_id, i, line, {LOWER.format(STRIPPED)} AS key
  FROM (SELECT row_id, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
v_repeat AS (
  SELECT key, max(doc_id) AS keeper FROM v_line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
v_kept AS (
  SELECT l.*, r.key IS NOT NULL AND l.doc_id IS DISTINCT FROM r.keeper AS gone FROM v_line l LEFT JOIN v_repeat r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM v_kept GROUP BY row_id, doc_id"""

PHRASES = rf"""
WITH v_piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?
-
]')) AS piece
  FROM documents),
v_words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM v_piece),
v_gram AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM v_words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM v_words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM v_words),
v_f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM v_gram GROUP BY lang, size, phrase),
v_n AS (SELECT lang, sum(f) AS n FROM v_f WHERE size = 1 GROUP BY lang),
v_cut AS (
  SELECT lang, phrase, size, f AS a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM v_f WHERE size > 1 AND f >= 10)),
v_score AS (
  SELECT c.lang, c.phrase, c.size, c.a, c.k, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score
  FROM v_cut c JOIN v_f h ON c.lang = h.lang AND c.head = h.phrase JOIN v_f t ON c.lang = t.lang AND c.tail = t.phrase),
v_low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM v_score) WHERE place = 1),
v_inner AS (
  SELECT lang, phrase, max(f) AS longer FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, f FROM v_f WHERE size = 3 AND f >= 10
    UNION ALL SELECT lang, w[2] || ' ' || w[3], f FROM v_f WHERE size = 3 AND f >= 10) GROUP BY lang, phrase),
v_rank AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(c.phrase)) AS rank
  FROM v_low c LEFT JOIN v_inner i ON c.lang = i.lang AND c.phrase = i.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * c.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM v_rank JOIN v_n USING (lang) WHERE rank <= 2000"""

LLM_ORACLES: dict[str, str] = {
    "op9_quality_rules": QUALITY,
    "op11_orchard_clustering": CLUSTERING,
    "op12_line_dedup": LINES,
    "op13_phrase_collocations": PHRASES,
}
