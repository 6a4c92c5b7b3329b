"""DuckDB SQL for the queries, over the same tables. Kept apart from the Spark code on purpose."""

from __future__ import annotations

from issueloom.plans.queries import (
    DOC_PROMPT,
    GLOBAL_LIMIT,
    ISSUE_PROMPT,
    LARGE_LIMIT,
    PER_REPO_LIMIT,
    PREAMBLE,
    SIMILARITY,
    SINCE,
    TALLY_LIMIT,
)

V_ISSUE = """
v_issue AS (
  SELECT o_orderkey AS number, 'acme/r' || (o_custkey % 10) AS repo,
         CAST(o_custkey % 10 AS INTEGER) AS repo_pos, o_orderkey // 100 AS page,
         CAST(o_orderkey % 100 AS INTEGER) AS pos, 'Order | ' || o_orderkey AS title,
         o_orderpriority AS body, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END AS state,
         o_orderstatus = 'P' AS is_pr, o_orderdate AS updated_at,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_text,
         'https://x/' || o_orderkey AS html_url, o_totalprice AS score
  FROM orders)"""

# Repository 8 has no text, and repository 7 a second, longer one.
IN_LOOKBACK = """updated_at >= TIMESTAMP '2001-08-01 00:00:00' - to_days(CAST(CASE repo_pos WHEN 8 THEN 730 WHEN 7 THEN 180
          ELSE CASE repo_pos % 5 WHEN 0 THEN 730 WHEN 1 THEN 180 WHEN 2 THEN 30 WHEN 3 THEN 365 ELSE 730 END END AS INTEGER))"""

V_REACTION = """
v_reaction AS (
  SELECT i.repo, i.number, l_linenumber,
         CASE l_returnflag || l_linestatus WHEN 'RO' THEN '+1' WHEN 'RF' THEN 'heart' WHEN 'AO' THEN 'rocket'
              WHEN 'NF' THEN 'eyes' WHEN 'AF' THEN 'confused' ELSE '-1' END AS content
  FROM lineitem JOIN v_issue i ON l_orderkey = i.number),
v_count AS (
  SELECT repo, number, count(*) AS total,
         count(*) FILTER (content IN ('+1', 'heart', 'hooray', 'rocket', 'eyes')) AS positive
  FROM v_reaction GROUP BY repo, number)"""

V_PRIORITY = """
v_priority AS (
  SELECT 'acme/r' || (o_custkey % 10) AS repo, CAST(0 AS BIGINT) AS batch_id, o_orderkey AS pos,
         o_orderkey AS issue_id,
         CASE o_orderpriority[1] WHEN '1' THEN 'P0' WHEN '2' THEN 'P1' WHEN '3' THEN 'P2' WHEN '5' THEN 'P9' END
           AS priority,
         o_orderpriority AS reasoning
  FROM orders),
v_ranked AS (
  SELECT *, CASE coalesce(priority, 'P2') WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 ELSE 3 END AS rank
  FROM v_priority)"""

V_LOG = """
v_log AS (
  SELECT i.repo, CAST(0 AS BIGINT) AS batch_id,
         l_linenumber * 3 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pos,
         l_orderkey AS issue_id,
         'P' || l_linenumber AS priority, l_returnflag AS reasoning
  FROM lineitem JOIN v_issue i ON l_orderkey = i.number),
v_last AS (
  SELECT * FROM v_log
  QUALIFY row_number() OVER (PARTITION BY repo, issue_id ORDER BY batch_id DESC, pos DESC) = 1)"""

# The lists of all pages, merged entry by entry.
V_URGENT = """
v_urgent AS (
  SELECT *, CAST(row_number() OVER (ORDER BY pos, repo, page) - 1 AS INTEGER) AS rank
  FROM v_issue WHERE pos < 20 QUALIFY rank < 20)"""

V_DUP = """
v_dup AS (
  SELECT 'acme/r' || (o_custkey % 10) AS repo, CAST(0 AS BIGINT) AS batch_id, o_orderkey // 40 AS group_pos,
         CAST(o_orderkey % 40 AS INTEGER) AS member_pos,
         CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS issue_id
  FROM orders),
v_dup_line AS (
  SELECT d.repo, batch_id, group_pos,
         '- ' || string_agg(CASE WHEN i.number IS NULL THEN '#' || issue_id
                 ELSE '[#' || issue_id || '](' || html_url || ') - ' || replace(title, '|', '\\|') END,
                 ', ' ORDER BY member_pos) AS line
  FROM v_dup d LEFT JOIN v_issue i ON d.repo = i.repo AND d.issue_id = i.number
  GROUP BY d.repo, batch_id, group_pos)"""

V_TABLE_LINE = """'| [#' || issue_id || '](' || html_url || ') | ' || replace(title, '|', '\\|') || ' | '
         || coalesce(priority, 'Unknown') || ' | ' || replace(reasoning, '|', '\\|') || ' |'"""

V_DOC = """
v_doc AS (
  SELECT doc_id AS number, source AS repo, doc_id // 100 AS page, doc_id % 100 AS pos,
         split_part(text, chr(10), 1) AS title, text AS body
  FROM documents)"""

V_SCORED = """
v_scored AS (
  SELECT doc_id AS number, source AS repo,
         CASE WHEN toxic = 1 THEN 'security' WHEN quality = 0 THEN 'bug' WHEN quality = 1 THEN 'feature' ELSE '' END
           AS category,
         CASE lang WHEN 'en' THEN 'P0' WHEN 'fr' THEN 'P1' WHEN 'de' THEN 'P9' END AS priority_level,
         CASE WHEN n_chars % 10 <> 0 THEN CAST(n_chars AS DOUBLE) END AS score
  FROM documents LEFT JOIN labels USING (doc_id))"""

# What the JSON binding puts into a landed issue.
LANDED = """
v_landed AS (
  SELECT *, CASE WHEN number % 4 = 0 THEN 0 WHEN number % 16 = 1 THEN NULL ELSE number % 9 END AS comments,
         CAST(row_number() OVER (PARTITION BY repo, page ORDER BY pos) - 1 AS INTEGER) AS place,
         CASE WHEN number % 10 IN (7, 8) THEN '' ELSE body || ',' || state END AS names,
         CASE WHEN number % 10 IN (7, 8) THEN '' ELSE body || ',<null>' END AS listed
  FROM v_issue)"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def batches(blocks: str, max_issues: int, max_chars: int) -> str:
    """CTE `v_batched`: the blocks of relation `blocks` with their batch."""
    return f"""
v_batched AS (
  SELECT *, CAST((row_number() OVER w - 1) // {max_issues}
            + coalesce(sum(length(block)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              // {max_chars} AS BIGINT) AS batch_id
  FROM {blocks} WINDOW w AS (PARTITION BY repo ORDER BY page, pos))"""


def block(total: str, positive: str, comments: str, created: str) -> str:
    return f"""'ID: ' || number || chr(10) || 'Title: ' || title || chr(10) || 'Body: ' || body || chr(10)
    || 'Reactions: ' || {total} || ' total, ' || {positive} || ' positive' || chr(10)
    || 'Comments: ' || {comments} || chr(10) || 'Created At: ' || {created} || chr(10) || '---' || chr(10)"""


COUNTED_BLOCK = f"""
v_block AS (
  SELECT i.repo, i.repo_pos, i.page, i.pos, i.number,
         {block("coalesce(total, 0)", "coalesce(positive, 0)", "'0'", "created_text")} AS block
  FROM v_issue i LEFT JOIN v_count USING (repo, number))"""

# What the stand-in model answers.
ANSWER_ENTRY = """'{"issue_id":' || number
    || CASE WHEN number % 5 = 4 THEN '' ELSE ',"priority":"P' || (number % 5) || '"' END
    || ',"reasoning":"r | ' || number || '"}'"""

NUM, DEN = SIMILARITY

V_PAIRS = f"""
v_words AS (
  SELECT repo, number, list_sort(list_distinct(list_filter(
           regexp_split_to_array(lower(title || chr(10) || body), '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> ''))) AS words
  FROM v_doc),
v_rep AS (
  SELECT words, len(words) AS n, min({{'repo': repo, 'number': number}}) AS id
  FROM v_words WHERE len(words) > 0 GROUP BY words),
v_near AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b, a.n + b.n AS sizes, len(list_intersect(a.words, b.words)) AS shared
  FROM v_rep a JOIN v_rep b ON a.id < b.id AND a.n * {NUM} <= b.n * {DEN} AND b.n * {NUM} <= a.n * {DEN}),
v_pair AS (
  SELECT a.repo AS repo_a, a.number AS number_a, b.repo AS repo_b, b.number AS number_b,
         CAST(shared AS INTEGER) AS shared, CAST(sizes - shared AS INTEGER) AS total, 'similar' AS kind
  FROM v_near WHERE shared * {DEN} >= (sizes - shared) * {NUM}
  UNION ALL
  SELECT r.id.repo, r.id.number, w.repo, w.number, CAST(n AS INTEGER), CAST(n AS INTEGER), 'copy'
  FROM v_words w JOIN v_rep r ON w.words = r.words WHERE (w.repo, w.number) <> (r.id.repo, r.id.number))"""


def select(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n{body}"


def triage(within: str, recent: str, bullets: str) -> str:
    """The whole run. `bullets` is CTE `v_bullet`: the lines of the groups, `head` 1 for the first of each."""
    ctes = [
        V_ISSUE,
        LANDED,
        V_REACTION,
        f"""
v_found AS (
  SELECT *, row_number() OVER (PARTITION BY repo ORDER BY page, pos) AS place_in_repo FROM v_landed
  WHERE NOT is_pr AND state = 'open' AND {recent}),
v_block AS (
  SELECT l.repo, l.repo_pos, l.page, l.pos, l.number, l.title, l.html_url,
         {block("coalesce(total, 0)", "coalesce(positive, 0)", "coalesce(CAST(comments AS VARCHAR), 'None')", "created_text")} AS block
  FROM v_found l LEFT JOIN v_count USING (repo, number) WHERE {within})""",
        batches("v_block", *ISSUE_PROMPT),
        """
v_judged AS (
  SELECT *, number AS issue_id, CASE WHEN number % 5 <> 4 THEN 'P' || (number % 5) END AS priority,
         'r | ' || number AS reasoning, CAST(CASE number % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 3 ELSE 2 END AS INTEGER) AS rank
  FROM v_batched),
v_urgent_list AS (
  SELECT *, row_number() OVER (PARTITION BY repo, batch_id ORDER BY page, pos) - 1 AS list_pos
  FROM v_judged WHERE number % 7 = 0),
v_first AS (
  SELECT *, CAST(row_number() OVER (ORDER BY list_pos, repo_pos, repo, batch_id) - 1 AS INTEGER) AS list_rank
  FROM v_urgent_list WHERE list_pos < 20 QUALIFY list_rank < 20)""",
        bullets,
    ]
    return select(
        ctes,
        f"""SELECT 1 AS section, CAST(NULL AS INTEGER) AS rank, unnest([
          '- Total Issues Analyzed: ' || (SELECT count(*) FROM v_judged),
          '- P0 Issues: ' || (SELECT count(*) FROM v_judged WHERE priority = 'P0'),
          '- P1 Issues: ' || (SELECT count(*) FROM v_judged WHERE priority = 'P1'),
          '- P2 Issues: ' || (SELECT count(*) FROM v_judged WHERE priority = 'P2'),
          '- Duplicate Groups: ' || (SELECT coalesce(sum(head), 0) FROM v_bullet)]) AS line
        UNION ALL SELECT 2, NULL, unnest(['', '## Top 20 Urgent Issues'])
        UNION ALL SELECT 3, NULL, unnest(['| ID | Title | Priority | Reasoning |', '| --- | --- | --- | --- |'])
        UNION ALL SELECT 4, list_rank, {V_TABLE_LINE} FROM v_first
        UNION ALL SELECT 5, NULL, unnest(['', '## All Issues (Sorted by Priority)'])
        UNION ALL SELECT 6, NULL, unnest(['| ID | Title | Priority | Reasoning |', '| --- | --- | --- | --- |'])
        UNION ALL SELECT 7, rank, {V_TABLE_LINE} FROM v_judged
        UNION ALL SELECT 8, NULL, unnest(['', '## Potential Duplicate Issues'])
        UNION ALL SELECT 9, NULL, line FROM v_bullet""",
    )


SIMILAR = select([V_DOC, V_PAIRS], "SELECT * FROM v_pair")
GROUPS = select(
        [
            V_DOC,
            V_PAIRS,
            """
v_link AS MATERIALIZED (
  SELECT {'repo': repo_a, 'number': number_a} AS x, {'repo': repo_b, 'number': number_b} AS y FROM v_pair
  UNION SELECT {'repo': repo_b, 'number': number_b}, {'repo': repo_a, 'number': number_a} FROM v_pair),
v_reach AS (SELECT x, y FROM v_link UNION SELECT r.x, l.y FROM v_reach r JOIN v_link l ON r.y = l.x),
v_root AS (SELECT x, min(y) AS root FROM v_reach GROUP BY x)""",
        ],
        """SELECT root.repo AS group_repo, root.number AS group_number, x.repo AS repo, x.number AS number
        FROM (SELECT x, least(root, x) AS root FROM v_root)""",
        recursive=True,
)

ORACLES: dict[str, str] = {
    "explode_pages": select([V_ISSUE, LANDED], "SELECT repo, page, place AS pos, number, title FROM v_landed"),
    "page_rejects": select(
        [V_ISSUE, LANDED],
        """SELECT repo, page, CAST(place AS INTEGER) + CASE WHEN page % 10 = 6 THEN 2 ELSE 0 END AS pos,
          'number cannot be read' AS reason FROM v_landed WHERE number % 64 = 5 AND page % 10 NOT IN (3, 4, 5)
        UNION ALL SELECT DISTINCT repo, page, unnest([0, 1]), 'element is not an object' FROM v_issue WHERE page % 10 = 6
        UNION ALL SELECT DISTINCT repo, page, CAST(NULL AS INTEGER),
          CASE WHEN page % 10 = 4 THEN 'page is not an array' ELSE 'page is not valid JSON' END
          FROM v_issue WHERE page % 10 IN (3, 4, 5)""",
    ),
    "explode_reactions": select([V_ISSUE, V_REACTION], "SELECT repo, number, content FROM v_reaction"),
    "first_seen_distinct": select(
        [V_DOC],
        r"""SELECT title AS value, min(number) AS pos FROM v_doc
        WHERE regexp_matches(title, '[^\s]') GROUP BY title""",
    ),
    "exclude_pull_requests": select([V_ISSUE], "SELECT repo, page, number FROM v_issue WHERE NOT is_pr"),
    "open_only": select([V_ISSUE], "SELECT repo, number, title, state FROM v_issue WHERE state = 'open'"),
    "updated_since": select(
        [V_ISSUE],
        f"SELECT repo, number, created_text FROM v_issue WHERE updated_at >= TIMESTAMP '{SINCE}'",
    ),
    "lookback_filter": select(
        [V_ISSUE],
        """SELECT repo, number, created_text FROM v_issue
        WHERE """ + IN_LOOKBACK,
    ),
    "normalize_issue": select(
        [V_ISSUE, LANDED],
        """SELECT repo, page, number, title, body, listed AS labels, comments,
        strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS created, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated,
        state, html_url FROM v_landed""",
    ),
    "issue_from_raw": select(
        [V_ISSUE, LANDED],
        """SELECT repo, page, CASE WHEN number % 64 <> 5 THEN number END AS number, title, body, names AS labels,
        comments, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS created, state, html_url,
        CASE WHEN number % 6 = 0 AND number % 4 <> 0 THEN number % 4 ELSE number % 5 + number % 3 END AS reactions_total,
        CASE WHEN number % 6 = 0 THEN 2 ELSE number % 5 + number % 3 END AS reactions_positive,
        CASE WHEN number % 64 = 5 THEN 'number is not an integer'
             WHEN comments IS NULL THEN 'comments is not an integer' END AS reason
        FROM v_landed""",
    ),
    "label_names": select([V_ISSUE, LANDED], "SELECT number, names, listed FROM v_landed"),
    "split_repo": select(
        [
            V_ISSUE,
            """
v_written AS (SELECT number, CASE number % 3 WHEN 0 THEN repo WHEN 1 THEN repo || '/x' ELSE 'r' || number END AS repo
  FROM v_issue)""",
        ],
        """SELECT number, repo, CASE WHEN number % 3 <> 2 THEN 'acme' END AS owner,
        CASE WHEN number % 3 <> 2 THEN substr(repo, 6) END AS name,
        CASE WHEN number % 3 = 2 THEN 'no slash in repository ' || repo END AS reason
        FROM v_written""",
    ),
    "validate_scored": select(
        [V_SCORED],
        """SELECT repo, number, category, priority_level, score,
        CASE WHEN priority_level IS NULL OR priority_level NOT IN ('P0', 'P1', 'P2')
             THEN 'unknown priority level ' || coalesce(priority_level, '(null)')
             WHEN category = '' THEN 'no category'
             WHEN score IS NULL THEN 'no score' END AS reason
        FROM v_scored""",
    ),
    "attach_reactions": select(
        [V_ISSUE, V_REACTION],
        """SELECT repo, number, title, coalesce(total, 0) AS reactions_total, coalesce(positive, 0) AS reactions_positive
        FROM v_issue LEFT JOIN v_count USING (repo, number)""",
    ),
    "enrich_priorities": select(
        [V_ISSUE, V_PRIORITY],
        """SELECT p.repo, issue_id, batch_id, p.pos, priority, reasoning, title, html_url
        FROM v_priority p JOIN v_issue i ON p.repo = i.repo AND issue_id = number WHERE NOT is_pr""",
    ),
    "urgent_rows": select(
        [V_ISSUE, V_LOG, V_URGENT],
        """SELECT u.repo, l.issue_id, page AS batch_id, u.pos, priority, reasoning, title, html_url, rank
        FROM v_urgent u JOIN v_last l ON u.repo = l.repo AND u.number = l.issue_id WHERE number % 7 <> 0""",
    ),
    "duplicate_members": select(
        [V_ISSUE, V_DUP],
        """SELECT d.repo, issue_id, batch_id, group_pos, member_pos, title, html_url,
        CAST(i.number IS NOT NULL AS INTEGER) AS found
        FROM v_dup d LEFT JOIN v_issue i ON d.repo = i.repo AND issue_id = number""",
    ),
    "reaction_counts": select(
        [V_ISSUE, V_REACTION],
        "SELECT repo, number, total AS reactions_total, positive AS reactions_positive FROM v_count",
    ),
    "reaction_counts_from_summary": select(
        [V_ISSUE],
        """SELECT repo, number,
        CASE WHEN number % 7 = 0 AND number % 4 <> 0 THEN number % 4
             WHEN number % 9 = 0 THEN 0 ELSE number % 5 + number % 3 END AS reactions_total,
        CASE WHEN number % 11 = 0 AND number % 3 <> 0 THEN number % 3 WHEN number % 9 = 0 THEN 0
             ELSE number % 5 + CASE WHEN number % 2 = 0 THEN number % 3 ELSE 0 END END AS reactions_positive
        FROM v_issue""",
    ),
    "category_counts": select(
        [V_SCORED], "SELECT category, count(*) AS n FROM v_scored GROUP BY category"
    ),
    "report_summary": select(
        [V_ISSUE, V_PRIORITY, V_DUP],
        """SELECT (SELECT count(*) FROM (SELECT DISTINCT repo, number FROM v_issue)) AS total_issues,
        (SELECT count(*) FROM v_priority WHERE priority = 'P0') AS p0,
        (SELECT count(*) FROM v_priority WHERE priority = 'P1') AS p1,
        (SELECT count(*) FROM v_priority WHERE priority = 'P2') AS p2,
        (SELECT count(*) FROM (SELECT DISTINCT repo, batch_id, group_pos FROM v_dup)) AS duplicate_groups""",
    ),
    "fetch_tally": select(
        [
            V_ISSUE,
            f"""
v_kept AS (SELECT * FROM v_issue WHERE NOT is_pr ORDER BY repo_pos, page, pos LIMIT {TALLY_LIMIT}),
v_tally AS (
  SELECT r.repo_pos, r.repo, count(k.number) AS kept
  FROM (SELECT DISTINCT repo_pos, repo FROM v_issue) r LEFT JOIN v_kept k ON r.repo_pos = k.repo_pos GROUP BY ALL),
v_run AS (SELECT *, CAST(sum(kept) OVER (ORDER BY repo_pos) AS BIGINT) AS running_total FROM v_tally)""",
        ],
        f"""SELECT repo_pos, repo, kept, running_total, {TALLY_LIMIT} - running_total AS remaining
        FROM v_run WHERE running_total - kept < {TALLY_LIMIT}""",
    ),
    "limit_global": select(
        [V_ISSUE],
        f"""SELECT repo_pos, page, pos, number FROM v_issue WHERE NOT is_pr
        ORDER BY repo_pos, page, pos LIMIT {GLOBAL_LIMIT}""",
    ),
    "limit_global_none": select([V_ISSUE], "SELECT repo_pos, page, pos, number FROM v_issue WHERE NOT is_pr"),
    "limit_global_by_counts": select(
        [V_ISSUE],
        f"""SELECT repo_pos, page, pos, number FROM v_issue WHERE NOT is_pr
        ORDER BY repo_pos, page, pos LIMIT {LARGE_LIMIT}""",
    ),
    "limit_per_repo": select(
        [V_ISSUE],
        f"""SELECT repo, page, pos, number, title FROM v_issue WHERE NOT is_pr
        QUALIFY row_number() OVER (PARTITION BY repo ORDER BY page, pos) <= {PER_REPO_LIMIT}""",
    ),
    "top_by_score": select(
        [V_ISSUE], "SELECT number, repo, title, score FROM v_issue ORDER BY score DESC, number, repo LIMIT 10"
    ),
    "sort_by_priority": select([V_PRIORITY], "SELECT * FROM v_ranked ORDER BY rank, repo, batch_id, pos"),
    "top_urgent_fallback": select(
        [V_ISSUE, V_PRIORITY],
        """SELECT t.repo, batch_id, t.pos, issue_id, priority, reasoning, rank, title, html_url
        FROM (SELECT * FROM v_ranked ORDER BY rank, repo, batch_id, pos LIMIT 20) t
        JOIN v_issue i ON t.repo = i.repo AND issue_id = number WHERE NOT is_pr""",
    ),
    "last_per_key": select([V_ISSUE, V_LOG], "SELECT * FROM v_last"),
    "union_repos": select(
        [
            V_ISSUE,
            """
v_listed AS (SELECT DISTINCT repo_pos, repo FROM v_issue WHERE repo_pos <> 9),
v_twice AS (SELECT * FROM v_listed UNION ALL SELECT repo_pos + 10, repo FROM v_listed WHERE repo_pos % 3 = 0),
v_json AS (
  SELECT repo, page, length('{"number":,"title":"","body":"","labels":,"created_at":"","updated_at":"","state":"","html_url":"",'
           || '"reactions":{"url":"u","total_count":,"+1":,"heart":}}') + length(CAST(number AS VARCHAR)) + length(title)
         + length(body) + CASE WHEN number % 10 = 7 THEN 4 WHEN number % 10 = 8 THEN 2
             ELSE length('[{"name":""},"",{"name":null},7,null]') + length(body) + length(state) END
         + CASE WHEN number % 4 = 0 THEN 0 WHEN number % 16 = 1 THEN length(',"comments":null') ELSE length(',"comments":0') END
         + 2 * length(created_text) + length(state) + length(html_url)
         + CASE WHEN NOT is_pr THEN 0 WHEN number % 2 = 0 THEN length(',"pull_request":null') ELSE length(',"pull_request":{"url":"x"}') END
         + 3 + CASE WHEN number % 6 = 0 THEN length(',"reactions_total":0,"reactions_positive":2') ELSE 0 END AS chars
  FROM v_issue),
v_page AS (SELECT repo, page, CAST(sum(chars) + count(*) + 1 AS BIGINT) AS chars FROM v_json GROUP BY repo, page)""",
        ],
        "SELECT repo_pos, repo, page, chars FROM v_twice JOIN v_page USING (repo)",
    ),
    "render_prompt_block": select([V_ISSUE, V_REACTION, COUNTED_BLOCK], "SELECT repo, number, block FROM v_block"),
    "report_rows": select(
        [V_ISSUE, V_PRIORITY],
        f"""SELECT rank, p.repo, batch_id, p.pos, issue_id, {V_TABLE_LINE} AS line
        FROM v_ranked p JOIN v_issue i ON p.repo = i.repo AND issue_id = number WHERE NOT is_pr""",
    ),
    "duplicate_lines": select([V_ISSUE, V_DUP], "SELECT * FROM v_dup_line"),
    "report_lines": select(
        [V_ISSUE, V_PRIORITY, V_DUP, V_URGENT],
        f"""SELECT 1 AS section, CAST(NULL AS INTEGER) AS rank, unnest([
          '- Total Issues Analyzed: ' || (SELECT count(*) FROM v_issue),
          '- P0 Issues: ' || (SELECT count(*) FROM v_priority WHERE priority = 'P0'),
          '- P1 Issues: ' || (SELECT count(*) FROM v_priority WHERE priority = 'P1'),
          '- P2 Issues: ' || (SELECT count(*) FROM v_priority WHERE priority = 'P2'),
          '- Duplicate Groups: ' || (SELECT count(*) FROM v_dup_line)]) AS line
        UNION ALL SELECT 2, NULL, unnest(['', '## Top 20 Urgent Issues'])
        UNION ALL SELECT 3, NULL, unnest(['| ID | Title | Priority | Reasoning |', '| --- | --- | --- | --- |'])
        UNION ALL SELECT 4, u.rank, {V_TABLE_LINE}
          FROM v_urgent u JOIN v_priority p ON p.repo = u.repo AND issue_id = number WHERE number % 7 <> 0
        UNION ALL SELECT 5, NULL, unnest(['', '## All Issues (Sorted by Priority)'])
        UNION ALL SELECT 6, NULL, unnest(['| ID | Title | Priority | Reasoning |', '| --- | --- | --- | --- |'])
        UNION ALL SELECT 7, rank, {V_TABLE_LINE}
          FROM v_ranked p JOIN v_issue i ON p.repo = i.repo AND issue_id = number
        UNION ALL SELECT 8, NULL, unnest(['', '## Potential Duplicate Issues'])
        UNION ALL SELECT 9, NULL, line FROM v_dup_line""",
    ),
    "parse_analysis": select(
        [
            V_ISSUE,
            """
v_sound AS (
  SELECT repo, page AS batch_id, number,
         CAST(row_number() OVER (PARTITION BY repo, page ORDER BY pos) - 1 AS INTEGER) AS place,
         CAST(row_number() OVER (PARTITION BY repo, page ORDER BY pos DESC) - 1 AS INTEGER) AS back
  FROM v_issue WHERE page % 10 NOT IN (3, 4, 5, 6))""",
        ],
        """SELECT 'priority' AS kind, repo, batch_id, place AS pos, CAST(NULL AS INTEGER) AS member_pos, number AS issue_id,
          CASE WHEN number % 5 <> 4 THEN 'P' || (number % 5) END AS priority, 'r ' || number AS reasoning,
          CAST(NULL AS VARCHAR) AS reason FROM v_sound WHERE number % 17 <> 0
        UNION ALL SELECT 'duplicate', repo, batch_id, 0, place, number, NULL, NULL, NULL FROM v_sound
        UNION ALL SELECT DISTINCT 'group', repo, batch_id, unnest([0, 1]), NULL, NULL, NULL, NULL, NULL FROM v_sound
        UNION ALL SELECT 'urgent', repo, batch_id, back, NULL, number, NULL, NULL, NULL FROM v_sound
        UNION ALL SELECT 'reject', repo, batch_id, place, NULL, NULL, NULL, NULL, 'priority without a numeric id'
          FROM v_sound WHERE number % 17 = 0
        UNION ALL SELECT DISTINCT 'reject', repo, page, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT),
          CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
          CASE WHEN page % 10 = 4 THEN 'answer is not an object' ELSE 'answer is not valid JSON' END
          FROM v_issue WHERE page % 10 IN (3, 4, 5, 6)""",
    ),
    "pack_prompts": select(
        [
            V_DOC,
            f"""
v_block AS (SELECT repo, page, pos, {block("'None'", "'None'", "'None'", "'None'")} AS block FROM v_doc)""",
            batches("v_block", *DOC_PROMPT),
        ],
        f"""SELECT repo, batch_id, count(*) AS n_issues,
        {quoted(PREAMBLE)} || string_agg(block, '' ORDER BY page, pos) AS prompt
        FROM v_batched GROUP BY repo, batch_id""",
    ),
    "apply_model": select(
        [
            V_ISSUE,
            V_REACTION,
            COUNTED_BLOCK,
            batches("v_block", *ISSUE_PROMPT),
            """
v_group AS (
  SELECT repo, batch_id, number // 40 AS g, '[' || string_agg(number, ',' ORDER BY page, pos) || ']' AS members
  FROM v_batched GROUP BY ALL HAVING count(*) > 1),
v_grouped AS (SELECT repo, batch_id, string_agg(members, ',' ORDER BY g) AS text FROM v_group GROUP BY ALL)""",
        ],
        f"""SELECT b.repo, b.batch_id, '{{"priorities":[' || string_agg({ANSWER_ENTRY}, ',' ORDER BY page, pos)
        || '],"duplicates":[' || coalesce(any_value(g.text), '') || '],"top_urgent_issues":['
        || coalesce(string_agg(number, ',' ORDER BY page, pos) FILTER (number % 7 = 0), '') || ']}}' AS response
        FROM v_batched b LEFT JOIN v_grouped g ON b.repo = g.repo AND b.batch_id = g.batch_id
        GROUP BY b.repo, b.batch_id""",
    ),
    "similar_pairs": SIMILAR,
    "similar_pairs_split": SIMILAR,
    "duplicate_groups": GROUPS,
    "duplicate_groups_split": GROUPS,
    "triage_report": triage(
        "True",
        f"updated_at >= TIMESTAMP '{SINCE}'",
        """
v_bullet AS (
  SELECT '- ' || string_agg('[#' || number || '](' || html_url || ') - ' || replace(title, '|', '\\|'), ', ' ORDER BY number) AS line,
         1 AS head
  FROM v_batched GROUP BY repo, batch_id, number // 40 HAVING count(*) > 1)""",
    ),
    "triage_report_limited": triage(
        f"place_in_repo <= {PER_REPO_LIMIT}",
        IN_LOOKBACK,
        """
v_run AS (
  SELECT repo, number, html_url, title, number // 40 AS g, batch_id FROM v_batched
  QUALIFY count(*) OVER (PARTITION BY repo, batch_id, number // 40) > 1),
v_bullet AS (
  SELECT CASE WHEN number = min(number) OVER w THEN '- ' ELSE '  , ' END || '[#' || number || '](' || html_url || ') - '
         || replace(title, '|', '\\|') AS line, CAST(number = min(number) OVER w AS INTEGER) AS head
  FROM v_run WINDOW w AS (PARTITION BY repo, batch_id, g))""",
    ),
}
