"""Checking SQL for the registered queries, one statement per name.

Written independently of the Spark operators: windows and joins where those use
arrays, regular expressions where those parse, a nested loop where those join by
equality.
"""

from __future__ import annotations

from gradus.functions import constants as K
from gradus.functions.rewards import ACTIVE, ALL
from gradus.plans import derived as D
from gradus.plans import reward_sql as R

BASE = "https://contest.example"

# --- Derived inputs ------------------------------------------------------------

GRID = f"""grid AS (
SELECT contest_id, concat(contest_id, '_', letter) AS task_id, letter
FROM (SELECT DISTINCT {D.CONTEST_SQL} AS contest_id FROM documents) AS c,
  (VALUES ('a'), ('b'), ('c'), ('d')) AS l(letter))"""

KEYS = f"doc_id, {D.CONTEST_SQL} AS contest_id, {D.TASK_SQL} AS task_id"

PROBLEM_PAGES = f"problem_pages AS (SELECT {KEYS}, {D.PROBLEM_PAGE_SQL} AS html FROM documents)"
LIST_PAGES = f"list_pages AS (SELECT {KEYS}, {D.LIST_PAGE_SQL} AS html FROM documents)"
SUBMISSION_PAGES = f"""submission_pages AS (
SELECT {D.CONTEST_SQL} AS contest_id, CAST(doc_id * 10 + nth AS VARCHAR) AS submission_id,
  {D.SUBMISSION_PAGE_SQL} AS html
FROM documents, (VALUES (1), (2)) AS n(nth))"""
EXISTING = f"""existing AS (
SELECT {KEYS} FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT {KEYS} FROM documents WHERE doc_id % 10 = 0)"""

_FIRST = (
    "SELECT conv_id, text FROM (SELECT conv_id, text, row_number() OVER "
    "(PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = '{}') AS t "
    "WHERE rn = 1"
)
DIALOGUES = f"""dialogues AS (
SELECT p.conv_id, p.text AS description, s.text AS solution
FROM ({_FIRST.format("user")}) AS p JOIN ({_FIRST.format("assistant")}) AS s USING (conv_id))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _decode(s: str, *, pages: bool = False) -> str:
    out = f"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for entity, char in (
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&copy;", "©"),
        ("&middot;", "·"),
        ("&amp;", "&"),
    ):
        out = f"replace({out}, '{entity}', '{char}')"
    return out


def _inner(s: str, tag: str) -> str:
    """Text of the first element of a kind, null without one."""
    found = f"regexp_extract({s}, '(?s)<{tag}>(.*?)</{tag}>', 1)"
    return f"CASE WHEN contains({s}, '<{tag}>') THEN {_decode(found)} END"


def _all_p(s: str) -> str:
    return (
        f"list_transform(regexp_extract_all({s}, '(?s)<p>(.*?)</p>', 1), "
        f"lambda p: {R.strip(_decode('p'))})"
    )


# Pages cut into parts, one row each, then section by section.
PARTS = f"""scoped AS (
SELECT doc_id, contest_id, task_id, html,
  contains(html, 'id="task-statement"') AND contains(html, 'class="lang-en"') AS english,
  {R.strip(_decode("regexp_extract(html, '(?s)<span class=\"h2 top\">(.*?)</span>', 1)"))} AS title
FROM problem_pages),
pieces AS (
SELECT doc_id, contest_id, task_id, title,
  string_split(html, '<div class="part">')[2:] AS pieces
FROM scoped WHERE english),
cut AS (
SELECT doc_id, contest_id, task_id, title, unnest(pieces) AS piece,
  unnest(range(0, len(pieces))) AS part_idx
FROM pieces),
sectioned AS (
SELECT *, contains(piece, '<section>') AS has_section,
  regexp_extract(piece, '(?s)<section>(.*)</section>', 1) AS section
FROM cut),
parts AS (
SELECT doc_id, contest_id, task_id, title, CAST(part_idx AS INT) AS part_idx, has_section,
  lower({_inner("section", "h3")}) AS header, lower({_inner("piece", "h3")}) AS part_header,
  array_to_string({_all_p("section")}, chr(10)) AS paragraphs,
  {_inner("section", "div")} AS content, {_inner("section", "pre")} AS sample
FROM sectioned),
classed AS (
SELECT *, CASE
  WHEN contains(header, 'problem statement') THEN 'statement'
  WHEN content IS NULL THEN NULL
  WHEN contains(header, 'constraints') THEN 'constraints'
  WHEN contains(header, 'input') AND contains(header, 'format') THEN 'input_format'
  WHEN contains(header, 'output') AND contains(header, 'format') THEN 'output_format'
  END AS section_class,
  contains(header, 'sample input') AND (contains(header, 'problem statement') OR content IS NOT NULL) AS is_input,
  lead(part_idx) OVER w AS next_idx, lead(part_header) OVER w AS next_header,
  lead(has_section) OVER w AS next_has_section, lead(sample) OVER w AS next_sample
FROM parts WINDOW w AS (PARTITION BY doc_id ORDER BY part_idx)),
pairs AS (
SELECT doc_id, part_idx, {R.strip("sample")} AS input, {R.strip("next_sample")} AS output
FROM classed WHERE is_input AND contains(next_header, 'sample output')
  AND sample IS NOT NULL AND next_sample IS NOT NULL),
faults AS (
SELECT doc_id, part_idx, CASE
  WHEN next_idx IS NOT NULL AND next_header IS NULL
  THEN concat('no heading after sample input in part ', CAST(part_idx AS VARCHAR))
  WHEN contains(next_header, 'sample output') AND NOT next_has_section
  THEN concat('no section after sample input in part ', CAST(part_idx AS VARCHAR)) END AS error
FROM classed WHERE is_input),
records AS (
SELECT s.contest_id, s.task_id, s.doc_id, s.title,
  coalesce(max_by(paragraphs, part_idx) FILTER (WHERE section_class = 'statement'), '') AS description,
  coalesce(max_by({R.strip("content")}, part_idx) FILTER (WHERE section_class = 'constraints'), '') AS constraints,
  coalesce(max_by({R.strip("content")}, part_idx) FILTER (WHERE section_class = 'input_format'), '') AS input_format,
  coalesce(max_by({R.strip("content")}, part_idx) FILTER (WHERE section_class = 'output_format'), '') AS output_format,
  (SELECT coalesce(string_agg(input || ' => ' || output, ' | ' ORDER BY part_idx), '')
   FROM pairs AS p WHERE p.doc_id = s.doc_id) AS samples,
  (SELECT min_by(error, part_idx) FROM faults AS f
   WHERE f.doc_id = s.doc_id AND error IS NOT NULL) AS error
FROM scoped AS s LEFT JOIN classed AS c USING (doc_id)
WHERE s.english AND s.title <> ''
GROUP BY s.contest_id, s.task_id, s.doc_id, s.title)"""

ROWS = """split_rows AS (
SELECT doc_id, contest_id, task_id, regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1) AS trs
FROM list_pages),
trs AS (
SELECT doc_id, contest_id, task_id, unnest(trs) AS tr,
  CAST(unnest(range(0, len(trs))) AS INT) AS row_idx
FROM split_rows),
list_rows AS (
SELECT doc_id, contest_id, task_id, row_idx, contains(tr, '<td>') AS has_cell,
  regexp_extract(regexp_extract_all(tr, '(?s)<td>(.*?)</td>', 1)[-1], 'href="([^"]*)"', 1) AS href
FROM trs WHERE NOT contains(tr, '<th>')),
stops AS (
SELECT doc_id, min(row_idx) AS row_idx FROM list_rows
WHERE NOT has_cell OR href <> '' GROUP BY doc_id),
picks AS (
SELECT l.doc_id, l.contest_id, l.task_id,
  CASE WHEN r.has_cell THEN nullif(split_part(r.href, '/', -1), '') END AS submission_id,
  CASE WHEN NOT r.has_cell
  THEN concat('no cell in list row ', CAST(r.row_idx AS VARCHAR)) END AS error
FROM list_pages AS l LEFT JOIN stops USING (doc_id)
LEFT JOIN list_rows AS r ON r.doc_id = stops.doc_id AND r.row_idx = stops.row_idx)"""

_CODE = "regexp_extract(html, '(?s)<pre id=\"submission-code\">(.*?)</pre>', 1)"
CODE = f"""code AS (
SELECT contest_id, submission_id,
  CASE WHEN contains(html, 'id="submission-code"') THEN {R.strip(_decode(_CODE))} END AS solution
FROM submission_pages)"""

OUTCOMES = f"""outcomes AS (
SELECT r.contest_id, r.task_id, r.title, r.description, r.constraints, r.input_format,
  r.output_format, r.samples, c.solution, coalesce(r.error, p.error) AS error
FROM records AS r LEFT JOIN picks AS p USING (doc_id)
LEFT JOIN code AS c ON c.contest_id = p.contest_id AND c.submission_id = p.submission_id
WHERE NOT EXISTS (SELECT 1 FROM existing AS e
  WHERE e.contest_id = r.contest_id AND e.task_id = r.task_id))"""

COLLECT = (PROBLEM_PAGES, LIST_PAGES, SUBMISSION_PAGES, EXISTING, PARTS, ROWS, CODE, OUTCOMES)
RECORD_COLUMNS = (
    "contest_id, task_id, title, description, constraints, input_format, "
    "output_format, solution, samples"
)

# --- Statements ----------------------------------------------------------------

ORACLES: dict[str, str] = {
    "page_scan": "SELECT page_id, url, CAST(length(html) AS INT) AS html_length FROM pages",
    "json_round_trip": _with(DIALOGUES)
    + "SELECT CAST(conv_id AS VARCHAR) AS title, description, "
    "concat('in => ', CAST(length(solution) AS VARCHAR)) AS samples, solution, "
    "TRUE AS no_constraints FROM dialogues",
    "task_grid": _with(GRID) + "SELECT * FROM grid",
    "page_url": _with(GRID)
    + f"SELECT task_id, concat('{BASE}/contests/', contest_id, '/tasks/', task_id) AS problem_url, "
    f"concat('{BASE}/contests/', contest_id, '/submissions?f.Task=', task_id, "
    "'&f.LanguageName=', url_encode('C++'), '&f.Status=AC&f.User=') AS list_url, "
    f"concat('{BASE}/contests/', contest_id, '/submissions/', "
    "CAST(length(task_id) AS VARCHAR)) AS submission_url FROM grid",
    "page_title": f"""SELECT page_id,
nullif({R.strip(_decode("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}, '') AS title,
nullif({R.strip(_decode("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))}, '') AS heading
FROM pages""",
    "language_filter": "SELECT page_id, 'en' AS lang FROM pages "
    "WHERE regexp_extract(html, 'lang=\"([a-z]+)\"', 1) = 'en'",
    "description": f"SELECT page_id, array_to_string({_all_p('html')}, chr(10)) AS description FROM pages",
    "page_links": """WITH links AS (
SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
rows_ AS (SELECT page_id, CAST(unnest(range(0, len(hrefs))) AS INT) AS row_idx,
  unnest(hrefs) AS href FROM links)
SELECT *, split_part(href, '/', -1) AS last_segment FROM rows_""",
    "page_parts": _with(PROBLEM_PAGES, PARTS)
    + "SELECT doc_id, part_idx, has_section, header, part_header, "
    "CASE WHEN has_section THEN coalesce(paragraphs, '') END AS paragraphs, content, sample FROM parts",
    "classify_section": _with(PROBLEM_PAGES, PARTS)
    + "SELECT doc_id, part_idx, section_class FROM classed WHERE section_class IS NOT NULL",
    "pair_samples": _with(PROBLEM_PAGES, PARTS)
    + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part_idx) - 1 AS INT) AS nth, "
    "input, output FROM pairs",
    "problem_record": _with(PROBLEM_PAGES, PARTS)
    + "SELECT * EXCLUDE (error) FROM records WHERE error IS NULL",
    "quarantine": _with(PROBLEM_PAGES, PARTS)
    + "SELECT contest_id, task_id, error FROM records WHERE error IS NOT NULL",
    "submission_rows": _with(LIST_PAGES, ROWS)
    + "SELECT doc_id, row_idx, href, split_part(href, '/', -1) AS submission_id "
    "FROM list_rows WHERE href <> ''",
    "first_listed": _with(LIST_PAGES, ROWS) + "SELECT doc_id, submission_id, error FROM picks",
    "submission_code": _with(SUBMISSION_PAGES, CODE) + "SELECT submission_id, solution FROM code",
    "submission_filter": "SELECT event_id, user_id, value FROM events "
    "WHERE event_type = 'purchase' AND json_extract_string(props, '$.k') = '7'",
    "first_accepted": "SELECT user_id, event_id, value, ts FROM (SELECT *, row_number() OVER "
    "(PARTITION BY user_id ORDER BY event_id) AS rn FROM events WHERE event_type = 'purchase') AS t WHERE rn = 1",
    "require_fields": "SELECT conv_id, text AS solution FROM (SELECT conv_id, text, row_number() OVER "
    "(PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations "
    "WHERE role = 'assistant') AS t WHERE rn = 1",
    "attach_solution": _with(DIALOGUES) + "SELECT * FROM dialogues",
    "skip_collected": _with(
        GRID,
        f"titled AS (SELECT {D.TITLE_SQL} AS title FROM documents WHERE doc_id % 3 = 0)",
    )
    + "SELECT * FROM grid WHERE NOT EXISTS (SELECT 1 FROM titled "
    "WHERE starts_with(title, concat(upper(letter), ' -')) AND contains(lower(title), contest_id))",
    "skip_collected_by_key": _with(GRID, EXISTING)
    + "SELECT contest_id, task_id, letter FROM grid "
    "WHERE (contest_id, task_id) NOT IN (SELECT (contest_id, task_id) FROM existing)",
    "append_existing": _with(GRID)
    + f"SELECT contest_id, task_id FROM (SELECT {KEYS} FROM documents) AS d "
    "UNION ALL SELECT contest_id, task_id FROM grid",
    "dataset_count_by": "SELECT contest_id, count(*) AS records "
    f"FROM (SELECT {KEYS} FROM documents) AS d GROUP BY contest_id",
    "contest_range": "SELECT concat('abc', CAST(n AS VARCHAR)) AS contest_id, "
    "concat('abc', CAST(n AS VARCHAR), '_', letter) AS task_id, letter FROM (SELECT unnest(range("
    "(SELECT min(doc_id) // 4 FROM documents), (SELECT max(doc_id) // 4 + 1 FROM documents))) AS n) AS c, "
    "(VALUES ('a'), ('b'), ('c'), ('d')) AS l(letter)",
    "build_prompt": _with(DIALOGUES)
    + f"SELECT conv_id, 'system' AS system_role, {R.text(K.SYSTEM_PROMPT)} AS system_content, "
    "'user' AS user_role, description AS user_content, solution AS answer FROM dialogues",
    "completion_text": _with(R.COMPLETIONS) + "SELECT doc_id, c FROM completions",
    "last_user_content": _with(DIALOGUES) + "SELECT conv_id, description AS content FROM dialogues",
    "render_chat": _with(DIALOGUES)
    + "SELECT conv_id, concat('<|system|>', chr(10), "
    + R.text(K.SYSTEM_PROMPT)
    + ", '<|end|>', chr(10), '<|user|>', chr(10), description, '<|end|>', chr(10), "
    "'<|assistant|>', chr(10)) AS chat FROM dialogues",
    "length_budget": _with(
        R.COMPLETIONS,
        "counted AS (SELECT doc_id, "
        f"CAST(len(regexp_extract_all(source, '[^{K.WS}]+')) AS INT) AS prompt_words, "
        f"CAST(len(regexp_extract_all(c, '[^{K.WS}]+')) AS INT) AS completion_words FROM completions)",
    )
    + "SELECT *, prompt_words > 256 AS prompt_over, completion_words > 512 AS completion_over FROM counted",
    "tag_block": _with(R.COMPLETIONS, R.views_sql())
    + "SELECT doc_id, rz AS reasoning, an AS answer FROM v",
    "extract_answer": _with(R.COMPLETIONS, R.views_sql()) + "SELECT doc_id, ans AS extracted FROM v",
    "strip_text": _with(R.COMPLETIONS, R.views_sql()) + "SELECT doc_id, cs AS stripped FROM v",
    "count_of": _with(R.COMPLETIONS)
    + f"SELECT doc_id, CAST({R.count('c', chr(10))} AS INT) AS newlines, "
    f"CAST({R.count('c', '<answer>')} AS INT) AS answer_tags, "
    f"CAST({R.count('c', 'ee')} AS INT) AS ee FROM completions",
    "find_position": _with(R.COMPLETIONS)
    + "SELECT doc_id, CAST(strpos(c, '<reasoning>') - 1 AS INT) AS reasoning_at, "
    "CAST(strpos(c, '</answer>') - 1 AS INT) AS close_at FROM completions",
    "lower_text": _with(R.COMPLETIONS, R.views_sql()) + "SELECT doc_id, cl AS lowered FROM v",
    "number_tokens": _with(R.COMPLETIONS)
    + f"SELECT doc_id, coalesce(array_to_string({R.numbers('c')}, ','), '') AS numbers FROM completions",
    "number_overlap": _with(R.COMPLETIONS, R.views_sql())
    + f"SELECT doc_id, CAST(len(list_intersect({R.numbers('an')}, {R.numbers('rz')})) AS INT) AS shared FROM v",
    "split_lines": _with(
        R.COMPLETIONS,
        "l AS (SELECT doc_id, regexp_split_to_array("
        f"regexp_replace(c, '({R.LINE_END})\\z', ''), '{R.LINE_END}') AS ls FROM completions)",
    )
    + "SELECT doc_id, CAST(len(ls) AS INT) AS n_lines, array_to_string(ls, '~') AS joined FROM l",
    "nonempty_lines": _with(
        R.COMPLETIONS, f"l AS (SELECT doc_id, {R.lines('c')} AS ls FROM completions)"
    )
    + "SELECT doc_id, CAST(len(ls) AS INT) AS n_lines, array_to_string(ls, '~') AS joined FROM l",
    **{
        name: R.with_views(f"SELECT doc_id, {R.REWARD_SQL[name]} AS {name} FROM v")
        for name in ALL
    },
    "collect_new": _with(*COLLECT)
    + f"SELECT {RECORD_COLUMNS} FROM outcomes WHERE error IS NULL AND solution <> ''",
    "collect_new_by_title": _with(
        *COLLECT[:3],
        f"titled AS (SELECT {D.TITLE_SQL} AS title FROM documents WHERE doc_id % 3 = 0)",
        "existing AS (SELECT contest_id, task_id FROM problem_pages WHERE EXISTS (SELECT 1 FROM titled "
        "WHERE starts_with(title, concat(upper(split_part(task_id, '_', -1)), ' -')) "
        "AND contains(lower(title), contest_id)))",
        *COLLECT[4:],
    )
    + f"SELECT {RECORD_COLUMNS} FROM outcomes WHERE error IS NULL AND solution <> ''",
    "collect_failures": _with(*COLLECT)
    + "SELECT contest_id, task_id, error FROM outcomes WHERE error IS NOT NULL",
    "collected_stream": _with(
        *COLLECT[:3], "existing AS (SELECT '' AS contest_id, '' AS task_id WHERE FALSE)", *COLLECT[4:]
    )
    + f"SELECT {RECORD_COLUMNS} FROM outcomes WHERE error IS NULL AND solution <> ''",
}


def _columns(names) -> str:
    return ", ".join(f"{R.REWARD_SQL[n]} AS {n}" for n in names)


_TOTAL = " + ".join(ACTIVE)
_ACTIVE = R.with_views(
    f"SELECT prompt_id, gen_id, {', '.join(ACTIVE)}, {_TOTAL} AS total FROM scored",
    f"scored AS (SELECT prompt_id, gen_id, {_columns(ACTIVE)} FROM v)",
)


def _summary(names, by: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {by}, '{n}' AS reward, count({n}) AS n, round(avg(CAST({n} AS DOUBLE)), 6) AS mean, "
        f"round(stddev_samp(CAST({n} AS DOUBLE)), 6) AS std, round(CAST(min({n}) AS DOUBLE), 6) AS min, "
        f"round(CAST(max({n}) AS DOUBLE), 6) AS max, "
        f"round(avg(CASE WHEN {n} <> 0 THEN 1e0 ELSE 0e0 END), 6) AS share_nonzero "
        f"FROM {source} GROUP BY {by}"
        for n in names
    )


ORACLES |= {
    "score_all": R.with_views(f"SELECT doc_id, {_columns(ALL)} FROM v"),
    "score_active": _ACTIVE,
    "scored_stream": _ACTIVE,
    "weighted_total": R.with_views(
        "SELECT doc_id, correctness * 2e0 + introspection * 0.5e0 AS total FROM scored",
        f"scored AS (SELECT doc_id, {_columns(['correctness', 'introspection'])} FROM v)",
    ),
    "group_advantages": R.with_views(
        "SELECT prompt_id, gen_id, total, round(CASE WHEN coalesce(sd, 0) = 0 THEN 0e0 "
        "ELSE (total - mean) / sd END, 6) AS advantage FROM grouped",
        f"scored AS (SELECT prompt_id, gen_id, {_columns(ACTIVE)} FROM v)",
        f"summed AS (SELECT prompt_id, gen_id, {_TOTAL} AS total FROM scored)",
        "grouped AS (SELECT *, avg(total) OVER w AS mean, stddev_samp(total) OVER w AS sd "
        "FROM summed WINDOW w AS (PARTITION BY prompt_id))",
    ),
    "best_of_group": R.with_views(
        "SELECT prompt_id, gen_id, total FROM (SELECT *, row_number() OVER "
        "(PARTITION BY prompt_id ORDER BY total DESC, gen_id) AS rn FROM summed WHERE total IS NOT NULL) "
        "AS t WHERE rn = 1",
        f"scored AS (SELECT prompt_id, gen_id, {_columns(ACTIVE)} FROM v)",
        f"summed AS (SELECT prompt_id, gen_id, {_TOTAL} AS total FROM scored)",
    ),
    "reward_summary_by_language": R.with_views(
        _summary(ALL, "lang", "scored"),
        f"scored AS MATERIALIZED (SELECT lang, {_columns(ALL)} FROM v)",
    ),
    "reward_summary_by_quality": R.with_views(
        _summary([*ACTIVE, "total"], "quality", "labelled"),
        f"scored AS (SELECT doc_id, {_columns(ACTIVE)} FROM v)",
        f"labelled AS MATERIALIZED (SELECT scored.*, {_TOTAL} AS total, quality "
        "FROM scored LEFT JOIN labels USING (doc_id))",
    ),
    "registered_reward": R.with_views(
        f"SELECT doc_id, 1e0 / (1 + length(ans)) AS brevity, {R.REWARD_SQL['correctness']} AS correctness FROM v"
    ),
    "python_reward": _with(R.COMPLETIONS)
    + "SELECT doc_id, length(c) - length(source) + CASE WHEN lang = 'en' THEN 0.5e0 ELSE 0e0 END AS value "
    "FROM completions",
    "json_array_read": _with(DIALOGUES)
    + "SELECT CAST(conv_id AS VARCHAR) AS title, description, solution, TRUE AS no_samples "
    "FROM dialogues WHERE (conv_id // 20) % 4 <> 1",
    "json_array_split": _with(DIALOGUES)
    + "SELECT CAST(conv_id AS VARCHAR) AS title, description, solution, TRUE AS no_samples "
    "FROM dialogues WHERE (conv_id // 200) % 4 <> 1",
    "malformed_records": _with(DIALOGUES)
    + """SELECT 'line' AS kind, concat('{"title": "', conv_id, '", "solution": "x"') AS record """
    "FROM dialogues WHERE conv_id % 3 = 0 UNION ALL "
    "SELECT DISTINCT 'file', CAST(conv_id // 20 AS VARCHAR) FROM dialogues WHERE (conv_id // 20) % 4 = 1",
    "caught_reward": _with(R.COMPLETIONS)
    + "SELECT doc_id, CASE WHEN doc_id % 50 <> 7 THEN length(c)::DOUBLE END AS value, "
    "CASE WHEN doc_id % 50 = 7 THEN 'ValueError: not this one' END AS error FROM completions WHERE c IS NOT NULL",
}
