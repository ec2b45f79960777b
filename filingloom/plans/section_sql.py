"""The rows of section files in SQL: common table expressions that follow the texts of adapters.TEXTS, up to ``sections``."""

from __future__ import annotations

from filingloom.operators import index as I
from filingloom.operators import sections as S
from filingloom.operators.filings import PLAN_LIMITS
from filingloom.plans.adapters import TEXTS


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _said(text: str) -> str:
    """A fixed text as an SQL string."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n"))


def _first(x: str) -> str:
    """The first sentence of a paragraph."""
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))[1]"


def _lines(name: str, source: str) -> str:
    """``name``: (k, total, n, line, start) of every line of a (k, text) table's texts."""
    return f"""{name}_split AS (SELECT k, length(text) AS total, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM {source} WHERE text IS NOT NULL),
{name} AS (SELECT k, total, n, line, (sum(length(line) + 1) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(line) - 1)::BIGINT AS start FROM {name}_split)"""


def condensed_sql(name: str, source: str) -> str:
    """``name``: (k, condensed) of a (k, text) table, as condense_risk_factors gives it."""
    bare = _strip("line")
    return rf"""{_lines(f"{name}_lines", source)},
{name}_grouped AS (SELECT k, n, {bare} AS bare, count(*) FILTER (WHERE regexp_matches(line, '^\s*\*\*')) OVER (PARTITION BY k ORDER BY n) AS part FROM {name}_lines),
{name}_parts AS (SELECT k, part, arg_min(bare, n) AS head, list(bare ORDER BY n)[2:] AS below FROM {name}_grouped GROUP BY k, part),
{name}_told AS (SELECT k, part, head, array_to_string(list_filter(below, lambda s: s <> '')[1:6], ' ') AS told FROM {name}_parts WHERE starts_with(head, '**') AND ends_with(head, '**') AND length(head) BETWEEN 16 AND 249),
{name}_kept AS (SELECT k, count(*) AS n, string_agg(chr(10) || head || CASE WHEN told <> '' THEN chr(10) || {_strip(_first("told"))} ELSE '' END, chr(10) ORDER BY part) AS listed FROM {name}_told GROUP BY k),
{name}_plain AS (SELECT k, string_agg(chr(10) || {_strip(_first("bare"))}, '' ORDER BY n) AS listed FROM {name}_grouped WHERE bare <> '' AND NOT starts_with(bare, '|') AND length({_first("bare")}) > 60 GROUP BY k),
{name}_listed AS (SELECT s.k, s.text, CASE WHEN a.n >= 3 THEN {_strip("a.listed")} ELSE {_said(S.RISK_FALLBACK)} || coalesce(p.listed, '') END AS listed FROM {source} s LEFT JOIN {name}_kept a USING (k) LEFT JOIN {name}_plain p USING (k)),
{name} AS (SELECT k, CASE WHEN text IS NULL THEN NULL WHEN length(text) > 20000 AND length(listed) < 2000 THEN {_said(S.RISK_KEPT)} || text ELSE {_said(S.RISK_NOTICE)} || listed END AS condensed FROM {name}_listed)"""


def _notes(name: str, source: str) -> str:
    """``name``: (k, statements, notes) of a (k, text) table, cut at the first notes opener far enough in."""
    opener = r"(?i)^\s*\**\s*(notes?\s+to\s+(the\s+)?(consolidated\s+|condensed\s+)*(unaudited\s+)?financial\s+statements|note\s*1\b|\(\s*1\s*\)\s*\w|1\s*[.\-]\s*(organization|summary|basis|description|nature)\b)"
    return f"""{_lines(f"{name}_lines", source)},
{name}_at AS (SELECT k, min(start) AS cut_at FROM {name}_lines l JOIN {source} s USING (k) WHERE regexp_matches(line, '{opener}') AND length({_strip("substr(s.text, 1, l.start)")}) > {S.NOTES_PREFIX} GROUP BY k),
{name} AS (SELECT k, CASE WHEN cut_at IS NULL THEN text ELSE {_strip("substr(text, 1, cut_at)")} END AS statements, CASE WHEN cut_at IS NOT NULL THEN {_strip("substr(text, cut_at + 1)")} END AS notes FROM {source} LEFT JOIN {name}_at USING (k))"""


_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){pattern}') THEN '{name}'" for name, pattern in S.PROXY_TOPICS) + " END"
_QUARTERLY = ", ".join(f"'{i}'" for i in S.QUARTERLY_ITEMS)

SECTIONS = rf"""{TEXTS},
filings_k AS (SELECT accession AS k, form, text, substr(accession, 4)::BIGINT AS n FROM filing_texts),
a_items AS (SELECT accession AS k, item, body FROM items JOIN filing_texts USING (accession) WHERE form = '10-K'),
a_wide AS (SELECT k, max(body) FILTER (WHERE item = '1') AS b1, max(body) FILTER (WHERE item = '1A') AS b1a, max(body) FILTER (WHERE item = '3') AS b3,
  concat_ws(chr(10) || chr(10), max(body) FILTER (WHERE item = '7'), max(body) FILTER (WHERE item = '7A')) AS mda, max(body) FILTER (WHERE item = '8') AS b8, max(body) FILTER (WHERE item = '15') AS b15 FROM a_items GROUP BY k),
a_risk AS (SELECT k, b1a AS text FROM a_wide),
{condensed_sql("a_condensed", "a_risk")},
a_eight AS (SELECT k, CASE WHEN b15 IS NOT NULL AND length(coalesce(b8, '')) < {4 * S.MIN_SECTION} THEN b15 ELSE b8 END AS text FROM a_wide),
{_notes("a_notes", "a_eight")},
a_parts AS (
  SELECT k, '08N_Notes' AS suffix, 'Item 8 - Notes (all)' AS section, {_said(S.NOTES_NOTICE)} || notes AS body FROM a_notes JOIN filings_k USING (k) WHERE n % 2 = 0
  UNION ALL SELECT k, '01_Business', 'Item 1 - Business', b1 FROM a_wide JOIN filings_k USING (k) WHERE n % 3 <> 0
  UNION ALL SELECT k, '1A_RiskFactors', 'Item 1A - Risk Factors', condensed FROM a_condensed
  UNION ALL SELECT k, '03_LegalProceedings', 'Item 3 - Legal Proceedings', b3 FROM a_wide WHERE length(b3) >= 2000
  UNION ALL SELECT k, '08_Financials', 'Item 8 - Financial Statements', statements FROM a_notes
  UNION ALL SELECT k, '07_MDA', 'Item 7/7A - MD&A and market risk', mda FROM a_wide WHERE mda <> ''
  UNION ALL SELECT k, 'Full', '10-K (unsplit)', {_said(S.UNSPLIT.format("10-K"))} || text FROM filings_k WHERE form = '10-K' AND k NOT IN (SELECT k FROM a_wide)),
q_texts AS (SELECT k, text FROM filings_k WHERE form = '10-Q'),
{_lines("q_lines", "q_texts")},
q_heads AS (SELECT k, start, upper(regexp_extract(line, '(?i)^\s*\**\s*PART\s+(I{{1,3}}\b|IV\b)', 1)) AS part, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start), total) - start AS size
  FROM q_lines WHERE regexp_matches(line, '(?i)^\s*\**\s*PART\s+(I{{1,3}}|IV)\b')),
q_one AS (SELECT * FROM q_heads WHERE part = 'I' AND size >= {S.MIN_SECTION} QUALIFY row_number() OVER (PARTITION BY k ORDER BY size DESC, start) = 1),
q_part AS (SELECT t.k, CASE WHEN o.k IS NULL THEN t.text ELSE substr(t.text, o.start + 1, o.size) END AS text FROM q_texts t LEFT JOIN q_one o USING (k)),
{_lines("q_part_lines", "q_part")},
q_sized AS (SELECT k, start, total, list_position([{_QUARTERLY}], upper(regexp_extract(line, '(?i)^\s*\**\s*ITEM\s+([0-9]{{1,2}}[A-C]?)', 1))) AS rank, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start), total) - start AS size
  FROM q_part_lines WHERE regexp_matches(line, '(?i)^\s*\**\s*ITEM\s+[0-9]{{1,2}}')),
q_taken AS (SELECT * FROM q_sized WHERE rank > 0 AND size >= {S.MIN_SECTION} QUALIFY rank > coalesce(max(rank) OVER (PARTITION BY k ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)),
q_bounded AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start), total) AS stop, count(*) OVER (PARTITION BY k) AS held FROM q_taken),
q_items AS (SELECT k, rank, {_strip("substr(text, start + 1, stop - start)")} AS body FROM q_bounded JOIN q_part USING (k) WHERE held >= 2),
q_statements AS (SELECT k, body AS text FROM q_items WHERE rank = 1),
{_notes("q_notes", "q_statements")},
q_parts AS (
  SELECT k, 'Notes' AS suffix, 'Part I Item 1 - Notes (all)' AS section, {_said(S.NOTES_NOTICE)} || notes AS body FROM q_notes JOIN filings_k USING (k) WHERE n % 2 = 0
  UNION ALL SELECT k, 'Financials', 'Part I Item 1 - Financial Statements', statements FROM q_notes
  UNION ALL SELECT k, 'MDA', 'Part I Item 2 - MD&A', body FROM q_items WHERE rank = 2
  UNION ALL SELECT k, 'Full', '10-Q (unsplit)', {_said(S.UNSPLIT.format("10-Q"))} || text FROM q_texts WHERE k NOT IN (SELECT k FROM q_items)),
p_texts AS (SELECT k, text FROM filings_k WHERE form = 'DEF 14A'),
{_lines("p_lines", "p_texts")},
p_heads AS (SELECT k, start, {_TOPIC} AS topic, length({_strip("line")}) AS long, coalesce(lead(start) OVER (PARTITION BY k ORDER BY start), total) - start AS size FROM p_lines WHERE regexp_matches(line, '^\s*\*\*') AND length({_strip("line")}) < 250 AND {_TOPIC} IS NOT NULL),
p_bodies AS (SELECT k, topic, start, {_strip("substr(text, start + 1, size)")} AS body FROM p_heads JOIN p_texts USING (k)),
p_best AS (SELECT * FROM p_bodies WHERE length(body) >= {S.MIN_SECTION} QUALIFY row_number() OVER (PARTITION BY k, topic ORDER BY length(body) DESC, start) = 1),
p_parts AS (
  SELECT k, topic AS suffix, topic AS section, CASE WHEN length(body) > {S.MAX_PROXY} THEN substr(body, 1, {S.MAX_PROXY}) || {_said(S.PROXY_CUT)} ELSE body END AS body FROM p_best
  UNION ALL SELECT k, 'Full', 'Proxy statement (unsplit)', {_said(S.UNSPLIT.format("proxy"))} || text FROM p_texts WHERE k NOT IN (SELECT k FROM p_best)),
parts_of AS (
  SELECT k, form, '1997-12-31' AS period_end, section, 'T' || n || CASE form WHEN '10-Q' THEN '_QE' ELSE '_FYE' END || '1997-12-31_' || replace(form, 'DEF 14A', 'DEF14A') || '_' || suffix || '.md' AS filename, {_strip("body")} AS body, n
  FROM (SELECT * FROM a_parts UNION ALL SELECT * FROM q_parts UNION ALL SELECT * FROM p_parts) JOIN filings_k USING (k) WHERE body IS NOT NULL
  UNION ALL SELECT k, '8-K Item 2.02 - earnings release (EX-99.1)', 'see headline (released 1998-02-15)', 'Earnings press release (full)', 'T' || n || '_REL1998-02-15_EarningsRelease.md', {_strip("text")}, n FROM filings_k WHERE form = '8-K' AND length(text) >= {2 * S.MIN_SECTION}),
sections AS (SELECT 'T' || n AS ticker, k AS accession, form, period_end, '1998-02-15' AS filed, 'http://x/' || n AS source, section, filename, length(body)::BIGINT AS chars, body FROM parts_of)"""


def _line(key: str, value: str) -> str:
    return f"""CASE WHEN length({value}) > 0 THEN '{key}: ' || CASE WHEN regexp_matches({value}, '[:#"]') OR starts_with({value}, ' ') THEN '"' || replace({value}, '"', '''') || '"' ELSE {value} END || chr(10) ELSE '' END"""


_HEAD = " || ".join(_line(k, v) for k, v in [("ticker", "ticker"), ("company", "('Company ' || substr(ticker, 2))"), *((c, c) for c in ("form", "period_end", "filed", "accession", "source", "section"))])

CONDENSED = f"WITH {TEXTS}, whole AS (SELECT accession AS k, text FROM filing_texts), {condensed_sql('short', 'whole')} SELECT k AS accession, condensed FROM short"
BY_FORM = f"WITH {SECTIONS} SELECT * FROM sections WHERE form = "
ALL = f"WITH {SECTIONS} SELECT * FROM sections"
DOCUMENTS = f"WITH {SECTIONS} SELECT ticker, filename, '---' || chr(10) || {_HEAD} || '---' || chr(10) || body || chr(10) AS document FROM sections"
READ = f"WITH {SECTIONS} SELECT filename, chars, section, form, period_end, filed, source, accession FROM sections"
SUMMARY = f"WITH {SECTIONS} SELECT ticker, count(*) AS files, sum(chars)::BIGINT AS chars, max(filed) AS newest, (sum(chars)::BIGINT // 4)::BIGINT AS tokens FROM sections GROUP BY ticker"
FILES = f"WITH {SECTIONS} SELECT ticker, string_agg('| `' || filename || '` | ' || form || ' | ' || period_end || ' | ' || section || ' |', chr(10) ORDER BY filename) AS rows FROM sections GROUP BY ticker"
NOTES = f"WITH {SECTIONS} SELECT ticker, coalesce(string_agg(form || ' ' || period_end, ', ' ORDER BY period_end, filename) FILTER (WHERE contains(section, 'Notes (all)')), 'none') AS notes_periods FROM sections GROUP BY ticker"


def index_sql(as_of: str) -> str:
    """The index page of every company of the texts, all of the full tier and without prior work."""
    caps = I.LEFT_OUT.format(notes="{notes}", annual=PLAN_LIMITS["10-K"], quarterly=PLAN_LIMITS["10-Q"], proxy=PLAN_LIMITS["DEF 14A"], releases=PLAN_LIMITS["8-K"])
    before, after = caps.split("{notes}")
    covered = " || ".join(f"'- {label}: ' || coalesce(held_{k}, 0) || chr(10)" for k, (_, label) in enumerate(I.COVERED))
    held = ", ".join(f"count(DISTINCT accession) FILTER (WHERE starts_with(form, '{kind}')) AS held_{k}" for k, (kind, _) in enumerate(I.COVERED))
    return f"""WITH {SECTIONS},
own AS (SELECT ticker, count(*) AS files, sum(chars)::BIGINT AS chars, max(filed) AS newest, {held},
  string_agg('| `' || filename || '` | ' || form || ' | ' || period_end || ' | ' || section || ' |' || chr(10), '' ORDER BY filename) AS rows,
  string_agg(form || ' ' || period_end, ', ' ORDER BY period_end, filename) FILTER (WHERE contains(section, 'Notes (all)')) AS notes FROM sections GROUP BY ticker),
companies AS (SELECT 'T' || n AS ticker, 'Company ' || n AS company FROM filings_k)
SELECT ticker, '# ' || ticker || ' - ' || company || {_said(f": corpus index{chr(10)}{chr(10)}{I.READ_FIRST}{chr(10)}{chr(10)}- **Tier:** full{chr(10)}- **As of:** built {as_of}; newest document dated ")} || coalesce(newest, 'unknown')
  || chr(10) || '- Files: ' || coalesce(files, 0) || chr(10) || '- Total size: ' || format('{{:,}}', coalesce(chars, 0)) || ' characters (roughly ' || format('{{:,}}', coalesce(chars, 0) // 4) || ' tokens)'
  || {_said(f"{chr(10)}{chr(10)}## Coverage{chr(10)}{chr(10)}")} || {covered} || {_said(f"{I.CALLS}{chr(10)}{chr(10)}## Files{chr(10)}{chr(10)}| File | Form | Period | Section |{chr(10)}| --- | --- | --- | --- |{chr(10)}")} || coalesce(rows, '')
  || {_said(f"{chr(10)}## What was deliberately left out{chr(10)}{chr(10)}{before}")} || coalesce(notes, 'none') || {_said(f"{after}{chr(10)}")}
  || {_said(f"{chr(10)}## Not included - use Quartr for these{chr(10)}{chr(10)}{I.ELSEWHERE}{chr(10)}{chr(10)}## Prior work in this folder{chr(10)}{chr(10)}{I.PRIOR}{chr(10)}- (none yet){chr(10)}")} AS document
FROM companies LEFT JOIN own USING (ticker)"""
