"""DuckDB SQL twins of the fixtures and operators, for the correctness gate.

Each function returns SQL text over the pre-registered views (``events``,
``documents``, ``embeddings`` ...). Word lists are stated here a second time;
fixture templates and theme texts are shared parameters. The computation is
DuckDB's own."""

from __future__ import annotations

from murmur.functions import lexicon as lx
from murmur.functions.text import PY_LINE_BREAK_REGEX, PY_WHITESPACE, PY_WS_CLASS
from murmur.plans.fixtures import FEEDBACK_TEMPLATES, FIXTURE_INGEST_TS, PHRASES


# --- fixed values: the rules as the twins state them, on their own --------------
HIGH_WORDS = ["crash", "crashes", "crashing", "freeze", "freezes", "freezing", "cannot", "can't", "unable", "failure",
              "fails", "failed", "broken", "unreliable"]
MEDIUM_WORDS = ["slow", "painfully", "frustrating", "difficult", "confusing", "extremely", "forever", "too many",
                "too long", "takes too long"]
DELAY_REGEX = r"\b\d+\s*(day|days|week|weeks|hour|hours)\b"
DELAY_WORDS = ["several days", "almost a week", "days", "weeks"]
NEGATIVE = ["crash", "freeze", "slow", "unable", "cannot", "error", "fail", "broken", "confusing", "no response",
            "boring", "took"]
POSITIVE = ["love", "great", "easy", "clean", "happy"]
KEYWORDS = ["upload", "pdf", "document", "crash", "freeze", "load", "opening", "start", "slow", "support", "days",
            "week", "reply", "response", "export", "download", "fail", "failure", "cannot", "unable", "error"]
# -------------------------------------------------------------------------------


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def any_sub(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def count_sub(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {q(w)}) AS INTEGER)" for w in words) + ")"


def np_round(expr: str, digits: int = 3) -> str:
    scale = float(10 ** digits)
    return f"(round_even(({expr}) * CAST({scale} AS DOUBLE), 0) / CAST({scale} AS DOUBLE))"


def whole_days(first: str, last: str) -> str:
    return f"CAST((epoch_us({last}) - epoch_us({first})) // 86400000000 AS INTEGER)"


def py_strip(expr: str) -> str:
    return f"trim({expr}, {_unicode_literal(PY_WHITESPACE)})"


def _unicode_literal(s: str) -> str:
    # DuckDB has no escape syntax in plain literals; build with chr()
    return "(" + " || ".join(f"chr({ord(c)})" for c in s) + ")"


# --- fixtures -------------------------------------------------------------------
def feedback_cte() -> str:
    templates = "[" + ", ".join(q(t) for t in FEEDBACK_TEMPLATES) + "]"
    return f"""fb AS (
  SELECT event_id AS pos, CAST(event_id AS VARCHAR) AS id,
         ({templates})[CAST(event_id % 16 AS INTEGER) + 1] AS text,
         event_type AS source, CAST(ts AS TIMESTAMP) AS date
  FROM events)"""


def severity_case(text: str = "text") -> str:
    low = f"lower({text})"
    return f"""CASE WHEN {any_sub(low, HIGH_WORDS)} THEN 'HIGH'
     WHEN regexp_matches({low}, {q(DELAY_REGEX)}) THEN 'HIGH'
     WHEN {any_sub(low, DELAY_WORDS)} THEN 'HIGH'
     WHEN {any_sub(low, MEDIUM_WORDS)} THEN 'MEDIUM'
     ELSE 'LOW' END"""


def severity_score_case(label: str = "severity") -> str:
    return f"CASE {label} WHEN 'HIGH' THEN CAST(1.0 AS DOUBLE) WHEN 'MEDIUM' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END"


def enriched_cte(src: str = "fb", name: str = "enr") -> str:
    low = "lower(text)"
    neg, pos = count_sub(low, NEGATIVE), count_sub(low, POSITIVE)
    return f"""{name}_c AS (
  SELECT *, {neg} AS _neg, {pos} AS _pos, {severity_case()} AS severity FROM {src}),
{name} AS (
  SELECT * EXCLUDE (_neg, _pos),
         CASE WHEN _neg > _pos THEN 'negative' ELSE 'positive' END AS sentiment,
         CASE WHEN _neg + _pos > 0
              THEN CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(abs(_neg - _pos) AS DOUBLE) / CAST(_neg + _pos AS DOUBLE)
              ELSE CAST(0.5 AS DOUBLE) END AS sentiment_score,
         {severity_score_case()} AS severity_score
  FROM {name}_c)"""


def phrased_cte(name: str = "phr") -> str:
    phrases = "[" + ", ".join(q(t) for t in PHRASES) + "]"
    n = len(PHRASES)
    return f"""{name}_p AS (
  SELECT doc_id, text, ({phrases})[CAST(doc_id % {n} AS INTEGER) + 1] AS phrase, length(text) // 2 AS half FROM documents),
{name} AS (
  SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id,
         substr(text, 1, half) || ' ' || phrase || ' ' || substr(text, half + 1) AS text FROM {name}_p)"""


def clustered_cte() -> str:
    return f"""{feedback_cte()},
{enriched_cte()},
clu AS (
  SELECT *, CAST(CASE
      WHEN pos % 16 IN (0, 1) THEN 0
      WHEN pos % 16 IN (2, 3) THEN 1
      WHEN pos % 16 IN (4, 5, 6) AND source <> 'view' THEN 2
      WHEN pos % 16 IN (7, 8, 9) AND source IN ('error', 'click') THEN 3
      WHEN pos % 16 IN (10, 11) AND date < TIMESTAMP '2024-01-10' THEN 4
      WHEN pos % 16 IN (12, 13, 14) THEN 5
      ELSE -1 END AS INTEGER) AS cluster
  FROM enr)"""


# --- scoring (A2-A26) over a CTE named by ``src`` with the enriched columns ----------
def _kw(w: str) -> str:
    return "kw_" + w


def _kw_any(*words) -> str:
    return "(" + " OR ".join(_kw(w) for w in words) + ")"


def _theme_case(kind: str) -> str:
    export = f"({_kw_any('export', 'download')} AND {_kw_any('fail', 'failure', 'cannot', 'unable', 'error', 'crash')})"
    slow = f"({_kw_any('load', 'opening', 'start')} AND {_kw('slow')})"
    if kind == "summary":
        upload = f"({_kw('upload')} AND {_kw_any('pdf', 'document')} AND {_kw_any('crash', 'freeze')})"
        support = f"({_kw('support')} AND {_kw_any('days', 'week', 'reply', 'response')})"
    else:
        upload = f"({_kw('upload')} AND {_kw_any('crash', 'freeze')})"
        words = ("days", "week", "response", "reply") if kind == "pattern" else ("days", "week", "response")
        support = f"({_kw('support')} AND {_kw_any(*words)})"
    return f"""CASE WHEN {upload} THEN 'UPLOAD_FAILURE' WHEN {slow} THEN 'SLOW_STARTUP'
     WHEN {support} THEN 'SUPPORT_DELAY' WHEN {export} THEN 'EXPORT_FAILURE' ELSE 'GENERIC' END"""


def _text_case(code: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {code} = {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def scoring_ctes(src: str) -> str:
    kws = ",\n         ".join(f"bool_or(contains(lower(text), {q(w)})) AS {_kw(w)}" for w in KEYWORDS)
    return f"""per AS (
  SELECT cluster, count(*) AS evidence_count,
         count(*) FILTER (WHERE sentiment = 'negative') AS negative_evidence,
         list_sort(list_distinct(list(source))) AS sources,
         min(date) AS first_seen_ts, max(date) AS last_seen_ts,
         sum(CASE severity WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 6 ELSE 3 END) AS severity_tenths,
         {kws}
  FROM {src} WHERE cluster <> -1 GROUP BY cluster),
sevc AS (
  SELECT cluster, severity, count(*) AS n, min(pos) AS first_pos
  FROM {src} WHERE cluster <> -1 GROUP BY cluster, severity),
dom AS (
  SELECT cluster, arg_max(severity, {{'n': n, 'f': -first_pos}}) AS severity FROM sevc GROUP BY cluster),
gstat AS (
  SELECT count(DISTINCT source) AS total_sources, min(date) AS dmin, max(date) AS dmax FROM {src}),
mf AS (SELECT max(evidence_count) AS max_freq FROM per),
s1 AS (
  SELECT per.*, dom.severity,
         CAST(len(sources) AS BIGINT) AS source_count,
         CAST(evidence_count AS DOUBLE) / CAST(max_freq AS DOUBLE) AS frequency_score,
         CAST(negative_evidence AS DOUBLE) / CAST(evidence_count AS DOUBLE) AS negative_ratio_raw,
         CAST(len(sources) AS DOUBLE) / CAST(total_sources AS DOUBLE) AS source_diversity,
         {whole_days('first_seen_ts', 'last_seen_ts')} AS time_span_days,
         {whole_days('dmin', 'dmax')} AS dataset_span,
         CAST(severity_tenths AS DOUBLE) / CAST(10.0 AS DOUBLE) / CAST(evidence_count AS DOUBLE) AS severity_raw
  FROM per JOIN dom USING (cluster), gstat, mf),
s2 AS (
  SELECT *, CASE WHEN dataset_span > 0 THEN CAST(time_span_days AS DOUBLE) / CAST(dataset_span AS DOUBLE)
                 ELSE CAST(0.0 AS DOUBLE) END AS temporal_score
  FROM s1),
s3 AS (
  SELECT *, CAST(0.25 AS DOUBLE) * frequency_score + CAST(0.25 AS DOUBLE) * negative_ratio_raw
            + CAST(0.15 AS DOUBLE) * source_diversity + CAST(0.15 AS DOUBLE) * temporal_score
            + CAST(0.20 AS DOUBLE) * severity_raw AS evidence_raw
  FROM s2),
s4 AS (
  SELECT *, CAST(0.50 AS DOUBLE) * evidence_raw + CAST(0.50 AS DOUBLE) * severity_raw AS priority_raw FROM s3),
scored AS (
  SELECT *,
         CASE WHEN evidence_raw >= CAST(0.70 AS DOUBLE) THEN 'STRONG SIGNAL' ELSE 'WEAK SIGNAL' END AS signal_strength,
         CASE WHEN priority_raw >= CAST(0.80 AS DOUBLE) THEN 'HIGH' WHEN priority_raw >= CAST(0.60 AS DOUBLE) THEN 'MEDIUM' ELSE 'LOW' END AS priority,
         {np_round('priority_raw')} AS priority_score,
         {np_round('severity_raw')} AS severity_score,
         {np_round('evidence_raw')} AS evidence_score,
         {np_round('negative_ratio_raw')} AS negative_ratio,
         strftime(first_seen_ts, '%Y-%m-%d') AS first_seen,
         strftime(last_seen_ts, '%Y-%m-%d') AS last_seen,
         {_theme_case('summary')} AS theme,
         {_theme_case('pattern')} AS _pattern_theme,
         {_theme_case('impact')} AS _impact_theme
  FROM s4 WHERE negative_evidence > 0),
insights AS (
  SELECT *,
         {_text_case('theme', lx.THEME_SUMMARY)} AS problem_summary,
         replace({_text_case('_pattern_theme', lx.THEME_PATTERN)}, '%s', array_to_string(sources, ', ')) AS observed_pattern,
         {_text_case('_impact_theme', lx.THEME_IMPACT)} AS customer_impact,
         row_number() OVER (ORDER BY priority_score DESC, cluster ASC) AS rank
  FROM scored)"""


INSIGHT_SQL_COLUMNS = (
    "cluster, problem_summary, observed_pattern, customer_impact, theme, signal_strength, priority, "
    "priority_score, severity, severity_score, evidence_score, evidence_count, negative_evidence, "
    "negative_ratio, array_to_string(sources, ', ') AS sources, source_count, first_seen, last_seen, time_span_days"
)


# --- similarity and clustering (C1-C4) --------------------------------------------
def vec_double(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE[])"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({vec_double(a)}, {vec_double(b)})"


def pairs_cte(src: str, id_col: str, vec_col: str, eps: float, name: str = "pairs") -> str:
    return f"""{name} AS (
  SELECT a.{id_col} AS src, b.{id_col} AS dst,
         CAST(1.0 AS DOUBLE) - {cosine(f'a.{vec_col}', f'b.{vec_col}')} AS distance
  FROM {src} a JOIN {src} b ON a.{id_col} < b.{id_col}
  WHERE CAST(1.0 AS DOUBLE) - {cosine(f'a.{vec_col}', f'b.{vec_col}')} <= CAST({eps!r} AS DOUBLE))"""


def components_ctes(vertices: str, edges: str, name: str = "cc") -> str:
    """Recursive reachability; component = smallest reachable id."""
    return f"""{name}_und AS (
  SELECT src AS a, dst AS b FROM {edges} UNION ALL SELECT dst AS a, src AS b FROM {edges}),
{name}_reach(node, label) AS (
  SELECT id, id FROM {vertices}
  UNION
  SELECT u.b, r.label FROM {name}_reach r JOIN {name}_und u ON u.a = r.node),
{name} AS (SELECT node AS id, min(label) AS component FROM {name}_reach GROUP BY node)"""


def dbscan_ctes(src: str, id_col: str, vec_col: str, eps: float, min_samples: int, name: str = "db",
                weight: str = "1") -> str:
    """``{name}`` = (id, cluster) for every row of ``src`` (-1 = noise); a row
    stands for ``weight`` rows with its vector."""
    w = "1" if weight == "1" else f"o.{weight}"
    return f"""{pairs_cte(src, id_col, vec_col, eps, name + '_pairs')},
{name}_deg AS (
  SELECT s.{id_col} AS id,
         (CASE WHEN CAST(1.0 AS DOUBLE) - {cosine(f's.{vec_col}', f's.{vec_col}')} <= CAST({eps!r} AS DOUBLE) THEN {weight} ELSE 0 END)
         + coalesce((SELECT sum({w}) FROM {name}_pairs p JOIN {src} o
                     ON (p.src = s.{id_col} AND o.{id_col} = p.dst) OR (p.dst = s.{id_col} AND o.{id_col} = p.src)), 0) AS degree
  FROM {src} s),
{name}_core AS (SELECT id FROM {name}_deg WHERE degree >= {int(min_samples)}),
{name}_cedge AS (
  SELECT p.src, p.dst FROM {name}_pairs p
  JOIN {name}_core c1 ON c1.id = p.src JOIN {name}_core c2 ON c2.id = p.dst),
{components_ctes(f'{name}_core', f'{name}_cedge', name + '_cc')},
{name}_border AS (
  SELECT CASE WHEN c.id = p.src THEN p.dst ELSE p.src END AS id, min(cc.component) AS component
  FROM {name}_pairs p
  JOIN {name}_core c ON c.id IN (p.src, p.dst)
  JOIN {name}_cc cc ON cc.id = c.id
  WHERE (CASE WHEN c.id = p.src THEN p.dst ELSE p.src END) NOT IN (SELECT id FROM {name}_core)
  GROUP BY 1),
{name}_lab AS (SELECT id, component FROM {name}_cc UNION ALL SELECT id, component FROM {name}_border),
{name}_num AS (
  SELECT component, CAST(row_number() OVER (ORDER BY component) - 1 AS INTEGER) AS cluster
  FROM (SELECT DISTINCT component FROM {name}_lab)),
{name} AS (
  SELECT s.{id_col} AS id, CAST(coalesce(n.cluster, -1) AS INTEGER) AS cluster
  FROM {src} s LEFT JOIN {name}_lab l ON l.id = s.{id_col} LEFT JOIN {name}_num n USING (component))"""


def centroid_ctes(src: str, group_col: str, vec_col: str, name: str = "cent") -> str:
    """``{name}`` = (group, centroid DOUBLE[]): element-wise mean."""
    return f"""{name}_x AS (
  SELECT {group_col} AS grp, i, CAST({vec_col}[i] AS DOUBLE) AS x
  FROM {src}, range(1, len({vec_col}) + 1) t(i)),
{name} AS (
  SELECT grp, list(m ORDER BY i) AS centroid FROM (SELECT grp, i, avg(x) AS m FROM {name}_x GROUP BY grp, i) GROUP BY grp)"""


# --- standardisation (P1-P9, S1, S2) ------------------------------------------------
DATE_STRPTIME = ("%Y/%m/%d %H:%M:%S", "%Y/%m/%d %H:%M", "%Y/%m/%d",
                 "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y",
                 "%d/%m/%Y %H:%M:%S", "%d/%m/%Y %H:%M", "%d/%m/%Y")


def messy_cte(csv_quirks: bool = False, name: str = "messy") -> str:
    plain = "'plain text ' || CAST(event_id AS VARCHAR)"
    if csv_quirks:
        plain = (f"CASE WHEN event_id % 3 = 0 THEN 'plain \"q\"' || chr(10) || 'text ' || CAST(event_id AS VARCHAR) "
                 f"ELSE {plain} END")
    return f"""{name} AS (
  SELECT event_id AS pos,
         CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'nan'
              WHEN event_id % 7 = 0 THEN chr(9) || 'padded text ' || CAST(event_id AS VARCHAR) || '  '
              ELSE {plain} END AS review,
         event_id AS ticket_id,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS channel,
         CASE WHEN event_id % 17 = 0 THEN 'not a date' WHEN event_id % 19 = 0 THEN strftime(ts, '%d/%m/%Y')
              WHEN event_id % 23 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
              WHEN event_id % 29 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+02:00')
              WHEN event_id % 31 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.125')
              WHEN event_id % 37 = 0 THEN strftime(ts, '%Y/%m/%d')
              WHEN event_id % 41 = 0 THEN CAST(epoch_us(ts) // 1000000 * 1000000000 AS VARCHAR)
              ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS created_at
  FROM events)"""


def parse_date_sql(expr: str) -> str:
    tries = ", ".join(f"try_strptime({expr}, {q(f)})" for f in DATE_STRPTIME)
    iso = f"regexp_matches({expr}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}([T ].*)?$')"
    return f"""coalesce(CASE
      WHEN regexp_matches({expr}, '^[+-]?[0-9]{{1,19}}$') THEN make_timestamp(CAST({expr} AS HUGEINT)::BIGINT // 1000)
      WHEN {iso} AND regexp_matches({expr}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$')
        THEN make_timestamp(epoch_us(try_cast({expr} AS TIMESTAMPTZ)))
      WHEN {iso} THEN try_cast({expr} AS TIMESTAMP) END, {tries}, TIMESTAMP '{FIXTURE_INGEST_TS}')"""


def standardized_cte(src: str, text: str, id_expr: str, source: str, date: str, name: str = "std") -> str:
    return f"""{name}_raw AS (
  SELECT pos, {id_expr} AS id, {py_strip(text)} AS text,
         {f"coalesce({source}, 'unknown')" if source else "'uploaded_file'"} AS source,
         {parse_date_sql(date) if date else f"TIMESTAMP '{FIXTURE_INGEST_TS}'"} AS date
  FROM {src}),
{name} AS (SELECT * FROM {name}_raw WHERE text IS NOT NULL AND text NOT IN ('', 'nan'))"""


STD_OUT = "id, text, source, strftime(date, '%Y-%m-%d %H:%M:%S') AS date"


# --- segmenters (S3-S5) ----------------------------------------------------------------
SENTENCE_SEP = "chr(57344)"   # a private-use character marks sentence breaks (RE2 has no lookaround)


def lines_unnest(list_expr: str, src: str, extra: str = "") -> str:
    return f"(SELECT doc_id{extra}, {list_expr} AS l FROM {src}) z, range(1, len(l) + 1) t(i)"


def text_lines_sql(src: str = "documents") -> str:
    ws = _unicode_literal(PY_WHITESPACE)
    lst = (f"list_filter(list_transform(string_split_regex(text, {q(PY_LINE_BREAK_REGEX)}), lambda x: trim(x, {ws})), "
           f"lambda x: x <> '')")
    return f"SELECT doc_id, CAST(i AS VARCHAR) AS id, l[i] AS text, 'text_file' AS source FROM {lines_unnest(lst, src)}"


def paragraphs_sql(src: str, break_regex: str) -> str:
    ws = _unicode_literal(PY_WHITESPACE)
    lst = (f"list_filter(list_transform(string_split_regex(text, {q(break_regex)}), lambda x: trim(x, {ws})), "
           f"lambda x: x <> '')")
    return f"SELECT doc_id, CAST(i AS VARCHAR) AS id, l[i] AS text, 'docx' AS source FROM {lines_unnest(lst, src)}"


def page_lines_ctes(src: str, bullet: str, numbering: str) -> str:
    ws = _unicode_literal(PY_WHITESPACE)
    cls = PY_WS_CLASS
    norm = f"replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return f"""s5a AS (
  SELECT doc_id, page_no,
         list_filter(list_transform(string_split({norm}, chr(10)), lambda x: trim(x, {ws})),
                     lambda x: x <> '' AND length(x) >= 8) AS lines
  FROM {src}),
s5b AS (
  SELECT doc_id, page_no,
         list_filter(list_transform(lines, lambda x: trim(regexp_replace(trim(regexp_replace(x, {q(bullet)}, ''), {ws}),
                                                                          {q(numbering)}, ''), {ws})),
                     lambda x: x <> '') AS lines
  FROM s5a),
s5c AS (
  SELECT doc_id, page_no,
         list_filter(list_transform(flatten(list_transform(lines, lambda x: string_split(
             regexp_replace(x, {q('([.!?])' + cls + '+([A-Z])')}, '\\1' || {SENTENCE_SEP} || '\\2', 'g'), {SENTENCE_SEP}))),
             lambda x: trim(x, {ws})), lambda x: length(x) >= 8) AS s
  FROM s5b),
s5d AS (
  SELECT doc_id, page_no, s,
         coalesce(sum(len(s)) OVER (PARTITION BY doc_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM s5c)"""


def pages_fixture_cte(name: str = "pg") -> str:
    return f"""{name}_l AS (
  SELECT doc_id, i - 1 AS i, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) z,
         range(1, len(l) + 1) t(i)),
{name} AS (
  SELECT doc_id, CAST(i // 5 + 1 AS INTEGER) AS page_no,
         string_agg(CASE i % 4 WHEN 0 THEN '• ' || line WHEN 1 THEN CAST(i + 1 AS VARCHAR) || '. ' || line
                               WHEN 2 THEN '- ' || line ELSE line END, chr(13) || chr(10) ORDER BY i) AS text
  FROM {name}_l GROUP BY 1, 2)"""


def paragraphs_fixture_cte(name: str = "para") -> str:
    return f"""{name} AS (
  SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
           lambda x, i: x || CASE WHEN (i - 1) % 3 = 2 THEN chr(10) || ' ' || chr(10) ELSE chr(10) END), '') AS text
  FROM documents)"""
