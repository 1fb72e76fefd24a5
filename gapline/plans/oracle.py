"""The same results in DuckDB SQL, written for its regular expressions (RE2: no lookaround, ASCII \\b) and lambdas."""

from __future__ import annotations

from gapline import constants as C
from gapline.operators.lexicon import QUALIFICATION_SOURCES, SKILL_SOURCES
from gapline.plans.inputs import SPANS_SQL, quoted, values

SPACES = r"\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKEN = rf"[A-Za-z0-9]+(?:[+#.\-][A-Za-z0-9]+)*[+#]*|[^{SPACES}A-Za-z0-9]"


def listed(items) -> str:
    return ", ".join(map(quoted, items))


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN}')"


def chunks(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '[{SPACES}]+'), lambda c: c <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def bare(w: str) -> str:
    return f"coalesce(nullif(regexp_replace({w}, '^\\.+|\\.+$', '', 'g'), ''), {w})"


def acronym(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '^[a-z0-9](\\.[a-z0-9]){{2,}}$') THEN replace({w}, '.', '') ELSE {w} END"


def normalize(x: str) -> str:
    words = f"list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9+#.]+', ' ', 'g')), ' '), lambda w: w <> '')"
    return f"array_to_string(list_transform(list_transform({words}, lambda w: {bare('w')}), lambda w: {acronym('w')}), ' ')"


def fold(w: str) -> str:
    return (
        f"CASE WHEN {w} IN ({listed(C.UNFOLDED)}) OR NOT regexp_matches({w}, '^[a-z]+$') OR length({w}) <= 3 THEN {w} "
        f"WHEN ends_with({w}, 'ies') THEN left({w}, -3) || 'y' WHEN regexp_matches({w}, '(sses|shes|ches|xes)$') THEN left({w}, -2) "
        f"WHEN ends_with({w}, 's') AND NOT regexp_matches({w}, '(ss|us)$') THEN left({w}, -1) ELSE {w} END"
    )


def folded(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {fold('w')}), ' ')"


def canonical(name: str, source: str, raw: str = "raw") -> str:
    """CTEs that end in `name`(raw, canon) for the distinct values of a column."""
    return f"""{name}_0 AS (SELECT DISTINCT {raw} AS raw FROM {source}), {name}_1 AS (SELECT raw, {normalize('raw')} AS t FROM {name}_0),
{name}_2 AS (SELECT raw, {folded('coalesce(v, t)')} AS t FROM {name}_1 LEFT JOIN {values(C.ALIASES.items(), f'{name}_a(k, v)')} ON t = k),
{name} AS (SELECT raw, coalesce(v, t) AS canon FROM {name}_2 LEFT JOIN {values(C.ALIASES_FOLDED.items(), f'{name}_b(k, v)')} ON t = k)"""


SOURCES = [(t, True) for t in SKILL_SOURCES] + [(t, False) for t in QUALIFICATION_SOURCES]
LEXICON = f"""raw_terms AS (SELECT t AS raw FROM {values([(t,) for t, _ in SOURCES], 'raw_v(t)')}), {canonical('lex_c', 'raw_terms')},
lex AS (SELECT DISTINCT canon AS term FROM lex_c WHERE canon <> '')"""


def recognised(name: str, source: str, key: str = "span", words: str = "", lex: str = "lex") -> str:
    """CTEs that end in `name`(key, i, k, term): the windows that the scan consumes, for distinct keys of `source`.
    words: the list of words, if not those of the key itself; lex: where the terms are. Windows begin at words that can
    begin a term."""
    rows = f"(SELECT DISTINCT {key} FROM {source} WHERE {key} IS NOT NULL)" if not words else source
    words = words or f"list_filter({chunks(key)}, lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"
    first = f"split_part({normalize('word')}, ' ', 1)"
    return f"""{name}_w AS (SELECT {key}, {words} AS w FROM {rows}),
{name}_s AS (SELECT split_part(term, ' ', 1) AS s FROM {lex} UNION SELECT * FROM {values([(a.split(' ')[0],) for a in C.ALIASES], f'{name}_v(s)')}),
{name}_d AS (SELECT word FROM (SELECT word, {first} AS f FROM (SELECT DISTINCT unnest(w) AS word FROM {name}_w)) WHERE f = '' OR f IN (SELECT s FROM {name}_s) OR {fold('f')} IN (SELECT s FROM {name}_s)),
{name}_i AS (SELECT {key}, w, i FROM (SELECT {key}, w, unnest(w) AS word, unnest(range(len(w)))::INT AS i FROM {name}_w) JOIN {name}_d USING (word)),
{name}_k AS (SELECT {key}, w, i, k::INT AS k, array_to_string(w[i + 1 : i + k], ' ') AS raw FROM {name}_i, range(1, 7) AS r(k) WHERE i + k <= len(w)),
{canonical(f'{name}_c', f'{name}_k')},
{name}_h AS (SELECT {key}, i, k, canon AS term FROM {name}_k JOIN {name}_c USING (raw) JOIN {lex} ON canon = term
  WHERE length(canon) > 1 OR list_contains(list_transform(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z0-9]$')), lambda x: lower(x)), canon)),
{name}_b AS (SELECT {key}, i, max(k) AS k, max_by(term, k) AS term FROM {name}_h GROUP BY {key}, i),
{name} AS (WITH RECURSIVE f AS (
    SELECT {key}, i, k, term FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) AS n FROM {name}_b) WHERE n = 1
    UNION ALL
    SELECT {key}, i, k, term FROM (SELECT b.{key}, b.i, b.k, b.term, row_number() OVER (PARTITION BY b.{key} ORDER BY b.i) AS n
      FROM f JOIN {name}_b b ON b.{key} = f.{key} AND b.i >= f.i + f.k) WHERE n = 1)
  SELECT * FROM f)"""


NUM = r"\d{1,3}(?:,\d{3})+|\d+(?:[.,]\d{1,2})?|[.,]\d{1,2}"
MONTH = rf"({NUM})\s*(?:months?|mos?)\b"


def number(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^\\d{{1,3}}(,\\d{{3}})+$') THEN replace({x}, ',', '')::DOUBLE ELSE replace({x}, ',', '.')::DOUBLE END"


def years(name: str, source: str, raw: str = "span") -> str:
    """CTEs that end in `name`(raw, years); for spans without malformed numbers."""
    words = " ".join(f"WHEN regexp_matches(s, '\\b{w}\\b') THEN {float(n)}" for w, n in C.NUMBER_WORDS.items())
    return f"""{name}_0 AS (SELECT DISTINCT {raw} AS raw, {strip(f'lower({raw})')} AS s FROM {source}),
{name}_1 AS (SELECT raw, s, nullif(regexp_extract(s, '{MONTH}', 1), '') AS m,
  nullif(regexp_extract(regexp_replace(regexp_replace(s, '{MONTH}', ' '), '(?:{NUM})\\s*(?:st|nd|rd|th)\\b', ' ', 'g'), '({NUM})', 1), '') AS y FROM {name}_0),
{name}_2 AS (SELECT raw, s, CASE WHEN m IS NULL THEN NULL ELSE {number('m')} / 12 END AS m, CASE WHEN y IS NULL THEN NULL ELSE {number('y')} END AS y FROM {name}_1),
{name} AS (SELECT raw, CASE WHEN s = '' OR regexp_matches(s, '{C.DATE_RANGE_PATTERN}') OR regexp_matches(s, '{C.SCHOOLING_PATTERN}') OR regexp_matches(s, '(^|[^0-9])-[0-9.,]') THEN NULL
  WHEN m IS NOT NULL OR y IS NOT NULL THEN CASE WHEN coalesce(m, 0) + coalesce(y, 0) > 0 AND coalesce(m, 0) + coalesce(y, 0) <= {C.MOST_YEARS} THEN coalesce(m, 0) + coalesce(y, 0) END
  ELSE CASE {words} END END AS years FROM {name}_2)"""


def levels(name: str, canon: str) -> str:
    """CTE `name`(raw, level) of a canonical CTE."""
    return f"""{name} AS (SELECT raw, max(r) AS level FROM (SELECT raw, unnest(string_split(canon, ' ')) AS w FROM {canon})
  LEFT JOIN {values(C.DEGREE_RANKS.items(), f'{name}_r(d, r)')} ON w = d GROUP BY raw)"""


SKILLS = listed(C.SKILL_CATEGORIES)


def facts(spans: str) -> str:
    """Everything about spans that gaps, notes and gate are made of; `spans`: CTEs that end in jd_spans, resume_spans,
    pairs, jd_docs and resume_docs."""
    return f"""WITH {spans}, {LEXICON}, every_span AS (SELECT span FROM jd_spans UNION SELECT span FROM resume_spans), {recognised('rec', 'every_span')},
{canonical('canon', 'every_span', 'span')}, {levels('level', 'canon')}, {years('years', 'every_span')},
best AS (SELECT span, arg_max(term, (len(string_split(term, ' ')), length(term))) AS best FROM rec GROUP BY span),
held_terms AS (SELECT DISTINCT doc_key AS resume_key, term FROM resume_spans JOIN rec USING (span)),
held_level AS (SELECT doc_key AS resume_key, max(level) AS held FROM resume_spans JOIN level ON raw = span WHERE category = 'qualification' GROUP BY 1),
held_years AS (SELECT doc_key AS resume_key, max(years) AS held FROM resume_spans JOIN years ON raw = span WHERE category = 'yearofexperience' GROUP BY 1),
skill_missing AS (SELECT pair_id, category, ord, span, row_number() OVER (PARTITION BY pair_id, category, term ORDER BY ord) AS n
  FROM pairs JOIN jd_spans ON doc_key = jd_key JOIN rec USING (span)
  WHERE category IN ({SKILLS}) AND NOT EXISTS (SELECT 1 FROM held_terms h WHERE h.resume_key = pairs.resume_key AND h.term = rec.term)),
skill_gaps AS (SELECT DISTINCT pair_id, category, ord, span FROM skill_missing WHERE n = 1),
degree_missing AS (SELECT pair_id, category, ord, span, row_number() OVER (PARTITION BY pair_id, level ORDER BY ord) AS n
  FROM pairs JOIN jd_spans ON doc_key = jd_key JOIN level ON raw = span JOIN held_level USING (resume_key) WHERE category = 'qualification' AND level > held),
degree_gaps AS (SELECT pair_id, category, ord, span FROM degree_missing WHERE n = 1),
experience_gaps AS (SELECT pair_id, category, ord, span FROM pairs JOIN jd_spans ON doc_key = jd_key JOIN years ON raw = span JOIN held_years USING (resume_key)
  WHERE category = 'yearofexperience' AND years > held),
gaps AS (SELECT * FROM skill_gaps UNION ALL SELECT * FROM degree_gaps UNION ALL SELECT * FROM experience_gaps)"""


FACTS = facts(SPANS_SQL)


def generic(c: str) -> str:
    return f"(NOT regexp_matches({c}, '[\\p{{L}}\\p{{N}}]') OR {c} IN ({listed(C.GENERIC_TERMS)}))"


def noted(parts: tuple[str, str], col: str) -> str:
    return f"{quoted(parts[0])} || {col} || {quoted(parts[1])}"


def quotes(condition: str) -> str:
    return f"string_agg('''' || span || '''', ', ' ORDER BY ord) FILTER (WHERE {condition})"


def side_facts(name: str, spans: str) -> str:
    return f"""{name} AS (SELECT doc_key, {quotes(f"category IN ({SKILLS}) AND b.best IS NULL AND NOT {generic('canon')}")} AS unverified,
  {quotes(f"category = 'qualification' AND level IS NULL AND NOT {generic('canon')}")} AS unrankable, {quotes("category = 'qualification' AND level IS NOT NULL")} AS ranked,
  {quotes("category = 'yearofexperience'")} AS durations, count(years) FILTER (WHERE category = 'yearofexperience') AS n_years
  FROM {spans} s LEFT JOIN best b USING (span) LEFT JOIN canon c ON c.raw = s.span LEFT JOIN level l ON l.raw = s.span LEFT JOIN years y ON y.raw = s.span GROUP BY doc_key)"""


NOTES = f"""{side_facts('jd_facts', 'jd_spans')}, {side_facts('resume_facts', 'resume_spans')},
notes AS (SELECT pair_id, list_filter([
  {noted(C.NOTE_UNVERIFIED, 'j.unverified')}, {noted(C.NOTE_UNRANKABLE, 'j.unrankable')},
  CASE WHEN r.ranked IS NULL THEN {noted(C.NOTE_NO_DEGREE, 'j.ranked')} END,
  CASE WHEN j.durations IS NULL THEN NULL WHEN j.n_years = 0 THEN {noted(C.NOTE_JD_YEARS, 'j.durations')} WHEN coalesce(r.n_years, 0) > 0 THEN NULL
    WHEN r.durations IS NOT NULL THEN {noted(C.NOTE_RESUME_YEARS, 'r.durations')} ELSE {noted(C.NOTE_NO_YEARS, 'j.durations')} END], lambda x: x IS NOT NULL) AS notes
  FROM pairs LEFT JOIN jd_facts j ON j.doc_key = jd_key LEFT JOIN resume_facts r ON r.doc_key = resume_key)"""


def word(w: str) -> str:
    core = f"regexp_replace({w}, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
    return f"(length({core}) <= {C.MOST_WORD_CHARS} AND regexp_matches({core}, '[A-Za-z]') AND regexp_matches({core}, '^[\\p{{L}}\\p{{N}}+#.\\-''&/]+$'))"


def n_words(x: str) -> str:
    return f"len(list_filter({chunks(x)}, lambda c: {word('c')}))"


def n_chunks(x: str) -> str:
    return f"len(list_filter({chunks(x)}, lambda c: regexp_matches(c, '[\\p{{L}}\\p{{N}}]')))"


def unreadable(side: str) -> str:
    """Reason and hint of (text, words, chunks), as struct."""
    a, b, c, d = C.UNREADABLE
    return f"""CASE WHEN text IS NULL THEN NULL WHEN {strip('text')} = '' THEN {{'reason': {quoted(C.EMPTY_TEXT[0] + side + C.EMPTY_TEXT[1])}, 'hint': {quoted(C.HINT_EMPTY)}}}
  WHEN chunks > 0 AND words >= chunks * {C.PROSE_RATIO} THEN NULL
  ELSE {{'reason': {quoted(a + side + b)} || words || {quoted(c)} || chunks || {quoted(d)}, 'hint': {quoted(C.HINT_UNREADABLE)}}} END"""


def found(reason: str, hint: str) -> str:
    return f"{{'reason': {reason}, 'hint': {quoted(hint)}}}"


def counted(name: str, docs: str, spans: str) -> str:
    return f"""{name} AS (SELECT d.doc_key, text, {n_words('text')} AS words, {n_chunks('text')} AS chunks, coalesce(n, 0) AS n FROM {docs} d
  LEFT JOIN (SELECT doc_key, count(DISTINCT best) AS n FROM {spans} JOIN best USING (span) WHERE category IN ({listed(C.COMPARABLE)}) GROUP BY 1) t USING (doc_key))"""


GATE = f"""{counted('jd_counted', 'jd_docs', 'jd_spans')}, {counted('resume_counted', 'resume_docs', 'resume_spans')},
jd_found AS (SELECT doc_key, coalesce({unreadable('job description')}, CASE WHEN n < 1 THEN {found(quoted(C.NO_REQUIREMENT), C.HINT_NO_REQUIREMENT)} END) AS p FROM jd_counted),
resume_found AS (SELECT doc_key, coalesce({unreadable('resume')}, CASE WHEN n >= 1 THEN NULL WHEN text IS NULL THEN {found(quoted(C.NO_RESUME_TEXT), C.HINT_NO_TEXT)}
  WHEN words < {C.PROSE_WORDS} THEN {found(f"{quoted(C.THIN_RESUME[0])} || words || {quoted(C.THIN_RESUME[1])}", C.HINT_THIN)} END) AS q FROM resume_counted),
judged AS (SELECT pair_id, jd_key, resume_key, p, q, coalesce(p.reason || '; ' || q.reason, p.reason, q.reason) AS detail,
  CASE WHEN p.hint = q.hint THEN p.hint ELSE coalesce(p.hint || ' ' || q.hint, p.hint, q.hint) END AS hints
  FROM pairs LEFT JOIN jd_found j ON j.doc_key = jd_key LEFT JOIN resume_found r ON r.doc_key = resume_key),
gate AS (SELECT pair_id, jd_key, resume_key, upper(left(detail, 1)) || substr(detail, 2) || '. ' || hints AS problem FROM judged)"""
