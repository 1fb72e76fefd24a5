"""The text functions for SQL users: temporary SQL functions, and a table function that names the known terms of a span.

    register(spark)
    spark.sql("SELECT span, gapline_years(span), term FROM spans, LATERAL gapline_recognise(span)")

Their bodies are SQL that Catalyst puts in place of each call; no Python runs. They give what the column functions of
the same names give. A call of a SQL function cannot stand inside a lambda, so bodies are composed here as text. Null in,
null out; `gapline_recognise` gives no rows for a span that names no term, and `gapline_terms` an empty array. (Spark 4.1
plans LEFT JOIN LATERAL over an exploded row as an inner one: to keep spans without a term, use `gapline_terms`.) Both are
meant for spans: a document's words are scanned faster by `operators.lexicon.named_windows`, as a table.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gapline import constants as C
from gapline.functions import text as T
from gapline.operators import lexicon

X = "source"  # the functions' parameter
q = T.sql_text


def bound(name: str, value: str, body: str) -> str:
    """`body` with `name` worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def listed(items) -> str:
    return f"array({', '.join(map(q, items))})"


def chunks(x: str) -> str:
    return f"filter(split({x}, {q(T.SPACE + '+')}), w -> w <> '')"


def stripped(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '')"


def looked_up(x: str, table: dict[str, str]) -> str:
    entries = ", ".join(q(part) for pair in table.items() for part in pair)
    return bound("u", x, f"coalesce(try_element_at(map({entries}), u), u)")


def normalized(x: str) -> str:
    words = f"filter(split(trim(regexp_replace(lower({x}), '[^a-z0-9+#.]+', ' ')), ' '), w -> w <> '')"
    bare = f"coalesce(nullif(regexp_replace(w, {q(r'^\.+|\.+$')}, ''), ''), w)"
    one = bound("b", bare, f"if(b rlike {q(r'^[a-z0-9](\.[a-z0-9]){2,}$')}, replace(b, '.', ''), b)")
    return f"array_join(transform({words}, w -> {one}), ' ')"


def singular(x: str) -> str:
    cut = lambda n: f"substring(f, 1, char_length(f) - {n})"
    one = (
        f"CASE WHEN array_contains({listed(C.UNFOLDED)}, f) OR NOT f rlike '^[a-z]+$' OR char_length(f) <= 3 THEN f WHEN endswith(f, 'ies') THEN concat({cut(3)}, 'y') "
        f"WHEN f rlike '(sses|shes|ches|xes)$' THEN {cut(2)} WHEN endswith(f, 's') AND NOT f rlike '(ss|us)$' THEN {cut(1)} ELSE f END"
    )
    return f"array_join(transform(split({x}, ' '), f -> {one}), ' ')"


def canonical(x: str) -> str:
    return looked_up(singular(looked_up(normalized(x), C.ALIASES)), C.ALIASES_FOLDED)


def generic(x: str) -> str:
    return f"NOT {x} rlike {q(T.ALNUM)} OR array_contains({listed(C.GENERIC_TERMS)}, {x})"


def degree(x: str) -> str:
    ranks = ", ".join(f"{q(k)}, {v}" for k, v in C.DEGREE_RANKS.items())
    return f"array_max(transform(split({canonical(x)}, ' '), d -> try_element_at(map({ranks}), d)))"


def value(x: str) -> str:
    return f"try_cast(if({x} rlike {q(f'^(?:{C.THOUSANDS_PATTERN})$')}, replace({x}, ',', ''), replace({x}, ',', '.')) AS double)"


def years(x: str) -> str:
    """Numbers but ordinals are kept with their places, so that the one of the months is not taken for years."""
    group = lambda n: f"regexp_extract_all(s, {q(rf'(?s)(.*?)({C.NUMBER_PATTERN})({C.ORDINAL_SUFFIX_PATTERN})?')}, {n})"
    parts = f"transform(arrays_zip({group(1)}, {group(2)}, {group(3)}), p -> named_struct('gap', char_length(p.`0`), 'number', p.`1`, 'suffix', p.`2`))"
    ahead = "st.at + p.gap"
    kept = f"if(p.suffix = '', concat(st.found, array(named_struct('number', p.number, 'at', {ahead}))), st.found)"
    start = "named_struct('at', 1, 'found', cast(array() AS array<struct<number:string,at:int>>))"
    numbers = f"aggregate({parts}, {start}, (st, p) -> named_struct('at', {ahead} + char_length(p.number) + char_length(p.suffix), 'found', {kept}), st -> st.found)"
    month = f"named_struct('number', regexp_extract(s, {q(C.MONTH_UNIT_PATTERN)}, 1), 'at', regexp_instr(s, {q(C.MONTH_UNIT_PATTERN)}))"
    first = f"get(filter({numbers}, n -> m.number = '' OR n.at <> m.at), 0).number"
    both = f"named_struct('m', if(m.number <> '', {value('m.number')} / 12, null), 'y', {bound('n', first, value('n'))})"
    words = " ".join(rf"WHEN s rlike {q(rf'\b{w}\b')} THEN {float(n)}D" for w, n in C.NUMBER_WORDS.items())
    total = "coalesce(z.m, 0D) + coalesce(z.y, 0D)"
    stated = f"CASE WHEN z.m IS NULL AND z.y IS NULL THEN CASE {words} END WHEN {total} > 0 AND {total} <= {C.MOST_YEARS} THEN {total} END"
    none = f"s = '' OR s rlike {q(C.DATE_RANGE_PATTERN)} OR s rlike {q(C.SCHOOLING_PATTERN)} OR s rlike {q(C.NEGATIVE_PATTERN)}"
    return bound("s", stripped(f"lower({x})"), f"if({none}, null, {bound('z', bound('m', month, both), stated)})")


def hits(x: str, terms: tuple[str, ...]) -> str:
    """array<struct<i, k, term>>: at each word not yet consumed, the longest window whose canonical key is known."""
    width = max(len(t.split(" ")) for t in terms)
    window = canonical("array_join(slice(g.w, j + 1, k), ' ')")
    known = f"array_contains({listed(terms)}, h.term) AND (char_length(h.term) > 1 OR array_contains(g.single, h.term))"
    longest = f"get(filter(transform(sequence(least({width}, size(g.w) - j), 1, -1), k -> named_struct('i', j, 'k', k, 'term', {window})), h -> {known}), 0)"
    taken = bound("e", longest, "if(e IS NULL, st, named_struct('free', e.i + e.k, 'found', concat(st.found, array(e))))")
    start = "named_struct('free', 0, 'found', cast(array() AS array<struct<i:int,k:int,term:string>>))"
    scan = f"aggregate(sequence(0, size(g.w) - 1), {start}, (st, j) -> if(j < st.free, st, {taken}), st -> st.found)"
    single = "transform(filter(v, c -> c rlike '^[A-Za-z0-9]$'), c -> lower(c))"
    words = bound("v", f"filter({chunks(x)}, c -> c rlike {q(T.ALNUM)})", f"named_struct('w', v, 'single', {single})")
    return bound("g", words, f"if(size(g.w) = 0, null, {scan})")


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session."""
    terms = tuple(t for t, *_ in lexicon.known_terms(spark))
    named = f"array_sort(array_distinct(transform({hits(X, terms)}, t -> t.term)))"
    bodies = {
        "tokens": ("ARRAY<STRING>", f"regexp_extract_all({X}, {q(f'({T.TOKEN})')}, 1)"),
        "collapse": ("STRING", f"trim(regexp_replace({X}, {q(T.SPACE + '+')}, ' '))"),
        "visible": ("STRING", stripped(f"translate({X}, {q(C.INVISIBLE)}, '')")),
        "normalize": ("STRING", normalized(X)),
        "canonical": ("STRING", canonical(X)),
        "is_generic": ("BOOLEAN", generic(X)),
        "years": ("DOUBLE", years(X)),
        "degree": ("INT", degree(X)),
        "terms": ("ARRAY<STRING>", f"if({X} IS NULL, null, coalesce({named}, array()))"),
    }
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION gapline_{name}({X} STRING) RETURNS {kind} RETURN {body}")
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION gapline_recognise({X} STRING) RETURNS TABLE (i INT, k INT, term STRING) "
        f"RETURN SELECT h.i, h.k, h.term FROM (SELECT explode({hits(X, terms)}) AS h)"
    )
