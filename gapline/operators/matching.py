"""Gaps between postings and candidates, for many pairs at once, and notes on what could not be compared.

Spans are rows (doc_key, category, ord, span); ord orders a document's spans. Pairs are rows (pair_id, jd_key,
resume_key). Gaps are rows (pair_id, category, ord, span) with the posting's own words. A document or span
that is null has no terms; pairs without spans on either side have no gaps.

Each document is reduced once to a row; pairs are joined once a side, and what is missing is a difference of arrays
within the pair's row. A key that very many pairs share is split by a salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline import constants as C
from gapline.functions import text as T
from gapline.functions.years import degree_level, parse_years
from gapline.operators.lexicon import recognised_in, span_terms
from gapline.session import materialize



SKILL, DEGREE, EXPERIENCE = "skill", "degree", "experience"
ITEMS = "array<struct<category:string,ord:int,span:string>>"
#: Keys with this many pairs or more, and a thousandth of all at least, are split: there are at most 2000 of them.
POPULAR, SHARE, MOST_SALTS = 10_000, 1000, 256


def of(spans: DataFrame, *categories: str) -> DataFrame:
    return spans.filter(F.col("category").isin(*categories))


def highest_degree(resume: DataFrame) -> DataFrame:
    """(doc_key, held): the highest rank among a document's qualifications; null if none has one."""
    return of(resume, "qualification").groupBy("doc_key").agg(F.max(degree_level(F.col("span"))).alias("held"))


def profiles(spans: DataFrame, terms: DataFrame | None) -> DataFrame:
    """A row a document (doc_key, items): each span with its terms, degree rank, years and whether it is boilerplate, by
    ord. What depends on a span and its category alone is worked out once for each distinct pair of them. terms: what
    `recognised` gives; None if no rule asks for terms."""
    none = F.array().cast("array<string>")
    kinds = spans.select("category", "span").distinct()
    rows = kinds.withColumns({"terms": none, "best": F.lit(None).cast("string")}) if terms is None else span_terms(kinds, terms)
    degree, years = F.col("category") == "qualification", F.col("category") == "yearofexperience"
    facts = {
        "level": F.when(degree, degree_level(F.col("span"))),
        "years": F.when(years, parse_years(F.col("span"))),
        "generic": F.when((degree & F.col("level").isNull()) | (F.size("terms") == 0), T.is_generic(T.canonical(F.col("span")))),
    }
    item = F.struct(F.col("ord").cast("int").alias("ord"), "category", "span", "terms", "best", "level", "years", "generic")
    for name, fact in facts.items():
        rows = rows.withColumn(name, fact)
    known = rows.select(F.col("category").alias("__category"), F.col("span").alias("__span"), "terms", "best", *facts)
    same = F.col("category").eqNullSafe(F.col("__category")) & F.col("span").eqNullSafe(F.col("__span"))
    told = spans.join(known, same, "left").select("doc_key", item.alias("item"))
    return told.groupBy("doc_key").agg(F.sort_array(F.collect_list("item")).alias("items"))  # of one document


def _first_of(items: str, *keys: str) -> str:
    """SQL: of a sorted array the first item of each run of equal keys."""
    changes = " OR ".join(f"a[i - 1].{k} <> x.{k}" for k in keys)
    return f"get(transform(array({items}), a -> filter(a, (x, i) -> i = 0 OR {changes})), 0)"


_SKILLS = f"category IN ({', '.join(map(T.sql_text, C.SKILL_CATEGORIES))})"
_PLAIN = "named_struct('category', x.category, 'ord', x.ord, 'span', x.span)"


def asked(items: str = "items") -> dict[str, Column]:
    """What a posting asks for. skills: of each category and term the first item that names it; degrees: of each rank the
    first; durations: all that state years."""
    named = f"flatten(transform(filter({items}, x -> x.{_SKILLS}), x -> transform(x.terms, t -> named_struct('category', x.category, 'term', t, 'ord', x.ord, 'span', x.span))))"
    ranked = f"transform(filter({items}, x -> x.category = 'qualification' AND x.level IS NOT NULL), x -> named_struct('level', x.level, 'ord', x.ord, 'span', x.span, 'category', x.category))"
    return {
        "skills": F.expr(_first_of(f"array_sort({named})", "category", "term")),
        "degrees": F.expr(_first_of(f"array_sort({ranked})", "level")),
        "spans_of_years": F.expr(f"transform(filter({items}, x -> x.category = 'yearofexperience' AND x.years IS NOT NULL), x -> named_struct('category', x.category, 'ord', x.ord, 'span', x.span, 'years', x.years))"),
    }


def held(items: str = "items") -> dict[str, Column]:
    """What a candidate has: terms of whichever category, the highest rank, the longest duration."""
    return {
        "held_terms": F.expr(f"array_sort(array_distinct(flatten(transform({items}, x -> x.terms))))"),
        "held_level": F.expr(f"array_max(transform(filter({items}, x -> x.category = 'qualification'), x -> x.level))"),
        "held_years": F.expr(f"array_max(transform(filter({items}, x -> x.category = 'yearofexperience'), x -> x.years))"),
    }


def gap_items(kinds: tuple[str, ...]) -> Column:
    """The gaps of one pair, from both sides' columns: an array of (category, ord, span)."""
    parts = {
        SKILL: f"array_distinct(transform(filter(skills, x -> NOT array_contains(coalesce(held_terms, array()), x.term)), x -> {_PLAIN}))",
        DEGREE: f"transform(filter(degrees, x -> x.level > held_level), x -> {_PLAIN})",
        EXPERIENCE: f"transform(filter(spans_of_years, x -> x.years > held_years), x -> {_PLAIN})",
    }
    return F.expr(f"concat({', '.join(f'cast({parts[k]} AS {ITEMS})' for k in kinds)})")


def in_order(items: Column) -> Column:
    """Gaps as (ord, category, span), sorted."""
    return F.sort_array(F.transform(items, lambda x: F.struct(x["ord"].alias("ord"), x["category"].alias("category"), x["span"].alias("span"))))


def popular_keys(pairs: DataFrame) -> DataFrame:
    """(side, key, salts): the keys that very many pairs share; a stored table, as both sides of both joins read it."""
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("string").alias("key")) for c in ("jd_key", "resume_key")]))
    counts = pairs.select(sides.alias("s")).groupBy("s.side", "s.key").agg(F.count("*").alias("n"))
    total = pairs.agg(F.count("*").alias("total"))
    often = counts.filter(F.col("n") >= POPULAR).join(F.broadcast(total), F.col("n") * SHARE >= F.col("total"))  # one row
    return materialize(often.select("side", "key", F.least(F.lit(MOST_SALTS), F.ceil(F.col("n") / POPULAR)).cast("int").alias("salts")), "popular-keys")


def with_side(pairs: DataFrame, side: DataFrame, key: str, popular: DataFrame) -> DataFrame:
    """Pairs with a side's columns, null where the side has no such document. A popular key's pairs are dealt by a salt,
    and its document goes to each of them."""
    split = F.broadcast(popular.filter(F.col("side") == key).select(F.col("key").alias("__key"), "salts"))
    names = [c for c in side.columns if c != "doc_key"]
    same = F.col(key).cast("string") == F.col("__key")
    salted = pairs.join(split, same, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64("pair_id"), F.col("salts")), F.lit(0))).select(*pairs.columns, "__salt")
    copies = side.withColumnRenamed("doc_key", key).join(split, same, "left")
    copies = copies.select(key, *names, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("__salt"))
    return salted.join(copies, [key, "__salt"], "left").select(*pairs.columns, *names)


def gaps_of(pairs: DataFrame, jd: DataFrame, resume: DataFrame, kinds: tuple[str, ...], terms: DataFrame | None = None) -> DataFrame:
    """Gaps of some kinds in one pass: each document is a row, and pairs are joined once a side."""
    if SKILL in kinds:
        terms = recognised_in(jd, resume) if terms is None else terms
    else:
        terms = None
    popular = popular_keys(pairs)
    left = profiles(jd, terms).select("doc_key", *[v.alias(k) for k, v in asked().items()])
    right = profiles(resume, terms).select("doc_key", *[v.alias(k) for k, v in held().items()])
    both = with_side(with_side(pairs.select("pair_id", "jd_key", "resume_key"), left, "jd_key", popular), right, "resume_key", popular)
    return both.select("pair_id", F.inline(gap_items(kinds)))


def skill_gaps(pairs: DataFrame, jd: DataFrame, resume: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """An item of a skill category is a gap if it is the first in its category to name a term that the candidate
    never names."""
    return gaps_of(pairs, jd, resume, (SKILL,), terms)


def degree_gaps(pairs: DataFrame, jd: DataFrame, resume: DataFrame) -> DataFrame:
    """Of each rank above the candidate's highest one, the first item that asks for it."""
    return gaps_of(pairs, jd, resume, (DEGREE,))


def experience_gaps(pairs: DataFrame, jd: DataFrame, resume: DataFrame) -> DataFrame:
    """All durations above the longest one that the candidate states; none if either side states none."""
    return gaps_of(pairs, jd, resume, (EXPERIENCE,))


def find_missing(pairs: DataFrame, jd: DataFrame, resume: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """All gaps. Categories outside the label scheme and job titles are left out."""
    return gaps_of(pairs, jd, resume, (SKILL, DEGREE, EXPERIENCE), terms)


def unknown_categories(spans: DataFrame) -> DataFrame:
    """(category, n): spans that no rule compares, to be reported."""
    return spans.filter(~F.col("category").isin(*C.CATEGORIES)).groupBy("category").agg(F.count("*").alias("n"))


def note(parts: tuple[str, str], spans: Column) -> Column:
    """spans: as `noted` lists them."""
    return F.concat(F.lit(parts[0]), spans, F.lit(parts[1]))


def noted(items: str = "items") -> dict[str, Column]:
    """The lists that a document's notes name, by ord, as they are written there; null if there is none."""
    spans = lambda test: F.expr(f"transform(filter({items}, x -> {test}), x -> x.span)")
    listed = lambda test: T.bind(spans(test), lambda found: F.when(F.size(found) > 0, T.quote_spans(found)))
    return {
        "unverified": listed(f"x.{_SKILLS} AND size(x.terms) = 0 AND NOT x.generic"),
        "unrankable": listed("x.category = 'qualification' AND x.level IS NULL AND NOT x.generic"),
        "ranked": listed("x.category = 'qualification' AND x.level IS NOT NULL"),
        "durations": listed("x.category = 'yearofexperience'"),
        "n_years": F.expr(f"size(filter({items}, x -> x.years IS NOT NULL))"),
    }


def notes_of_pair() -> Column:
    """A pair's notes from both sides' columns j_* and r_*."""
    some = lambda c: F.col(c).isNotNull()
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    experience = (
        F.when(~some("j_durations"), F.lit(None))
        .when(number("j_n_years") == 0, note(C.NOTE_JD_YEARS, F.col("j_durations")))
        .when(number("r_n_years") > 0, F.lit(None))
        .when(some("r_durations"), note(C.NOTE_RESUME_YEARS, F.col("r_durations")))
        .otherwise(note(C.NOTE_NO_YEARS, F.col("j_durations")))
    )
    notes = F.array(
        F.when(some("j_unverified"), note(C.NOTE_UNVERIFIED, F.col("j_unverified"))),
        F.when(some("j_unrankable"), note(C.NOTE_UNRANKABLE, F.col("j_unrankable"))),
        F.when(some("j_ranked") & ~some("r_ranked"), note(C.NOTE_NO_DEGREE, F.col("j_ranked"))),
        experience,
    )
    return F.array_compact(notes)


def n_terms() -> Column:
    """The number of recognised terms among a document's `items`, as the gate counts them."""
    compared = ", ".join(map(T.sql_text, C.COMPARABLE))
    return F.expr(f"size(array_distinct(transform(filter(items, x -> x.category IN ({compared}) AND x.best IS NOT NULL), x -> x.best)))")


def asking() -> list[Column]:
    """What a posting's row has, of its `items`: what it asks for and the lists of its notes (j_*)."""
    return [v.alias(k) for k, v in (asked() | {f"j_{k}": v for k, v in noted().items()}).items()]


def having() -> list[Column]:
    """The same of a candidate's row: what it has and the lists of its notes (r_*)."""
    return [v.alias(k) for k, v in (held() | {f"r_{k}": v for k, v in noted().items()}).items()]


def sides(jd: DataFrame, resume: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row a document of either side with all that gaps, notes and the gate need: what it asks for or has, the lists of
    its notes (j_*, r_*) and its recognised terms (n_terms)."""
    left, right = profiles(jd, terms), profiles(resume, terms)
    return left.select("doc_key", *asking(), n_terms().alias("n_terms")), right.select("doc_key", *having(), n_terms().alias("n_terms"))


def find_notes(pairs: DataFrame, jd: DataFrame, resume: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(pair_id, notes): what the comparison left out, in a fixed order; an empty array if nothing."""
    left, right = sides(jd, resume, recognised_in(jd, resume) if terms is None else terms)
    popular = popular_keys(pairs)
    both = with_side(with_side(pairs.select("pair_id", "jd_key", "resume_key"), left.drop("n_terms"), "jd_key", popular), right.drop("n_terms"), "resume_key", popular)
    return both.select("pair_id", notes_of_pair().alias("notes"))


def stale_results(results: DataFrame, documents: DataFrame) -> DataFrame:
    """Results (pair_id, fingerprint) with is_stale: the texts (pair_id, jd_text, resume_text) have changed or gone."""
    now = documents.select("pair_id", T.fingerprint(F.col("jd_text"), F.col("resume_text")).alias("current"))
    joined = results.join(now, "pair_id", "left")
    return joined.withColumn("is_stale", ~F.col("fingerprint").eqNullSafe(F.col("current"))).drop("current")
