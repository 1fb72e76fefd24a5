"""Texts from entities and gaps: mail, prompts and reports, as columns.

Entities and gaps are grouped to one row (key, items), items an array of struct(category, ord, span) in order.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline import constants as C

COMPANY = os.environ.get("GAPLINE_COMPANY", C.COMPANY)
RECRUITER = os.environ.get("GAPLINE_RECRUITER", C.RECRUITER)
ROLE = os.environ.get("GAPLINE_ROLE", C.ROLE)


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """(key, items) of gaps or spans; a document's items only."""
    items = F.array_sort(F.collect_list(F.struct("ord", "category", "span")))
    return rows.groupBy(key).agg(items.alias("items"))


def spans_of(items: Column, category: str) -> Column:
    return F.transform(F.filter(items, lambda x: x["category"] == category), lambda x: x["span"])


def or_default(col: Column | None, default: str) -> Column:
    """A blank value counts as absent."""
    return F.lit(default) if col is None else F.coalesce(F.when(col != "", col), F.lit(default))


def filled(template: str, **values: Column) -> Column:
    """The template with {name} replaced by columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def _names(company, recruiter, role) -> dict[str, Column]:
    return {"company": or_default(company, COMPANY), "recruiter": or_default(recruiter, RECRUITER), "role": or_default(role, ROLE)}


def labelled_lines(items: Column, labels: dict[str, str], mark: str) -> Column:
    """array: '<mark><label>: a, b' for each category that has items, in the order of the labels."""
    lines = [F.when(F.size(spans_of(items, c)) > 0, F.concat(F.lit(f"{mark}{label}: "), F.array_join(spans_of(items, c), ", "))) for c, label in labels.items()]
    return F.array_compact(F.array(*lines))


def feedback_mail(items: Column, company: Column | None = None, recruiter: Column | None = None, role: Column | None = None) -> Column:
    names = _names(company, recruiter, role)
    lines = labelled_lines(F.coalesce(items, F.array().cast("array<struct<ord:int,category:string,span:string>>")), C.MAIL_LABELS, "  • ")
    text = lambda key: filled(C.MAIL[key], **names)
    middle = F.when(F.size(lines) > 0, F.concat_ws("\n", text("gaps"), F.lit(""), F.array_join(lines, "\n"), F.lit(""), text("advice"))).otherwise(text("none"))
    end = [F.lit(""), text("again"), F.lit(""), F.lit("Warm regards,"), names["recruiter"], F.concat(names["company"], F.lit(" Recruiting Team"))]
    return F.concat_ws("\n", F.lit("Dear Applicant,"), F.lit(""), text("thanks"), F.lit(""), middle, *end)


def first_categories(items: Column) -> Column:
    """Categories by first appearance."""
    return F.array_distinct(F.transform(items, lambda x: x["category"]))


def gap_prompt(items: Column, company: Column | None = None, recruiter: Column | None = None, role: Column | None = None) -> Column:
    of = lambda c: F.transform(F.filter(items, lambda x: x["category"] == c), lambda x: F.concat(F.lit("- "), x["span"]))
    head = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.char_length(c))), F.lit(":"))
    blocks = F.transform(first_categories(items), lambda c: F.concat_ws("\n", head(c), F.array_join(of(c), "\n")))
    listed = F.concat_ws("\n", F.lit("Missing skills / qualifications:"), blocks)
    return F.concat(listed, F.lit("\n\n"), filled(C.GAP_PROMPT, **_names(company, recruiter, role)))


def entity_lines(items: Column) -> Column:
    lines = labelled_lines(items, C.MAIL_LABELS, "- ")
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit("- (none extracted)"))


def comparison_prompt(jd: Column, resume: Column, company: Column | None = None, recruiter: Column | None = None, role: Column | None = None) -> Column:
    names = _names(company, recruiter, role)
    a, b, c = C.COMPARISON_PROMPT
    return F.concat(filled(a, **names), entity_lines(jd), F.lit(b), entity_lines(resume), filled(c, **names))


def _blocks(items: Column) -> Column:
    block = lambda c, label: F.when(
        F.size(spans_of(items, c)) > 0, F.concat_ws("\n", F.lit(f"  {label}:"), F.array_join(F.transform(spans_of(items, c), lambda s: F.concat(F.lit("    - "), s)), "\n"))
    )
    return F.array_join(F.array_compact(F.array(*[block(c, label) for c, label in C.REPORT_LABELS.items()])), "\n")


def entities_block(title: str, items: Column) -> Column:
    body = _blocks(items)
    return F.concat_ws("\n", F.lit(f"=== {title} ==="), F.when(body != "", body).otherwise(F.lit(C.REPORT["no_entities"])))


def gaps_block(items: Column, notes: Column) -> Column:
    none = F.when(F.coalesce(F.size(notes), F.lit(0)) > 0, F.lit(C.REPORT["none_unchecked"])).otherwise(F.lit(C.REPORT["none"]))
    return F.concat_ws("\n", F.lit(C.REPORT["gaps"]), F.when(F.coalesce(F.size(items), F.lit(0)) > 0, _blocks(items)).otherwise(none))


def notes_block(notes: Column) -> Column:
    """Null without notes."""
    lines = F.array_join(F.transform(notes, lambda n: F.concat(F.lit("  - "), n)), "\n")
    return F.when(F.size(notes) > 0, F.concat_ws("\n", F.lit(C.REPORT["notes"]), lines, F.lit(C.REPORT["notes_end"])))
