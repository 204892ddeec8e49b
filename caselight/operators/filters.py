"""One filter context -> rows of ``reports``.

A ``FilterSpec`` is plain data. ``matching_cases`` turns it into Column predicates plus
left-semi / left-anti joins; nothing is collected, and literals reach the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from itertools import zip_longest
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight import fixed_values as fv
from caselight.functions.derive import flagged, sex_label
from caselight.plans.model import posting_part

if TYPE_CHECKING:
    from caselight.plans.mart import Mart

_COMPARE = {
    "=": operator.eq, "!=": operator.ne, ">": operator.gt,
    "<": operator.lt, ">=": operator.ge, "<=": operator.le,
}


@dataclass(frozen=True)
class Adhoc:
    """One extra condition: field, operator, value."""

    field: str
    op: str = "="
    value: object = None


@dataclass(frozen=True)
class FilterSpec:
    query: str = ""
    vax_types: tuple[str, ...] = ()
    date_field: str = "VAX_DATE"
    date_from: dt.date | None = None
    date_to: dt.date | None = None
    no_vaxdate_only: bool = False
    adhoc: tuple[Adhoc, ...] = field(default_factory=tuple)
    rate: object = fv.DEFAULT_RATE

    @classmethod
    def from_request(cls, body: Mapping[str, object] | None) -> FilterSpec:
        """Normalise a loose request: unknown fields and operators drop out, as do blank
        values; a date that is no date raises ``ValueError``."""
        body = body or {}
        types = body.get("vax_types")
        legacy = body.get("vax_type")
        chosen = [*(types if isinstance(types, (list, tuple)) else []), *([legacy] if legacy else [])]
        rows = body.get("adhoc")
        return cls(
            query=str(body.get("query") or "").strip(),
            vax_types=_vax_types(chosen),
            date_field="RECVDATE" if str(body.get("date_field") or "").upper() == "RECVDATE" else "VAX_DATE",
            date_from=_date(body.get("date_from")),
            date_to=_date(body.get("date_to")),
            no_vaxdate_only=body.get("no_vaxdate_only") in (True, "true"),
            adhoc=tuple(_adhoc_rows(rows if isinstance(rows, (list, tuple)) else [])),
            rate=body.get("rate", fv.DEFAULT_RATE),
        )

    def with_rows(self, rows: Iterable[Adhoc]) -> FilterSpec:
        """Add rows, replacing every earlier row on the same fields."""
        rows = tuple(rows)
        fields = {r.field for r in rows}
        return replace(self, adhoc=tuple(a for a in self.adhoc if a.field not in fields) + rows)

    @property
    def is_active(self) -> bool:
        """Whether any condition is present, even one that holds for every case."""
        return bool(
            (self.query and self.query != "*") or self.vax_types or self.date_from or self.date_to
            or self.no_vaxdate_only or any(condition(a) is not None for a in self.adhoc)
        )


def _vax_types(values: Iterable[object]) -> tuple[str, ...]:
    texts = (str(v).strip() for v in values)
    return tuple(t for t in texts if t and t not in ("*", "All"))


def _date(value: object) -> dt.date | None:
    if value is None or value == "":
        return None
    if isinstance(value, dt.date):
        return value
    return dt.datetime.strptime(str(value).strip(), "%Y-%m-%d").date()


def _adhoc_rows(rows: Iterable[object]) -> Iterable[Adhoc]:
    for row in rows:
        if not isinstance(row, Mapping) or not isinstance(row.get("field"), str):
            continue
        if row.get("value") is None or row.get("value") == "":
            continue
        yield Adhoc(row["field"].upper(), str(row.get("op") or "="), row["value"])


def classify_field(name: object) -> str | None:
    """Kind of a filterable field, None when it is not filterable."""
    upper = str(name or "").upper()
    special = {"REACTIONS": "reaction", "SYMPTOMS": "symptom", "VAX_MANU": "manu"}
    if upper in special:
        return special[upper]
    for kind, names in (
        ("list", fv.LIST_FIELDS), ("str", fv.STRING_FIELDS),
        ("num", fv.NUMBER_FIELDS), ("bool", fv.BOOLEAN_FIELDS),
    ):
        if upper in names:
            return kind
    return None


@dataclass(frozen=True)
class Membership:
    """Cases that have (or lack) a row in a side table."""

    side: str
    value: str
    negated: bool


def condition(row: Adhoc) -> Column | Membership | None:
    """What a row asks for; None when it is not allowed and therefore ignored."""
    kind = classify_field(row.field)
    negated = row.op == "!="
    allowed = fv.SCALAR_OPS if kind in ("str", "num", "bool") else fv.MEMBER_OPS
    if kind is None or row.op not in allowed:
        return None
    if kind == "reaction":
        pair = fv.REACTIONS.get(str(row.value))
        if pair is None:
            return F.lit(negated)
        return ~F.coalesce(flagged(pair), F.lit(False)) if negated else flagged(pair)
    if kind in ("symptom", "manu"):
        return Membership(kind, str(row.value), negated)
    if kind == "list":
        held = F.array_contains(row.field, str(row.value))
        return ~held if negated else held
    return _scalar(row, kind)


def _scalar(row: Adhoc, kind: str) -> Column | None:
    compare = _COMPARE[row.op]
    if kind == "num":
        number = to_number(row.value)
        return None if math.isnan(number) else compare(F.col(row.field), _number_literal(number))
    if kind == "bool":
        return compare(F.col(row.field), F.lit(row.value in (True, "true", 1, "1")))
    # the U slice of the sex panel includes blank and missing values
    if row.field == "SEX" and str(row.value) == "U" and row.op in fv.MEMBER_OPS:
        return compare(sex_label(F.col("SEX")), F.lit("U"))
    return compare(F.col(row.field), F.lit(str(row.value)))


def to_number(value: object) -> float:
    """A request value as a number, NaN when it is none."""
    if isinstance(value, (bool, int, float)):
        return float(value)
    try:
        return float(str(value).strip())
    except ValueError:
        return math.nan


def _number_literal(number: float) -> Column:
    # an integral literal keeps comparisons on integer columns free of casts, so they push down
    whole = number.is_integer() and abs(number) < 2**31
    return F.lit(int(number)) if whole else F.lit(number)


def query_predicate(query: str) -> Column | None:
    """Digits find a case id whatever its padding; other text searches the narrative."""
    if not query or query == "*":
        return None
    if query.isascii() and query.isdigit():
        return F.col(fv.CASE_ID).try_cast("bigint") == F.lit(query).try_cast("bigint")
    # an escape character the text does not hold: % and _ stay wildcards, \ stays itself
    escape = next(c for c in map(chr, range(1, 0xFFFF)) if c not in query)
    return F.call_function("ilike", F.col("SYMPTOM_TEXT"), F.lit(f"%{query}%"), F.lit(escape))


#: Trigrams of a search that are looked up, the first of each literal part first.
MOST_GRAMS = 64


def search_grams(query: str) -> list[str]:
    """Trigrams that a narrative must hold to match, from the literal parts between wildcards of the lower-cased text."""
    parts = [[p[i : i + 3] for i in range(len(p) - 2)] for p in re.split("[%_]", query)]
    in_turn = [g for row in zip_longest(*parts) for g in row if g is not None]
    return list(dict.fromkeys(in_turn))[:MOST_GRAMS]


def buckets_to_search(mart: Mart, query: str) -> list[int] | None:
    """Buckets that hold every trigram of a narrative search; None: the search needs all of them.

    Fewer grams than all only leave more buckets to verify.
    """
    if query_predicate(query) is None or (query.isascii() and query.isdigit()) or not mart.holds("narrative_grams"):
        return None
    # lower-cased by the engine that lower-cased the narratives
    lowered = mart.spark.sql("SELECT lower(:query)", {"query": query}).first()[0]
    grams = search_grams(lowered)
    if not grams:
        return None
    postings = mart.table("narrative_grams")
    folders = F.array_distinct(F.array(*[posting_part(F.lit(g)) for g in grams]))
    folders = mart.spark.range(1).select(folders.alias("parts")).first().parts
    held = postings.filter(F.col("part").isin(folders) & F.col("GRAM").isin(grams)).groupBy("BUCKET").agg(
        F.count_distinct("GRAM").alias("n")).filter(F.col("n") == len(grams))
    return sorted(r.BUCKET for r in held.collect())  # a number for each bucket at most


def predicates(spec: FilterSpec) -> list[Column]:
    """The conditions on columns of ``reports`` itself."""
    found: list[Column] = []
    text = query_predicate(spec.query)
    if text is not None:
        found.append(text)
    if spec.vax_types:
        found.append(F.arrays_overlap("VAX_TYPES", F.array(*map(F.lit, spec.vax_types))))
    if spec.date_from:
        found.append(F.col(spec.date_field) >= F.lit(spec.date_from))
    if spec.date_to:
        found.append(F.col(spec.date_field) <= F.lit(spec.date_to))
    if spec.no_vaxdate_only:
        found.append(F.col("VAX_DATE").isNull())
    rows = map(condition, spec.adhoc)
    return found + [c for c in rows if isinstance(c, Column)]


def _members(mart: Mart, wanted: Membership) -> DataFrame:
    """Case ids that hold the wanted term (in any spelling) or manufacturer: one folder of the postings."""
    value = F.lit(wanted.value)
    if wanted.side == "manu":
        postings, label = mart.table("manu_cases"), "VAX_MANU"
    else:
        postings, label, value = mart.table("term_cases"), "TERM", F.lower(value)
    return postings.filter((F.col("part") == posting_part(value)) & (F.col(label) == value)).select(fv.CASE_ID)


def matching_cases(mart: Mart, spec: FilterSpec) -> DataFrame:
    """The rows of ``reports`` a spec selects (all conditions hold)."""
    buckets = buckets_to_search(mart, spec.query)
    cases = mart.reports if buckets is None else mart.reports_in(buckets)
    for predicate in predicates(spec):
        cases = cases.filter(predicate)
    for wanted in map(condition, spec.adhoc):
        if isinstance(wanted, Membership):
            how = "left_anti" if wanted.negated else "left_semi"
            cases = cases.join(_members(mart, wanted), fv.CASE_ID, how)
    return cases


def selected_cases(mart: Mart, spec: FilterSpec, reused: bool = False) -> DataFrame:
    """``matching_cases`` for questions that do not show narratives.

    Searching narratives reads by far the widest column, so its matches are written once
    (without narratives) and every question to the same selection starts from them. A
    selection by a side table is written too when several counts are about to reuse it.
    """
    searches_text = query_predicate(spec.query) is not None and not spec.query.isdigit()
    joins = any(isinstance(condition(row), Membership) for row in spec.adhoc)
    if not searches_text and not (reused and joins):
        return matching_cases(mart, spec)
    key = replace(spec, rate=None)
    return mart.selection(key, lambda: matching_cases(mart, spec).drop("SYMPTOM_TEXT"))
