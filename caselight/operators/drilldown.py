"""Clicking a slice of a panel: the filter rows whose total equals that slice."""

from __future__ import annotations

import datetime as dt

from caselight import fixed_values as fv
from caselight.operators.filters import Adhoc, FilterSpec

# panel key -> field its labels filter on
CLICK_FIELDS = {
    "reactions": "REACTIONS",
    "symptoms": "SYMPTOMS",
    "sex": "SEX",
    "states": "STATE",
    "has_data": "HAS_DATA",
    "manufacturers": "VAX_MANU",
    "v_adminby": "V_ADMINBY",
    "v_fundby": "V_FUNDBY",
}


def drill_rows(panel: str, label: object) -> list[Adhoc]:
    if panel == "age":
        low, high = fv.AGE_BUCKETS[str(label)]
    elif panel == "age_u20":
        low, high = int(label), int(label) + 1
    else:
        return [Adhoc(CLICK_FIELDS[panel], "=", label)]
    rows = [Adhoc("AGE_YRS", ">=", low)]
    return rows if high is None else [*rows, Adhoc("AGE_YRS", "<", high)]


def drill(spec: FilterSpec, panel: str, label: object) -> FilterSpec:
    """The spec after a click; new rows replace older ones on the same field."""
    return spec.with_rows(drill_rows(panel, label))


def date_presets(today: dt.date) -> dict[str, tuple[dt.date | None, dt.date | None]]:
    """Quick date ranges, anchored at ``today``."""
    return {
        "All time": (None, None),
        "Last 12 months": (_years_before(today, 1), today),
        "Last 5 years": (_years_before(today, 5), today),
        "Since 2020": (dt.date(2020, 1, 1), today),
        "2010 – 2019": (dt.date(2010, 1, 1), dt.date(2019, 12, 31)),
    }


def _years_before(day: dt.date, years: int) -> dt.date:
    try:
        return day.replace(year=day.year - years)
    except ValueError:  # 29 February has no counterpart: the day after it
        return dt.date(day.year - years, 3, 1)
