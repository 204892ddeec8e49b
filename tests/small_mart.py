"""Marts over a few hand-written rows."""

from __future__ import annotations

import uuid

from caselight import fixed_values as fv
from caselight.plans.mart import Mart
from caselight.sources.feed import TABLE_COLUMNS
from caselight.sources.star_tables import RawTables
from caselight.sources.store import ModelStore
from caselight.sources.versions import bronze_type


def frame(spark, table: str, rows: list[dict]):
    columns = [*TABLE_COLUMNS[table], *fv.METADATA_COLUMNS]
    schema = ", ".join(f"{c} {bronze_type(c)}" for c in columns)
    base = {"FILE_NAME": f"2020{table.upper()}.CSV", "IS_DOMESTIC": True}
    values = [
        tuple({**base, "FILE_LINE_NO": i, **row}.get(c) for c in columns) for i, row in enumerate(rows, 1)
    ]
    return spark.createDataFrame(values, schema)


def small_mart(spark, folder, submissions=(), vaccines=(), terms=(), buckets: int = 2) -> Mart:
    raw = RawTables(
        frame(spark, "submissions", list(submissions)),
        frame(spark, "vaccines", list(vaccines)),
        frame(spark, "terms", list(terms)),
    )
    return Mart(raw, ModelStore(spark, str(folder), uuid.uuid4().hex, buckets))
