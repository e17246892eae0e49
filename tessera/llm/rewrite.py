"""Rewriting the text column of a table in place, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8


def rewrite(docs: DataFrame, edit: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """docs with edit(a batch's texts as bytes) for its texts; None drops the row. A null text is edited as empty and stays null if nothing changes.

    All other columns pass as they are, whatever they are called; repeated rows come back as often.
    """
    at = docs.columns.index("text")

    def go(batches):
        for b in batches:
            old = b.column(at)
            values = edit(utf8(old))
            new = pa.array([None if v is None or (not v and o is None) else v for v, o in zip(values, old.to_pylist())], pa.binary()).cast(pa.string()).cast(old.type)
            cols = [new if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array([v is not None for v in values], pa.bool_()))

    return docs.mapInArrow(go, docs.schema)
