"""Ordered folds: rows of a key in order, one after another, over a state that is small.

Keys are dealt out and sorted, and a task goes through its rows as they come: it holds the state of one key at a time,
never all rows of one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def folded(rows: DataFrame, keys: list[str], order: list[str], make: Callable, schema: str, end: bool = False, before: Callable | None = None) -> DataFrame:
    """What the states give: make() is a new one for each key, its take(row) and, if ``end``, its ended() give lists of
    dicts with the columns of schema but the keys, which come first there. before: a batch of rows (a frame, keys of any number) to what the states take."""
    shape = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in parts:
            if len(pdf) == 0:
                continue
            out = []
            pdf = before(pdf) if before else pdf
            for row in pdf.itertuples(index=False):
                mine = tuple(getattr(row, k) for k in keys)
                if mine != key:
                    if end and state is not None:
                        out += [dict(zip(keys, key, strict=True)) | r for r in state.ended()]
                    key, state = mine, make()
                out += [dict(zip(keys, key, strict=True)) | r for r in state.take(row)]
            if out:
                yield table(out, shape)
        if end and state is not None and (out := [dict(zip(keys, key, strict=True)) | r for r in state.ended()]):
            yield table(out, shape)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def table(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows as a frame whose missing values are None, not NaN."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns}, columns=columns)
