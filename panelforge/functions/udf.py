"""User-defined function surface (X-U6): the public hooks for custom
per-group Python, on Arrow batches.

Everything in the library is native; these wrappers exist for users whose
per-group logic has no native form. ``apply_per_group`` hands over a whole
group as one pandas frame, for groups of bounded size (e.g. one entity-year).
``scan_per_group`` streams a group of any size in order, batch by batch, with
a state that the user's function carries along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_per_group(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
                    schema: str) -> DataFrame:
    """Run ``fn`` on each group as a pandas DataFrame (``applyInPandas``)."""
    return df.groupBy(*keys).applyInPandas(fn, schema=schema)


def scan_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, schema: str,
                   arrays: bool = False) -> DataFrame:
    """Run ``step(state, rows) -> (state, result)`` over each group in ``order``, a batch of rows at a time.

    ``rows`` is a pandas frame of consecutive rows of one group, never more than an Arrow batch; ``state`` is
    None at a group's first rows and whatever ``step`` returned after that. So memory is bounded by a batch and the
    state, however many rows a group has; the rows of one group are read by one task, as an
    order-bound recursion must. NULL keys are groups.

    With ``arrays``, ``rows`` and ``result`` are dicts of numpy arrays by column, which cost a hundredth of a frame
    where groups are small and many. The results of a batch leave together, so a column of them has one type."""
    keys = list(keys)
    marked = df.withColumn("__group", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch.pop("__group").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
            columns = {c: batch[c].to_numpy() for c in batch.columns} if arrays else {}
            results = []
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(batch)], strict=True):
                if group != marks[start]:
                    group, state = marks[start], None
                rows = {c: v[start:stop] for c, v in columns.items()} if arrays else batch.iloc[start:stop].reset_index(drop=True)
                state, result = step(state, rows)
                if result is not None and len(result):
                    if arrays:
                        results.append(result)
                    else:
                        yield result
            if results:
                yield pd.DataFrame({c: np.concatenate([r[c] for r in results]) for c in results[0]})

    return marked.mapInPandas(run, schema=schema)
