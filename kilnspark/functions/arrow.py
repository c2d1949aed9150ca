"""Arrow UDFs that are built when they are used, so that importing a module needs no session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    def decorate(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def column(*columns: Column) -> Column:
            return F.pandas_udf(fn, return_type)(*columns)

        return column

    return decorate


def slices(texts: pd.Series, *others: pd.Series, rows: int = 1024, characters: int = 1 << 21) -> Iterator[tuple[pd.Series, ...]]:
    """A batch in parts of so many rows and, where a row is not longer by itself, characters of all columns at most: what a UDF makes of a
    part is given back before the next one, so that a worker holds a part's results and not a batch's."""
    columns = (texts, *others)
    lengths = sum(c.str.len().fillna(0).to_numpy(np.int64) for c in columns)
    start = held = 0
    for at, n in enumerate(lengths.tolist()):
        if at > start and (at - start >= rows or held + n > characters):
            yield tuple(c.iloc[start:at] for c in columns)
            start = at
            held = 0
        held += n
    yield tuple(c.iloc[start:] for c in columns)
