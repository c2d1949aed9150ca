"""SHA-256 of ordered lists of any length: the pieces stream through the hash, only its state is held."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_sha256(rows: DataFrame, key: str, order: list[str], piece: str, separator: str) -> DataFrame:
    """(key, sha256): the lowercase digest of each key's pieces, in order, joined by the separator.

    The hash is sequential by its nature, so one key's pieces pass through one task; they are sorted outside memory and only the hash's state is
    kept. Keys must not be null; a null piece adds nothing, not even a separator."""
    between = separator.encode()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch[key], batch[piece], strict=True):
                if state is not None and k == now:
                    state.update(between)
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = k, hashlib.sha256()
                state.update(text.encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(done, columns=[key, "sha256"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=[key, "sha256"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)[key]
    dealt = rows.where(f"{piece} is not null").repartition(n, key).sortWithinPartitions(key, *order)
    return dealt.select(key, piece).mapInPandas(run, f"{key} {kind}, sha256 string")
