"""Last wins across batches: the state of a stream knows how far each key has come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# A row goes through the state as one text, so that no type is changed on the way.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
          "ignoreNullFields": "false"}


def newer_only(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The rows of a stream that come after all others of their key that were seen, at most one
    per key and batch: late rows, and rows that are delivered again, give none.

    ``order`` names whole-number columns (a time in microseconds, then an arrival number)
    compared one after another; rows equal in all of them are the same row. Rows without key
    or order are left out. The state holds one such tuple per key and lives in the query's
    checkpoint, so a query started again goes on where it stopped.
    """
    names = [f"o{n}" for n in range(len(order))]
    whole = rows.filter(F.col(key).isNotNull())
    for c in order:
        whole = whole.filter(F.col(c).isNotNull())
    packed = whole.select(F.col(key).cast("string").alias("k"), *(F.col(c).cast("long").alias(n) for c, n in zip(order, names)),
                          F.to_json(F.struct(*rows.columns), _EXACT).alias("row"))

    def last(group, batches: Iterator, state: GroupState) -> Iterator:
        # called for every key, mostly with a row or two: a frame is made for a row that goes out only
        seen, newest = (tuple(state.get) if state.exists else None), None
        for batch in batches:
            best = max(zip(*(batch[c].tolist() for c in [*names, "row"])))
            at = tuple(int(n) for n in best[:-1])
            if (seen is None or at > seen) and (newest is None or at > newest[0]):
                newest = at, best[-1]
        if newest is not None:
            state.update(newest[0])
            yield pd.DataFrame({"row": [newest[1]]})

    kept = packed.groupBy("k").applyInPandasWithState(
        last, "row string", ", ".join(f"{n} long" for n in names), "append", GroupStateTimeout.NoTimeout)
    return kept.select(F.from_json("row", rows.schema, _EXACT).alias("r")).select("r.*")
