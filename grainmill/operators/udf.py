"""Functions of the caller's over chunks of rows, Arrow batch by Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from grainmill.functions.core import as_list, named


def df_parallelize_process(data: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], threads: int = 16, schema: str | None = None, order_by: str | Sequence[str] = ()) -> DataFrame:
    """func over pieces of data, in `threads` partitions; its result has data's schema unless another is given.

    With order_by, partitions are contiguous ranges of that order. A piece is an Arrow batch, so memory stays bounded.
    """
    order = [named(c) for c in as_list(order_by)]
    dealt = data.repartitionByRange(threads, *order).sortWithinPartitions(*order) if order else data.repartition(threads)

    def run(pieces):
        for piece in pieces:
            yield func(piece)

    return dealt.mapInPandas(run, schema or data.schema)
