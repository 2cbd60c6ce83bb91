"""Acceptance of chains over a stream: the share of set flags over each chain's last steps, whatever the batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_share(stream: DataFrame, chain: str, step: str, flag: str, width: int = 50, name: str = "rate") -> DataFrame:
    """chain, step and the share of set flags over the last `width` steps of the chain up to this one, fewer at its start.

    The state of a chain is its last width - 1 flags, so the result of rows that came in any number of batches is that of one
    window over all. Steps of a chain come in order from batch to batch; inside of a batch they are put in order. A null flag is
    not set. Null chains are one chain.
    """
    kinds = dict(stream.dtypes)
    rows = stream.select(F.col(chain), F.col(step), F.coalesce(F.col(flag).cast("boolean"), F.lit(False)).alias("flag_"))

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = list(state.get[0]) if state.exists else []
        now = pd.concat(list(parts)).sort_values(step, kind="stable")  # a batch's steps of one chain
        flags = before + now["flag_"].astype(int).tolist()
        upto = [0]
        for f in flags:
            upto.append(upto[-1] + f)
        first = len(before)
        now[name] = [(upto[k + 1] - upto[max(0, k + 1 - width)]) / min(width, k + 1) for k in range(first, len(flags))]
        state.update((flags[-(width - 1) :] if width > 1 else [],))
        yield now[[chain, step, name]]

    schema = f"`{chain}` {kinds[chain]}, `{step}` {kinds[step]}, `{name}` double"
    return rows.groupBy(chain).applyInPandasWithState(run, schema, "last array<int>", "append", GroupStateTimeout.NoTimeout)
