"""Where models and other services plug in: one client a Python worker, batches of rows a call.

Nothing here talks to a network. A language model, a neural embedder, a page or image reader is a factory of
clients and a function on a batch; what it fails on comes back as null, for the caller's coalesce() with
the rule-based result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import functions as F


def batched(client: Callable[[], Any], call: Callable[[Any, list], list], returns: str, retries: int = 3):
    """A column function of one column: `call(client, values)` gives a list of as many results.

    The client is made once in each task. A batch that fails is tried again up to `retries` times, then its
    rows are null.
    """

    @F.pandas_udf(returns)
    def apply(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = client()
        for column in columns:
            values, out = column.tolist(), None
            for _ in range(max(1, retries)):
                try:
                    out = call(own, values)
                    break
                except Exception:  # a service's failure of any kind degrades to the rules
                    continue
            yield pd.Series(out if out is not None else [None] * len(values), index=column.index, dtype=object)

    return apply
