"""Convergence while samples arrive: a stream of samples, with state per chart that ends when the chart has settled."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "image_id string, prefix_k int, run int, converged boolean"
STATE = "n int, last string, run int, settled boolean"


def converging(samples: DataFrame, patience: int = 1) -> DataFrame:
    """A row for each new sample of a stream (image_id string, sample_idx, tsv_data): prefix_k, run, converged.

    run counts equal texts in a row, after the first; blank texts are skipped. Once a chart has converged its state keeps
    no text, and later samples of it give no rows. Within a batch samples count in order of sample_idx.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, run, settled = state.get if state.exists else (0, None, 0, False)
        new, out = pd.concat(list(frames)), []
        for text in new.sort_values("sample_idx")["tsv_data"]:
            if settled:
                break
            n += 1
            if text is None or not text.strip():
                continue
            run = run + 1 if text == last else 0
            last, settled = text, run >= patience
            out.append((key[0], n, run, settled))
        state.update((n, None if settled else last, run, settled))
        yield pd.DataFrame(out, columns=["image_id", "prefix_k", "run", "converged"])

    return samples.select("image_id", "sample_idx", "tsv_data").groupBy("image_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
