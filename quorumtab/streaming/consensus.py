"""Incremental sampling on a stream: a chart's consensus while its samples arrive, and state that ends when it has settled."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quorumtab.functions.robust import DIGITS
from quorumtab.functions.text import bare, cell_number
from quorumtab.operators.consensus import _canonical
from quorumtab.operators.strategies import Sampling
from quorumtab.operators.tables import _grids, has_content

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "image_id string, tsv_data string, converged boolean, convergence_iteration int, num_samples long, total_input_tokens long, total_output_tokens long"
CHART = "n int, seen long, tokens_in long, tokens_out long, usable int, one string, earlier string, before string, base boolean, run int"
CELL = "row_label string, col_label string, value double"
EMPTY = (0, 0, 0, 0, 0, None, None, None, False, 0)


def _cell_lists(samples: DataFrame) -> DataFrame:
    """A row a sample: its cells as parallel arrays, and whether its text, as a consensus of one, has more than a header."""
    def cells(row: Column, i: Column) -> Column:
        head = lambda j: F.get(F.get(F.col("grid"), 0), j)
        made = F.transform(row, lambda c, j: F.when((i > 0) & (j > 0), F.struct(i.alias("row_pos"), j.alias("col_pos"), F.get(row, 0).alias("row_label"), head(j).alias("col_label"), cell_number(c).alias("value"))))
        return F.filter(made, lambda x: x.isNotNull())

    flat = _grids(samples, "tsv_data").withColumn("cells", F.coalesce(F.flatten(F.transform("grid", cells)), F.array()))
    fields = [F.col("cells")[f].alias(f) for f in ("row_pos", "col_pos", "row_label", "col_label", "value")]
    usable = F.coalesce(bare(F.col("tsv_data")) != "", F.lit(False))
    return flat.select("image_id", "sample_idx", "tsv_data", "input_tokens", "output_tokens", usable.alias("usable"), has_content(F.col("tsv_data")).alias("whole"), *fields)


class Consensus(StatefulProcessor):
    """State of a chart: its counters and texts, and a map of its samples' cells. A settled one keeps only that it has settled."""

    def __init__(self, config: Sampling, settled_ms: int | None, idle_ms: int | None) -> None:
        self.config, self.settled_ms, self.idle_ms = config, settled_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chart = handle.getValueState("chart", CHART)
        self.cells = handle.getMapState("cells", "sample_idx int, row_pos int, col_pos int", CELL)
        self.settled = handle.getValueState("settled", "k int", *([self.settled_ms] if self.settled_ms else []))

    def _text(self) -> str | None:
        """The consensus of the cells, null without any in common."""
        rows = [(*k, *v) for k, v in self.cells.iterator()]
        names = ["sample_idx", "row_pos", "col_pos", "row_label", "col_label", "value"]
        t = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
        c = self.config
        by: dict[tuple, list[float]] = {}
        for i, row, row_pos, col, col_pos in _canonical(t, None, c.row_sim, c.col_sim, c.pruning, c.prune_below) if rows else []:
            if rows[i][5] is not None and rows[i][5] == rows[i][5]:
                by.setdefault((row_pos, row), {}).setdefault((col_pos, col), []).append(rows[i][5])
        if not by:
            return None
        lines = [(row, sorted(cells.items())) for (_, row), cells in sorted(by.items())]
        told = [["X", *[col for (_, col), _ in lines[0][1]]], *[[row, *[repr(float(round(median(xs), DIGITS))) for _, xs in cells]] for row, cells in lines]]
        return "\n".join("\t".join(r) for r in told)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        late = self.settled.get() if self.settled.exists() else None
        new = pd.concat(list(rows)).sort_values("sample_idx")
        if late:
            return
        n, seen, used, made, usable, one, earlier, before, base, run = self.chart.get() if self.chart.exists() else EMPTY
        done = None
        for s in new.itertuples():
            if n >= self.config.most:
                break
            n, seen, used, made = n + 1, seen + 1, used + int(s.input_tokens), made + int(s.output_tokens)
            if s.usable:
                usable, one = usable + 1, one if usable else s.tsv_data
                for cell in zip(s.row_pos, s.col_pos, s.row_label, s.col_label, s.value):
                    self.cells.updateValue((int(s.sample_idx), int(cell[0]), int(cell[1])), (cell[2], cell[3], float(cell[4]) if cell[4] is not None else None))
            if n < self.config.initial:
                continue
            text = self._text() if usable > 1 else one
            fell = usable > 1 and text is None
            text = (earlier or one) if fell else (text or "")
            whole = len([x for x in text.strip().split("\n")]) > 1
            if not fell and text:
                earlier = text if whole else earlier
            if not text and n > self.config.initial:
                continue
            run = run + 1 if base and whole and not fell and text == before else 0
            base = base or whole
            if run >= self.config.patience:
                done = (before, n)
                break
            before = text
        image = key[0]
        if done:
            self.chart.clear()
            self.cells.clear()
            self.settled.update((done[1],))
            yield pd.DataFrame([(image, done[0], True, done[1], seen, used, made)], columns=OUT_NAMES)
            return
        self.chart.update((n, seen, used, made, usable, one, earlier, before, base, run))
        if self.idle_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        short = before if n >= self.config.initial else (one or "") if usable < 2 else self._text() or one
        yield pd.DataFrame([(image, short or "", False, None, seen, used, made)], columns=OUT_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        """A chart without new samples for idle_ms: its last row was its result, and its state goes."""
        self.chart.clear()
        self.cells.clear()
        yield pd.DataFrame([], columns=OUT_NAMES)

    def close(self) -> None:
        pass


OUT_NAMES = [f.split()[0] for f in OUT.split(", ")]


def incremental(samples: DataFrame, config: Sampling = Sampling(), settled_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """strategies.incremental() with exact match on a stream (image_id string, sample_idx, tsv_data, tokens): a row for each chart and batch.

    A chart's last row is its result. Once it has settled its state is one number, and late samples give no rows; with
    settled_ms the number goes too after that time, and later samples begin the chart anew. With idle_ms the state of a chart
    that gets no sample for that time goes. Either makes Spark run batches without data, so that such a stream ends by being
    stopped only. Samples count in the order of their batches, within one by sample_idx. The session's state store must be
    RocksDB (PROVIDER).
    """
    rows = _cell_lists(samples.select(F.col("image_id").cast("string").alias("image_id"), "sample_idx", "tsv_data", "input_tokens", "output_tokens"))
    return rows.groupBy("image_id").transformWithStateInPandas(Consensus(config, settled_ms, idle_ms), OUT, "Update", "ProcessingTime" if settled_ms or idle_ms else "None")
