"""Early stopping over arriving validation losses, one state per run
(``applyInPandasWithState``). The state is three values per run; each call gathers the
run's rows of one micro-batch (24 bytes each) and evaluates them in step order, however
they were cut into Arrow batches. A late row, with a step before those of an earlier
micro-batch, counts in order of arrival. NULL losses are not improvements."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUT_SCHEMA = ("run long, step long, loss double, best_loss double, improved boolean, "
              "no_improve long, should_stop boolean")
STATE_SCHEMA = "best double, cnt long, stopped boolean"


def _evaluate(step: np.ndarray, loss: np.ndarray, best: float, count: int, patience: int, first_counted: int):
    """Columns for a run's rows in step order, cut after the stop, from prefix minima."""
    before = np.fmin.accumulate(np.r_[best, loss])[:-1]
    improved = loss < before
    counted = np.cumsum(~improved & (step >= first_counted))
    # the count restarts at each improvement
    since = np.maximum.accumulate(np.where(improved, counted, -count))
    no_improve = counted - since
    end = np.flatnonzero(no_improve >= patience)
    n = int(end[0]) + 1 if len(end) else len(step)
    return n, np.fmin(before, loss)[:n], improved[:n], no_improve[:n]


def _make_fn(patience: int, skip_steps: int, start_step: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state):
        best, count, stopped = state.get if state.exists else (float("inf"), 0, False)
        rows = pd.concat(list(pdfs), ignore_index=True)  # all of the run's rows in the micro-batch
        if stopped or not len(rows):
            return
        rows = rows.sort_values("step", kind="stable")
        step, loss = rows["step"].to_numpy(), rows["loss"].to_numpy()
        n, best_loss, improved, no_improve = _evaluate(step, loss, best, count, patience, skip_steps + start_step)
        state.update((float(best_loss[-1]), int(no_improve[-1]), bool(no_improve[-1] >= patience)))
        yield pd.DataFrame({"run": key[0], "step": step[:n], "loss": loss[:n], "best_loss": best_loss,
                            "improved": improved, "no_improve": no_improve, "should_stop": no_improve >= patience})

    return fn


def stream_early_stopping(losses: DataFrame, patience: int, skip_steps: int = 0, start_step: int = 0,
                          run_col: str = "run", order_col: str = "step", loss_col: str = "loss") -> DataFrame:
    """Streaming early stopping: rows ``(run, step, loss)`` in (``step`` increasing
    within a run, e.g. the training step of each validation), evaluated rows out, up
    to and including each run's stop. State per run: best loss, counter, stopped."""
    src = losses.selectExpr(f"{run_col} AS run", f"{order_col} AS step", f"CAST({loss_col} AS DOUBLE) AS loss")
    return src.groupBy("run").applyInPandasWithState(
        _make_fn(patience, skip_steps, start_step), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout)
