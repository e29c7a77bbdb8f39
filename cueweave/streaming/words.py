"""An extension without a batch counterpart to match: groups of words as they stream in, and stage state kept from a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Segmentation
from ..sources.state import latest

GROUP = "item_id string, start double, end double, words int, text string, closed_by string"
STATE = "start double, end double, n int, text string"


def groups(words: DataFrame, cfg: Segmentation | None = None, *, idle: str = "10 minutes") -> DataFrame:
    """Groups of a stream of (item_id, word, start, end), each given out when it closes.

    The rule is the first fold's of batch segmentation without cuts: too long, or long enough at a sentence's end or a wide gap. Words of an
    item are taken in order of start within a batch; what comes in later batches is taken to be later. The open group of an item that is
    idle for the given time is given out by the timeout.
    """
    cfg = cfg or Segmentation()
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        open_ = list(state.get) if state.exists else None

        def close(why: str) -> None:
            out.append((key[0], open_[0], open_[1], int(open_[2]), open_[3], why))

        if state.hasTimedOut:
            if open_:
                close("idle")
            state.remove()
        else:
            rows = pd.concat(list(pdfs)).sort_values("start", kind="stable")
            for word, start, end in zip(rows["word"], rows["start"], rows["end"]):
                if open_:
                    enough = open_[1] - open_[0] >= cfg.min_duration
                    why = "length" if end - open_[0] > cfg.max_duration else "sentence" if enough and open_[3][-1:] in (".", "!", "?") else "gap" if enough and start - open_[1] > cfg.max_gap_seconds else None
                    if why:
                        close(why)
                        open_ = None
                open_ = [open_[0], end, open_[2] + 1, f"{open_[3]} {word}"] if open_ else [start, end, 1, word]
            state.update((float(open_[0]), float(open_[1]), int(open_[2]), open_[3]))
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["item_id", "start", "end", "words", "text", "closed_by"])

    return words.groupBy("item_id").applyInPandasWithState(step, GROUP, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def counts(words: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Words by item and window of event time; what comes later than the watermark allows is left out."""
    return words.withWatermark(time, late).groupBy(F.window(time, window), "item_id").agg(F.count("*").alias("words")).select("item_id", F.col("window.start").alias("window_start"), "words")


def keep_state(log: DataFrame, path: str, checkpoint: str):
    """Appends a stream of stage rows to the log, a batch at a time; within a batch only the latest row of a key. A batch that is run again overwrites its own part."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
