"""Stateful processors that take rows in order, however they land.

Plain classes for ``transformWithStateInPandas``, shipped to the executors by value. Rows come in Arrow batches and
are never put together: what can't be used yet goes to a map state, in blocks of neighbouring places, and is taken
from there block by block. So memory holds a batch and a block, whatever has piled up.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor

BLOCK = 1024  # places of a block of waiting rows


class InOrder(StatefulProcessor):
    """Base: hands the rows of a key to ``take`` by ascending place (the column ``place``), each place once.

    With ``gap_free`` places count from 0 without gaps and a row waits until all before it have landed; after
    ``patience`` milliseconds the missing ones are given up. Without it each micro-batch is taken whole, in order. A
    place that isn't above the last one taken is dropped. ``forget`` milliseconds after a key's last row its state goes.
    """

    place = "ord"
    columns: list[str] = []  # of an input row, without key and place
    out: list[str] = []  # of an output row, without the key
    key_name = "key"

    def __init__(self, gap_free: bool, patience: int | None = None, forget: int | None = None):
        self.gap_free, self.patience, self.forget = gap_free, patience, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "told string", self.forget)
        self.waiting = handle.getMapState("waiting", "block long", "told string", self.forget)

    def start(self) -> dict:
        """Memory of a key before its first row."""
        raise NotImplementedError

    def take(self, memory: dict, place: int, row: list) -> tuple | None:
        """One row in its turn; changes the memory and returns an output row or nothing."""
        raise NotImplementedError

    def _remembered(self) -> dict:
        told = self.memory.get()
        return json.loads(told[0]) if told is not None else {"next": 0, "own": self.start()}

    def _rows(self, frames: Iterator[pd.DataFrame]) -> Iterator[list]:
        for frame in frames:
            places = frame[self.place].tolist()
            cells = [[None if pd.isna(v) else v for v in frame[c].tolist()] for c in self.columns]
            yield sorted(([int(p), *row] for p, row in zip(places, zip(*cells) if cells else [()] * len(places)) if not pd.isna(p)), key=lambda r: r[0])

    def _wait(self, rows: list) -> None:
        blocks: dict[int, list] = {}
        for r in rows:
            blocks.setdefault(r[0] // BLOCK, []).append(r)
        for block, own in blocks.items():
            if self.waiting.containsKey((block,)):
                own = json.loads(self.waiting.getValue((block,))[0]) + own
            self.waiting.updateValue((block,), (json.dumps(own),))

    def _run(self, memory: dict, rows: list, done: list) -> list:
        """Take rows as far as their turn has come; the others are returned."""
        for at, r in enumerate(rows):
            if r[0] < memory["next"]:
                continue
            if self.gap_free and r[0] > memory["next"]:
                return rows[at:]
            memory["next"] = r[0] + 1
            out = self.take(memory["own"], r[0], r[1:])
            if out is not None:
                done.append(out)
        return []

    def _drain(self, key: tuple, memory: dict) -> Iterator[pd.DataFrame]:
        """Waiting blocks from the first on, until a place is missing."""
        for block in sorted(k[0] for k in self.waiting.keys()):
            done: list = []
            rows = sorted(json.loads(self.waiting.getValue((block,))[0]), key=lambda r: r[0])
            left = self._run(memory, rows, done)
            if left:
                if len(left) < len(rows):
                    self.waiting.updateValue((block,), (json.dumps(left),))
            else:
                self.waiting.removeKey((block,))
            if done:
                yield self._frame(key, done)
            if left:
                return

    def _frame(self, key: tuple, done: list) -> pd.DataFrame:
        frame = pd.DataFrame(done, columns=self.out, dtype="object")
        frame.insert(0, self.key_name, key[0])
        return frame

    def _settle(self, memory: dict, timer_values) -> None:
        self.memory.update((json.dumps(memory),))
        if self.patience is None:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if any(True for _ in self.waiting.keys()):
            self.handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        memory = self._remembered()
        empty = not any(True for _ in self.waiting.keys())
        for some in self._rows(rows):
            done: list = []
            if self.gap_free and empty:  # the usual case: rows in order need no state
                some = self._run(memory, some, done)
            if done:
                yield self._frame(key, done)
            some = [r for r in some if r[0] >= memory["next"]]
            if some:
                self._wait(some)
                empty = False
        if not empty:
            yield from self._drain(key, memory)
        self._settle(memory, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        memory = self._remembered()
        blocks = sorted(k[0] for k in self.waiting.keys())
        if blocks:  # what is missing is given up
            memory["next"] = max(memory["next"], min(r[0] for r in json.loads(self.waiting.getValue((blocks[0],))[0])))
            yield from self._drain(key, memory)
        self._settle(memory, timerValues)

    def close(self) -> None:
        pass


class RunFollower(InOrder):
    """Metric rows of one run: sliding mean, best mean so far, full windows since it moved.

    Lines without a metric (null reward) only take their turn. The memory is the last ``window`` rewards and a few
    numbers, however long the run gets; of several rows of a step the first counts, later lower steps are dropped.
    """

    columns = ["step", "reward", "ppo_kl", "pg_clipfrac"]
    out = ["step", "reward", "idx", "window_avg", "best_avg", "stale_windows", "ppo_kl", "pg_clipfrac"]
    key_name = "run"

    def __init__(self, window: int, min_delta: float, digits: int, **options):
        super().__init__(**options)
        self.window, self.min_delta, self.digits = window, min_delta, digits

    def start(self) -> dict:
        return {"last": -1, "count": 0, "best": None, "stale": 0, "recent": []}

    def take(self, memory, place, row):
        step, reward, kl, clip = row
        if reward is None or step is None or step <= memory["last"]:
            return None
        memory["last"], memory["count"] = int(step), memory["count"] + 1
        memory["recent"] = (memory["recent"] + [float(reward)])[-self.window:]
        mean = None
        if memory["count"] >= self.window:
            mean = round(sum(memory["recent"]) / self.window, self.digits)
            if memory["best"] is None or mean > round(memory["best"] + self.min_delta, self.digits):
                memory["best"], memory["stale"] = mean, 0
            else:
                memory["stale"] += 1
        best = memory["best"]
        return int(step), float(reward), memory["count"] - 1, mean, best, None if best is None else memory["stale"], kl, clip


class TaskNumbers(InOrder):
    """Rows of one file: a new task number whenever the objective changes."""

    columns = ["objective"]
    out = ["ord", "objective", "task_no"]
    key_name = "file"

    def start(self) -> dict:
        return {"number": 0, "before": None}

    def take(self, memory, place, row):
        if memory["number"] == 0 or row[0] != memory["before"]:
            memory["number"], memory["before"] = memory["number"] + 1, row[0]
        return place, row[0], memory["number"]
