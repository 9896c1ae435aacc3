"""Stateful processors over grid cells: transitions between new, repeated and persistent, and alerts at most once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TRANSITIONS = "cell_lat bigint, cell_lon bigint, kind string, at_ms bigint, n bigint"
FRESH = "cell_lat bigint, cell_lon bigint, detection_id bigint, frp double, latitude double, longitude double, historical_frequency bigint"


class CellHistory(StatefulProcessor):
    """Emits a row when a cell's count passes 1, 2 and ``frequent`` + 1, and when it has been quiet for ``quiet_ms``.

    The key is a block of neighbouring cells, so that a call and a look into the state serve many of them. Rows wait in the
    state until the watermark has passed them and are then taken in the order of their times, so the
    order in which files land does not matter. What waits is one counter per cell and time, not the rows. A cell that has been
    quiet leaves the state altogether; its next detection is new again. A block has one timer, for what comes first in it.
    """

    def __init__(self, frequent: int, quiet_ms: int) -> None:
        self.frequent, self.quiet_ms = frequent, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "lat array<bigint>, lon array<bigint>, at array<bigint>, n array<bigint>")
        self.cells = handle.getValueState("cells", "lat array<bigint>, lon array<bigint>, n array<bigint>, last array<bigint>")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["cell_lat", "cell_lon", "at_ms"]
        parts = [pd.DataFrame(dict(zip([*names, "n"], self.waiting.get() or ([], [], [], []))), dtype="int64")]
        parts += [batch.groupby(names, sort=False).size().reset_index(name="n") for batch in rows]
        waiting = pd.concat(parts).groupby(names, sort=False)["n"].sum().reset_index().astype("int64")
        self._keep_waiting(waiting)
        self._wake(int(waiting["at_ms"].min()) if len(waiting) else None, sooner=True)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # everything up to the watermark at once: a timer set here for a time that has passed would wait for another batch
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self.timer.clear()
        waiting = pd.DataFrame(dict(zip(["cell_lat", "cell_lon", "at_ms", "n"], self.waiting.get() or ([], [], [], []))), dtype="int64")
        due = waiting[waiting["at_ms"] <= now].sort_values("at_ms")
        waiting = waiting[waiting["at_ms"] > now]
        held = self.cells.get() or ([], [], [], [])
        cells = {(lat, lon): (n, last) for lat, lon, n, last in zip(*held)}
        out = []
        for lat, lon, at, more in zip(*(due[c].tolist() for c in due.columns)):
            n, last = cells.get((lat, lon), (0, at))
            if n and at - last > self.quiet_ms:
                out.append((lat, lon, "expired", last + self.quiet_ms, n))
                n = 0
            for kind, least in (("new", 1), ("repeated", 2), ("persistent", self.frequent + 1)):
                if n < least <= n + more:
                    out.append((lat, lon, kind, at, least))
            cells[lat, lon] = (n + more, at)
        for (lat, lon), (n, last) in list(cells.items()):
            if now >= last + self.quiet_ms:
                out.append((lat, lon, "expired", last + self.quiet_ms, n))
                del cells[lat, lon]
        if len(due):
            self._keep_waiting(waiting)
        if cells:
            self.cells.update(([c[0] for c in cells], [c[1] for c in cells], [v[0] for v in cells.values()], [v[1] for v in cells.values()]))
        else:
            self.cells.clear()
        next_times = [last + self.quiet_ms for _, last in cells.values()] + ([int(waiting["at_ms"].min())] if len(waiting) else [])
        self._wake(min(next_times, default=None))
        if out:
            yield pd.DataFrame(out, columns=["cell_lat", "cell_lon", "kind", "at_ms", "n"])

    def _keep_waiting(self, waiting: pd.DataFrame) -> None:
        if len(waiting):
            self.waiting.update(tuple(waiting[c].tolist() for c in ("cell_lat", "cell_lon", "at_ms", "n")))
        else:
            self.waiting.clear()

    def _wake(self, at: int | None, sooner: bool = False) -> None:
        """Sets the block's timer to ``at``; with ``sooner`` only if that is earlier than the present one."""
        if at is None:
            return
        present = self.timer.get()
        if present is not None:
            if present[0] == at or (sooner and present[0] < at):
                return
            self.handle.deleteTimer(present[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class FreshDetections(StatefulProcessor):
    """Emits each detection of a cell once, with its repeats, while the cell has at most ``repeats`` of them.

    A batch counts as a whole before any of its rows is emitted. Only the ids of up to ``repeats`` + 2 detections are
    kept, enough to know that the cell is beyond the limit; a cell beyond it costs neither state nor time, however
    often it is seen again.
    """

    def __init__(self, repeats: int) -> None:
        self.limit = repeats + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ids array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.seen.get()
        known = set(state[0]) if state else set()
        fresh = []
        if len(known) <= self.limit:
            ids = set(known)
            for batch in rows:
                if len(ids) > self.limit:
                    continue  # the rest is read and left
                new = batch[~batch["detection_id"].isin(known)].drop_duplicates("detection_id")
                fresh.append(new)
                ids.update(int(i) for i in new["detection_id"].head(self.limit + 1 + len(fresh)))
            if ids != known:
                self.seen.update((sorted(ids)[:self.limit + 1],))
            if fresh and len(ids) <= self.limit:
                out = pd.concat(fresh).drop_duplicates("detection_id")
                yield out.assign(cell_lat=key[0], cell_lon=key[1], historical_frequency=len(ids) - 1)[
                    ["cell_lat", "cell_lon", "detection_id", "frp", "latitude", "longitude", "historical_frequency"]]

    def close(self) -> None:
        pass
