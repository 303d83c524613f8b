"""The open bursts of a channel as a stream's state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..schemas import MESSAGES, columns
from ..settings import Settings
from ..sources.messages import NAMES

PARTS = f"{MESSAGES}, kind string, root_us long, piece int, first_us long, unit_size long, thread_id string"

OUT = Row(*[name for name, _ in columns(PARTS)])


def in_order(row: Row) -> tuple:
    """By time, author and text, null first, as batch orders them."""
    return row.ts_us, row.user_id is not None, row.user_id or "", row.text is not None, row.text or ""


class OpenBursts(StatefulProcessor):
    """``held``: messages that no closed burst has; ``due``: when the channel's one timer goes off."""

    def __init__(self, settings: Settings):
        self.gap, self.most = settings.gap_seconds * 1_000_000, settings.max_messages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", MESSAGES)
        self.due = handle.getValueState("due", "ms long")

    def arm(self, last_us: int) -> None:
        """Sets the timer to where a burst that ends at ``last_us`` is closed, unless it goes off before that."""
        at = (last_us + self.gap) // 1000 + 1
        if self.due.exists():
            if self.due.get()[0] <= at:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        water = timerValues.getCurrentWatermarkInMs() * 1000
        new = [tuple(r[n] for n in NAMES) for r in rows if r.ts_us >= water]
        if new:
            self.held.appendList(new)
            self.arm(min(r[NAMES.index("ts_us")] for r in new))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        water = timerValues.getCurrentWatermarkInMs() * 1000
        self.due.clear()
        rows = sorted((Row(*NAMES)(*r) for r in self.held.get()), key=in_order)
        begins = [k for k, r in enumerate(rows) if not k or r.ts_us - rows[k - 1].ts_us > self.gap] + [len(rows)]
        bursts = [rows[a:b] for a, b in zip(begins, begins[1:], strict=False)]
        closed = [b for b in bursts if b[-1].ts_us + self.gap < water]
        left = [r for b in bursts[len(closed) :] for r in b]
        self.held.clear()
        if left:
            self.held.put([tuple(r) for r in left])
            self.arm(bursts[len(closed)][-1].ts_us)
        for burst in closed:
            for k in range(0, len(burst), self.most):
                piece = burst[k : k + self.most]
                first = piece[0].ts_us
                for r in piece:
                    yield OUT(*r, "burst", burst[0].ts_us, k // self.most, first, len(piece), f"{first // 1_000_000}.{first % 1_000_000:06d}")
