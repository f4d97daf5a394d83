"""The fence of capture epochs: which claims of a session's writers are valid."""

from __future__ import annotations

import json
from collections.abc import Iterator


class EpochFence:
    """Claims (event, writer, expected) in order. One that expects the current epoch advances it and makes its
    writer the active one; the active writer's repeated claim is a replay; any other is stale. With a
    ``modulus`` claims tell the epoch modulo it.

    A block's map has, for each epoch that one of its claims expects, how far a session in that epoch gets
    and who is its writer then; other epochs stay. So a map is no longer than the block's distinct epochs.
    """

    ddl = "event_id bigint, epoch bigint, outcome string"

    def __init__(self, modulus: int | None = None) -> None:
        self.modulus = modulus

    def _told(self, epoch: int) -> int:
        return epoch % self.modulus if self.modulus else epoch

    def start(self) -> str:
        return json.dumps([0, None])

    def summary(self, rows: Iterator[tuple]) -> str:
        """Sessions that began in the epochs of a group stand in one epoch with one writer now."""
        standing: dict[int, dict] = {}  # told epoch now -> writer -> [(told epoch before, advances)]
        left: set[int] = set()
        for _, writer, expected in rows:
            if expected is None or expected != self._told(expected):
                continue
            moved = [(began, steps + 1) for group in standing.pop(expected, {}).values() for began, steps in group]
            if expected not in left:
                left.add(expected)
                moved.append((expected, 1))
            if moved:
                standing.setdefault(self._told(expected + 1), {}).setdefault(writer, []).extend(moved)
        return json.dumps([[began, steps, writer] for groups in standing.values() for writer, group in groups.items() for began, steps in group])

    def apply(self, map_: str, state: str) -> str:
        epoch, writer = json.loads(state)
        for began, steps, last in json.loads(map_):
            if began == self._told(epoch):
                return json.dumps([epoch + steps, last])
        return state

    def run(self, rows: Iterator[tuple], state: str) -> Iterator[tuple]:
        epoch, active = json.loads(state)
        for event, writer, expected in rows:
            outcome = "stale"
            if expected is not None and expected == self._told(epoch):
                epoch, active, outcome = epoch + 1, writer, "valid"
            elif expected is not None and epoch and self._told(expected + 1) == self._told(epoch) and writer == active:
                outcome = "replay"
            yield event, epoch, outcome
