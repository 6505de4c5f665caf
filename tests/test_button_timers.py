"""Waiting presses of a device share one timer and leave together."""

from types import SimpleNamespace

import pandas as pd

from tidemark.streaming.live import _Buttons


class _State:
    def __init__(self):
        self.value, self.reads = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.reads += 1
        return self.value

    def put(self, rows):
        self.value = list(rows)

    def update(self, row):
        self.value = row

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *_):
        return _State()

    def getValueState(self, *_):
        return _State()

    def registerTimer(self, at):
        self.timers.add(at)


def test_presses_share_a_timer():
    buttons = _Buttons(within=2_000_000, reach=10)
    handle = _Handle()
    buttons.init(handle)
    rows = pd.DataFrame({"event_id": range(50), "event": "a", "us": [i * 1000 for i in range(49)] + [9_000_000]})
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(buttons.handleInputRows((7,), iter([rows]), at(0))) == []
    assert handle.timers == {2001}
    fired = SimpleNamespace(getExpiryTimeInMs=lambda: 2001)
    out = pd.concat(buttons.handleExpiredTimer((7,), at(5000), fired))
    assert list(out["event_id"]) == list(range(49))
    assert buttons.waiting.value == [(49, "a", 9_000_000)] and buttons.waiting.reads == 1
    assert handle.timers == {2001, 11_001}
    last = SimpleNamespace(getExpiryTimeInMs=lambda: 11_001)
    assert [r for f in buttons.handleExpiredTimer((7,), at(20_000), last) for r in f["event_id"]] == [49]
