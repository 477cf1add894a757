"""State is asked seldom: every call is a round trip between Python and the JVM."""
from types import SimpleNamespace

import pandas as pd

from leakscope.streaming.memory import _Alerted
from leakscope.streaming.sessions import _combined, _Sessions


class _State:
    """A value state and its timers, which count the calls."""

    def __init__(self, value=None):
        self.value, self.calls, self.timers = value, [], set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None

    def registerTimer(self, ms):  # noqa: N802
        self.calls.append("register")
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.calls.append("delete")
        self.timers.remove(ms)


def _at(ms):
    return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)


def test_a_key_with_many_slots_asks_its_state_a_few_times(spark):
    gap, state = 600_000_000, _State()
    sessions = _Sessions(["who"], gap)
    sessions.init(state)
    frame = pd.DataFrame({"who": ["a", None] * 50, "t": range(0, 100 * gap, gap)}).assign(slot=lambda f: f.t // gap)
    a, none = (r for f in _combined(["who"])(iter([frame, frame[:0]])) for r in f.to_dict("records"))
    assert a["who"] == "a" and pd.isna(none["who"]) and list(none["slot"]) == list(range(1, 100, 2))
    assert list(sessions.handleInputRows(("a",), iter([a]), _at(0))) == [] and state.calls == ["get", "update", "register"]
    assert state.timers == {2 * 600_000}
    state.calls.clear()
    out = list(sessions.handleExpiredTimer(("a",), _at(21 * 600_000), _at(2 * 600_000)))
    assert [(r.lo, r.n) for r in out] == [(s * gap, 1) for s in range(0, 20, 2)]
    assert state.calls == ["get", "update", "register"] and 22 * 600_000 in state.timers
    list(sessions.handleInputRows(("a",), iter([a]), _at(99 * 600_000 * 10)))
    assert state.value is None


def test_an_identifier_asks_its_state_a_few_times(spark):
    state = _State()
    alerted = _Alerted("at", 5000, 1000)
    alerted.init(state)

    class Found(SimpleNamespace):
        __fields__ = ("value", "_ms", "_tie")

        def __getitem__(self, name):
            return getattr(self, name)

    rows = lambda *ms: iter([Found(value=f"v{m}", _ms=m, _tie=0) for m in ms])
    assert [r.value for r in alerted.handleInputRows(("k",), rows(1000, 2000), _at(0))] == ["v1000"]
    assert state.calls == ["get", "update", "register"] and state.timers == {6000}
    state.calls.clear()
    assert list(alerted.handleInputRows(("k",), rows(3000), _at(0))) == [] and state.calls == ["get"]
    assert [r.value for r in alerted.handleInputRows(("k",), rows(7000), _at(0))] == ["v7000"] and state.timers == {12_000}
    list(alerted.handleExpiredTimer(("k",), _at(9000), _at(9000)))  # of a run with another interval
    assert state.value == (7000,)
    list(alerted.handleExpiredTimer(("k",), _at(12_000), _at(12_000)))
    assert state.value is None
