"""What a live session asks of its state: results are those of a plain model, however few turns are read at once, and calls do not grow with the
square of a session."""

import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from lectern.streaming import turns as streams

TURN = Row("session_id", "turn", "intent", "inline_mode", "inline_topic", "letter", "blank", "retry", "is_failed", "message")


class States:
    """Value, map and timers of one session in memory; ``calls`` counts calls and the entries that are listed."""

    def __init__(self, session):
        self.value, self.map, self.timers, self.calls, self.now, self.session = None, {}, [], 0, 0, session
        session.init(SimpleNamespace(getValueState=lambda *_: self, getMapState=lambda *_: self.Map(self), registerTimer=self.timers.append))

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    class Map:
        def __init__(self, of):
            self.of = of

        def _called(self, n=1):
            self.of.calls += n
            return self.of.map

        def containsKey(self, key):
            return key in self._called()

        def getValue(self, key):
            return self._called()[key]

        def updateValue(self, key, value):
            assert len(value) == len(streams._TURN)
            self._called()[key] = value

        def removeKey(self, key):
            del self._called()[key]

        def clear(self):
            self._called().clear()

        def keys(self):
            return list(self._called(1 + len(self.of.map)))

        def iterator(self):
            return list(self._called(1 + len(self.of.map)).items())

    def deliver(self, turns, now):
        """Rows of a micro-batch and the timers that are due with it; the turns that come out, and whether as late ones."""
        time = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
        out = list(self.session.handleInputRows(("s",), iter([TURN("s", t, "content", None, None, False, False, False, False, f"m{t}") for t in turns]), time))
        due, self.timers[:] = [t for t in self.timers if t <= now], [t for t in self.timers if t > now]
        for _ in due:
            out += self.session.handleExpiredTimer(("s",), time, None)
        return [(r.turn, r.late) for r in out]


class Model:
    """The same, plainly."""

    def __init__(self, wait_ms):
        self.wait_ms, self.last, self.waiting, self.missing = wait_ms, -1, {}, set()

    def deliver(self, turns, now):
        out = []

        def advance():
            while self.last + 1 in self.waiting:
                self.last += 1
                del self.waiting[self.last]
                out.append((self.last, False))

        for t in turns:
            if t is None or t < 0 or t in self.missing:
                self.missing.discard(t)
                out.append((t, True))
            elif t > self.last:
                self.waiting.setdefault(t, now + self.wait_ms)
                advance()
        while self.waiting and self.waiting[min(self.waiting)] <= now:
            self.missing |= set(range(self.last + 1, min(self.waiting)))
            self.last = min(self.waiting) - 1
            advance()
        return out


@pytest.mark.parametrize("at_once", [0, 3, 1000])
@pytest.mark.parametrize("wait_ms", [0, 25, 10_000])
def test_any_delivery_gives_what_a_plain_model_gives(monkeypatch, at_once, wait_ms):
    monkeypatch.setattr(streams, "AT_ONCE", at_once)
    monkeypatch.setattr(streams, "SORTED_AT_ONCE", 4)
    for seed in range(30):
        rng = random.Random(seed)
        real, model = States(streams.LiveSession(wait_ms)), Model(wait_ms)
        turns = [*rng.choices(range(40), k=70), None, -1]
        rng.shuffle(turns)
        for step in range(8):
            got, want = (x.deliver(turns[step::8], 10 * step) for x in (real, model))
            assert sorted(got, key=str) == sorted(want, key=str)
            assert [t for t, late in got if not late] == sorted(t for t, late in want if not late)
            assert {k[0] for k in real.map} == set(model.waiting) and real.value[-2] == len(model.waiting)


@pytest.mark.parametrize("wait_ms", [0, 5])
@pytest.mark.parametrize("n", [900, 6000])
def test_gaps_do_not_list_the_waiting_turns_again(wait_ms, n):
    states = States(streams.LiveSession(wait_ms))
    there = [t for t in range(n) if t % 3 != 1]
    first = states.deliver(there, 0) + states.deliver([0], 10)
    assert [t for t, _ in first] == there
    assert sorted(states.deliver([t for t in range(n) if t % 3 == 1], 20)) == [(t, True) for t in range(n) if t % 3 == 1 and t < there[-1]]
    assert states.calls <= 6 * n


def test_a_session_that_comes_in_one_micro_batch_stores_no_turn():
    states = States(streams.LiveSession())
    turns = list(range(500))
    random.Random(1).shuffle(turns)
    assert [t for t, _ in states.deliver(turns, 0)] == list(range(500))
    assert states.calls == 0 and not states.timers
