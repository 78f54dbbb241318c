"""What a key's rows cost in messages to the state store."""

import pandas as pd

from weftline.streaming.claims import Claims


class State:
    def __init__(self):
        self.rows, self.messages = [], 0

    def appendValue(self, row):
        self.appendList([row])

    def appendList(self, rows):
        self.rows, self.messages = [*self.rows, *rows], self.messages + len(rows)

    def put(self, rows):
        self.rows = []
        self.appendList(rows)

    def update(self, row):
        self.rows = [row]

    def get(self):
        return iter(self.rows) if len(self.rows) != 1 or isinstance(self.rows[0][0], list) else self.rows[0]

    def exists(self):
        return bool(self.rows)

    def clear(self):
        self.rows = []


class Handle:
    def getListState(self, name, schema):
        return State()

    getValueState = getListState

    def registerTimer(self, at):
        self.at = at

    def deleteTimer(self, at):
        pass


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_batch_of_a_key_is_one_entry():
    claims = Claims(10_000, 50_000)
    claims.init(Handle())
    times = [1_000 * t for t in range(500)] * 2
    claims.handleInputRows((7,), iter([pd.DataFrame({"t": times[:300]}), pd.DataFrame({"t": times[300:]})]), Clock(0))
    assert claims.waiting.messages == 1 and claims.handle.at == 10
    assert list(claims.handleInputRows((7,), iter([pd.DataFrame({"t": [None, 900_000.0]})]), Clock(0))) == [] and claims.waiting.messages == 2
    (due,) = claims.handleExpiredTimer((7,), Clock(399), None)
    assert due[["first", "last", "n"]].values.tolist() == [[50_000 * i, 50_000 * i + 49_000, 100] for i in range(7)]
    assert claims.waiting.messages == 3  # what is left is one entry again
    (due,) = claims.handleExpiredTimer((7,), Clock(2_000), None)
    assert due[["first", "last", "n"]].values.tolist() == [[350_000, 399_000, 100], [400_000, 449_000, 100], [450_000, 499_000, 100], [900_000, 900_000, 1]]
    assert not claims.waiting.exists() and not claims.open.exists()
