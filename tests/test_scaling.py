"""Work that must not grow with events or queries: calls to a state store, texts that are shuffled."""

import re

import pandas as pd

from faultline.operators import classify
from faultline.streaming import keyed


class Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.rows, self.timers, self.writes = {}, [], 0

    def getMapState(self, name, key, value):
        return self

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.rows[key], self.writes = value, self.writes + 1

    def removeKey(self, key):
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))

    def iterator(self):
        return iter(list(self.rows.items()))

    def registerTimer(self, ms):
        self.timers.append(ms)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_seen_ids_cost_store_calls_by_hour():
    hour, store, seen = 3_600_000_000, Store(), keyed._FirstOfId()
    seen.init(store)

    def send(ids, hours, watermark=0):
        part = pd.DataFrame({"bucket": 0, "id": ids, "micros": [h * hour + 5000 for h in hours], "c0": ids})
        return pd.concat(list(seen.handleInputRows((0,), iter([part, part]), Times(watermark))))

    out = send([str(k) for k in range(300)], [1 + k % 3 for k in range(300)])
    assert sorted(out["c0"], key=int) == [str(k) for k in range(300)] and not out["late"].any()
    assert store.writes == 3 and store.timers == [2 * hour // 1000]
    assert send(["7", "300"], [2, 2])["c0"].tolist() == ["300"]
    list(seen.handleExpiredTimer((0,), Times(2 * hour // 1000), None))
    assert store.timers == [2 * hour // 1000, 3 * hour // 1000]
    # the first hour is forgotten, the others are not
    assert send(["0", "1"], [3, 3], 2 * hour // 1000)["c0"].tolist() == ["0"]
    assert send(["9"], [1], 2 * hour // 1000)["late"].tolist() == [True, True]


def test_team_texts_are_not_gathered_by_query(spark):
    scores = [(q, label, p) for q in range(6) for label, p in (("a", 0.5), ("b", 0.3 if q % 2 else 0.6), ("none", 0.1))]
    scores = spark.createDataFrame(scores, "query_id long, label string, probability double")
    teams = spark.createDataFrame([("a", "A"), ("b", None), ("b", "B")], "team string, text string")
    repos = spark.createDataFrame([("a", "r2", "y"), ("a", "r1", "x"), (None, "r", "z")], "team string, repo string, text string")
    found = classify.candidate_team_context(scores, teams, repos)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[query_id[^\n]*text", plan)
    a, b = "team a\nA\n\nrepo a / r1\nx\n\nrepo a / r2\ny", "team b\nB"
    assert dict(map(tuple, found.collect())) == {q: f"{a}\n\n{b}" if q % 2 else f"{b}\n\n{a}" for q in range(6)}
