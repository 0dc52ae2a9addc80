"""Quotas of calls against a loop over the calls."""

import datetime as dt
import random

import pytest

from inkveil.operators import quota

SCHEMA = "call_id int, ts timestamp, seconds double, day string, k int, slot string"


def looped(rows, most, at_once, gap):
    gap, out = round(gap * 1e6), []
    days = {}
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0], max(r[2] or 0, 0))):
        at = round(r[1].replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
        used, ends, last = days.get(at // 86_400_000_000, (0, [], None))
        seen = at if last is None else max(at, last)
        reason = "quota" if used >= most else "busy" if sum(e > seen for e in ends) >= at_once else None
        if reason is None:
            last = seen if last is None else max(seen, last + gap)
            ends, used = [*ends, last + round(max(r[2] or 0, 0) * 1e6)], used + 1
        days[at // 86_400_000_000] = used, ends, last
        out.append((r[0], reason is None, reason, last if reason is None else None))
    return sorted(out + [(r[0], False, "no time", None) for r in rows if r[1] is None], key=str)


@pytest.mark.parametrize("seed,most,at_once,gap,spread", [(1, 10**6, 3, 2, 6000), (2, 60, 2, 0, 20_000), (3, 10**6, 1, 5, 900), (4, 25, 4, 0.5, 200_000), (5, 0, 1, 1, 500)])
def test_admitted(spark, seed, most, at_once, gap, spread):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 3, 1, 22, 30)
    rows = [(i, start + dt.timedelta(seconds=rnd.choice([rnd.random() * spread, rnd.randrange(spread // 100 + 1) * 100])), rnd.choice([0.0, 1.0, 30.0, rnd.random() * 90])) for i in range(300)]
    rows += [(500, None, 3.0), (501, start, None), (502, start, -4.0), (503, start, 5.0), (503, start, 5.0), (503, start, 1.0)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in quota.admitted(df, most, at_once, gap, slot=7).collect()), key=str)
    assert got == looped(rows, most, at_once, gap)
    assert {r[2] for r in got} >= ({"quota"} if most < 100 else {"busy", None})


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quota.admitted(none, 3, 1, 1).columns == ["call_id", "admitted", "reason", "start_us"]
    assert quota.admitted(none, 3, 1, 1).count() == 0
    with pytest.raises(ValueError):
        quota.admitted(none, 3, 0, 1)


def test_large_session_is_folded_by_one_task(spark):
    """No join stands below the fold's shuffle, which would be left out then, so that adaptive execution could divide a large session."""
    calls = spark.range(10).selectExpr("id AS call_id", "1L AS day", "id AS slot", "id AS at", "5L AS us", "id + 1 AS k", "1L AS session", "id AS start")
    joined = calls.hint("merge").join(calls.groupBy("day", "session").count(), ["day", "session"]).drop("count")
    folded = quota._folded(joined, 2, 0)
    assert "Join" not in folded._jdf.queryExecution().executedPlan().toString()
    assert [r["call_id"] for r in folded.filter("ok").orderBy("k").collect()] == [0, 1, 5, 6]
