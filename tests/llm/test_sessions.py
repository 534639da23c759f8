"""Sessions against a scan of each client's clicks in order, one at a time."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.llm.sessions import MINUTE, sessionise

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, end_us string"
ZERO = datetime(2024, 1, 1)


def us(t):
    return (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def brute(rows, gap=10 * MINUTE, length=40 * MINUTE, late=360 * MINUTE):
    taken, out = {}, []
    for r in rows:
        if r[0] is not None and r[1] is not None and r[3] is not None:
            taken.setdefault(r[0], r)
    for client in {r[3] for r in taken.values()}:
        mine = sorted((us(r[1]), r[0], r[2] is not None and us(r[2]) - us(r[1]) > late, r[4] == "error" and (r[5] or 0) >= 60, int((100 * (r[5] or 0) + 0.5) // 1)) for r in taken.values() if r[3] == client)
        sessions = []
        for at, key, is_late, final, cents in mine:
            if is_late:
                continue
            s = sessions[-1] if sessions else None
            why = None if s is None else "end" if s["final"] else "gap" if at - s["end"] >= gap else "length" if at - s["start"] > length else ""
            if s is not None and why:
                s["closed"] = why
            if s is None or why:
                sessions.append(s := {"start": at, "ids": [], "cents": 0, "closed": None})
            s |= {"end": at, "final": final, "cents": s["cents"] + cents}
            s["ids"].append(key)
        for k, s in enumerate(sessions):
            stop = sessions[k + 1]["start"] if k + 1 < len(sessions) else 1 << 62
            n_late = sum(x[2] and s["start"] <= x[0] < stop for x in mine)
            closed = s["closed"] or ("end" if s["final"] else "none")
            out.append((client, s["ids"][0], s["start"], s["end"], len(s["ids"]), n_late, s["cents"], closed, hashlib.sha256(",".join(map(str, s["ids"])).encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, **options):
    return sorted(map(tuple, sessionise(spark.createDataFrame(rows, SCHEMA), (F.col("value") >= 60) & (F.col("kind") == "error"), **options).collect()))


def clicks(seed, n, step, clients=3, hot=0.5):
    """Clicks at steps of so many seconds: ties, repeated and late rows, nulls."""
    r, rows, at = random.Random(seed), [], ZERO
    for k in range(n):
        at += timedelta(seconds=r.choice([0, step, step * 2, r.random() * step]))
        client = 0 if r.random() < hot else r.randrange(clients)
        arrived = r.choice([at + timedelta(seconds=1), at + timedelta(minutes=r.choice([1, 360, 361]))])
        row = (k, at if r.random() > 0.02 else None, arrived if r.random() > 0.02 else None, client if r.random() > 0.02 else None, r.choice(["view", "click", None, "error"]), r.choice([1.005, -3.335, 59.99, 60.0, None, 77.5]), "x")
        rows += [row] * r.choice([1, 1, 1, 2])
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("step", "parts", "batch"), [(60, 5, 7), (400, 3, 10_000), (5, 9, 4)])
def test_any_parts_and_batches(spark, step, parts, batch):
    rows = clicks(step, 600, step)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert got(spark, rows, parts=parts) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parts_without_a_certain_start(spark):
    # one client, no gap and no final click: only the length cuts, so each part waits for the one before
    rows = [(k, ZERO + timedelta(seconds=97 * k), None, 1, "view", None, "") for k in range(400)]
    assert got(spark, rows, parts=8) == brute(rows)
    # all clicks but the first are late: parts pass the open session on
    rows = [(k, ZERO + timedelta(seconds=k), ZERO + timedelta(days=1 + (k == 0) * -1), 1, "view", 1.0, "") for k in range(300)]
    out = got(spark, rows, parts=6)
    assert out == brute(rows) and out[0][4:6] == (1, 299)


def test_cuts_that_meet_guessed_ones(spark):
    # the guess of each part is right from the second length cut on, because clicks come in bunches
    rows = [(k, ZERO + timedelta(minutes=9 * (k // 5), seconds=k % 5), None, 1, "view", 2.0, "") for k in range(500)]
    assert got(spark, rows, parts=7) == brute(rows)


def test_bounds(spark):
    at = [0, 10 * 60, 20 * 60 - 1]
    rows = [(k, ZERO + timedelta(seconds=s), None, 5, "view", None, "") for k, s in enumerate(at)]
    assert [x[7] for x in got(spark, rows)] == ["gap", "none"]  # ten minutes are a gap, less is none
    rows = [(k, ZERO + timedelta(minutes=5 * k), None, 5, "view", None, "") for k in range(10)]
    assert [(x[4], x[7]) for x in got(spark, rows)] == [(9, "length"), (1, "none")]  # forty minutes are not too long


def test_nothing_and_nulls(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, ZERO, ZERO, 1, "view", 1.0, ""), (1, None, ZERO, 1, "view", 1.0, ""), (2, ZERO, ZERO, None, "view", 1.0, "")]) == []
    assert [x[6] for x in got(spark, [(1, ZERO, ZERO, 1, None, float("nan"), ""), (2, ZERO, ZERO, 2, None, float("inf"), "")])] == [0, 0]


def test_the_zone_of_the_session_does_not_matter(spark):
    rows = [(k, datetime(2024, 3, 31, 1, 50) + timedelta(minutes=5 * k), None, 1, "view", 1.0, "") for k in range(9)]
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
