import datetime as dt
import random

from flowlens.operators import notifications as N
from flowlens.operators.skew import CHUNK, chunk_of

T0 = dt.datetime(2026, 1, 1)


def brute(waiting, replies, days=None):
    out = set()
    for txn, seq, at in replies:
        before = [w for w in waiting if w[0] == txn and w[1] <= seq]
        if before:
            w = max(before, key=lambda x: x[1])
            if days is None or at <= w[2] + dt.timedelta(days=days):
                out.add((txn, seq, w[1], w[3], w[4]))
    return out


def make(seed, n=900, hot=0.34):
    rnd = random.Random(seed)
    waiting, replies = [], []
    for seq in range(n):
        txn = "hot" if rnd.random() < hot else f"x{rnd.randrange(150)}"
        at = T0 + dt.timedelta(hours=seq)
        if rnd.random() < 0.4:
            waiting.append((txn, seq, at, f"f{seq}", f"t{seq}"))
        else:
            replies.append((txn, seq, at))
    return waiting, replies


def frames(spark, waiting, replies, chunk_rows):
    w = spark.createDataFrame(waiting, "transaction_id string, arrival_seq long, at timestamp, correlation_id string, task_flow_id string")
    r = spark.createDataFrame(replies, "transaction_id string, arrival_seq long, at timestamp")
    return [x.withColumn(CHUNK, chunk_of("arrival_seq", chunk_rows)) for x in (w, r)]


def test_replies_find_the_latest_registration(spark):
    for seed, chunk_rows in ((1, 10), (2, 100_000)):
        waiting, replies = make(seed)
        got = N.correlate_replies(*frames(spark, waiting, replies, chunk_rows)).collect()
        assert {tuple(r) for r in got} == brute(waiting, replies) and len(got) == len(set(got))


def test_a_horizon_drops_old_registrations(spark):
    waiting, replies = make(6)
    got = N.correlate_replies(*frames(spark, waiting, replies, 50), horizon="7 days").collect()
    want = brute(waiting, replies, days=7)
    assert {tuple(r) for r in got} == want and len(want) < len(brute(waiting, replies))


def test_no_pairs_are_formed(spark):
    plan = N.correlate_replies(*frames(spark, *make(3, 50), 10))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
