"""Request limits of one user with very many requests, without gathering them."""

import random
from datetime import datetime, timedelta

from quarryline.streaming import events as ev


def test_requests_are_streamed_in_order_of_time(spark):
    rng = random.Random(6)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, None]), i, start + timedelta(seconds=rng.randrange(40_000))) for i in range(30_000)]
    want = {}
    for user in (1, 2, None):
        recent, accepted, refused = [], 0, 0
        for ts in sorted(t for u, _, t in rows if u == user):
            recent = [t for t in recent if (ts - t).total_seconds() < 60]
            if len(recent) < 3:
                recent.append(ts)
                accepted += 1
            else:
                refused += 1
        want[user] = (accepted, refused)
    got = ev.rate_limit_batch(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").repartition(5), 3, 60)
    assert {r.user_id: (r.accepted, r.refused) for r in got.collect()} == want
    assert "collect_list" not in got._jdf.queryExecution().toString()
