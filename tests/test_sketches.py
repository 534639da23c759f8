"""Stored sketches against exact counts and ranks."""

import random
from datetime import datetime, timedelta

from plumbline.operators import sketches as K


def test_merged_over_days_and_groups(spark):
    r = random.Random(4)
    rows = [(datetime(2024, 1, 1) + timedelta(hours=r.randrange(240)), r.choice("ab"), r.randrange(3000), r.gauss(0, 5) if r.random() < 0.9 else None) for _ in range(9000)] + [(None, "a", 99_999, 1.0), (datetime(2024, 1, 1), "none", None, None)]
    df = spark.createDataFrame(rows, "at timestamp, g string, who long, v double")
    stored = K.sketched(df, "at", ["g"], "who", "v").cache()
    assert stored.count() == 21
    for by in (["g"], []):
        for x in K.merged(stored, by, [0.1, 0.5, 0.9]).collect():
            own = [z for z in rows if z[0] and (not by or z[1] == x.g)]
            people, values = {z[2] for z in own if z[2] is not None}, sorted(z[3] for z in own if z[3] is not None)
            assert x.n == len(own) and abs(x.people - len(people)) <= 0.04 * len(people)
            for share, q in zip([0.1, 0.5, 0.9], x.q, strict=True):
                assert (q is None) == (not values)
                if values:
                    assert abs(sum(v <= q for v in values) / len(values) - share) < 0.02
