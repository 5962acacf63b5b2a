"""Queries against their SQL on series that begin or stay at 0, and on values at ties of rounding."""

import datetime as dt
import random

import pytest

from risekit import oracle, queries
from risekit.functions import rise
from risekit.plans.fold import rounded


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    import pyarrow as pa
    import pyarrow.parquet as pq

    r, rows = random.Random(3), []
    for user in range(12):
        for i in range(40):
            value = 0.0 if user == 0 or (user < 5 and i % 40 < 4) else r.randrange(20, 4000) / 10
            rows.append((len(rows), user, dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * i, seconds=user), "error" if user % 5 == 4 and i == 20 else "view", value))
    # a first height of 40 and one of 145.98 after it: a rise of 264.95, whose double is below the tie
    rows += [(len(rows) + i, 99, dt.datetime(2024, 1, 1 + i), "view", 40.0 if i < 5 else 145.98) for i in range(12)]
    path = tmp_path_factory.mktemp("edges")
    columns = dict(zip(("event_id", "user_id", "ts", "event_type", "value"), map(list, zip(*rows))))
    pq.write_table(pa.table(columns), path / "events.parquet", coerce_timestamps="us")
    return str(path)


@pytest.mark.parametrize("name", ["rise_percent", "rise_resets", "rise_slopes", "reading_status", "sent_messages", "fit_check", "fitted_latch"])
def test_like_the_sql(compare, edges, name):
    ours, theirs = compare(queries.queries()[name], oracle.oracle_sql()[name], edges)
    assert ours == theirs


def test_ties_round_as_doubles_do(spark):
    assert rounded(264.95, 0.0, 500.0, 1) == 265.0
    from pyspark.sql import functions as F

    (r,) = spark.range(1).select(rise.rounded(F.lit(264.95), 1).alias("a"), rise.rounded(F.lit(0.285), 2).alias("b"), rise.rounded(F.lit(None).cast("double"), 1).alias("c")).collect()
    assert tuple(r) == (265.0, 0.28, None)
