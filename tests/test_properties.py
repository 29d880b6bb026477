"""Property tests for the gap-filled monthly counts."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plaudit.operators.metrics import monthly_counts

ROW = st.tuples(st.integers(1, 3), st.booleans(),
                st.datetimes(min_value=dt.datetime(2020, 1, 1), max_value=dt.datetime(2021, 12, 31)))


def _run(spark, rows):
    df = spark.createDataFrame(rows, "appid int, voted_up boolean, ts timestamp_ntz")
    return {(r.appid, r.month): (r.positive, r.negative) for r in monthly_counts(df).collect()}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=25))
def test_monthly_properties(spark, rows):
    out = _run(spark, rows)
    # conservation: every input row is counted once
    assert sum(p + n for p, n in out.values()) == len(rows)
    # polarity swap symmetry
    swapped = _run(spark, [(a, not v, t) for a, v, t in rows])
    assert swapped == {k: (n, p) for k, (p, n) in out.items()}
    # per-app isolation: an app's result does not depend on other apps
    app = rows[0][0]
    alone = _run(spark, [r for r in rows if r[0] == app])
    assert alone == {k: v for k, v in out.items() if k[0] == app}
