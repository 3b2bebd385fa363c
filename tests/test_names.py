from datetime import datetime, timezone

import pytest

from chronoloom.functions import names
from chronoloom.functions.frames import DAY, HOUR
from chronoloom.operators import checks, reports


def test_durations():
    assert names.microseconds("50min") == 50 * 60_000_000 and names.microseconds("365D") == 365 * DAY and names.microseconds("1 h") == HOUR
    assert [names.label_of(v) for v in (6 * HOUR, 3 * DAY, HOUR // 60)] == ["6h", "3d", "1m"] and names.bars_in("1h", "25min") == 3
    with pytest.raises(ValueError):
        names.microseconds("soon")


def test_ranges_and_folds():
    now = datetime(2024, 1, 3, tzinfo=timezone.utc)
    assert names.request_range(lookback_days=1, now=now) == {"s": 1704153600, "u": 1704240000}
    assert names.request_range("2024-01-01", now=now)["s"] == 1704067200
    with pytest.raises(ValueError):
        names.request_range()
    assert names.month_folds("2020-01-01", "2022-01-01")[:2] == [("2020-01-01", "2021-07-01", "2021-10-01"), ("2020-04-01", "2021-10-01", "2022-01-01")]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "b int, _x int, a int, ret_1 int")
    assert names.in_order(df, ["a"], ["b"]).columns == ["a", "b", "ret_1"]
    assert names.by_prefix(df, ["ret"], ["_x"]) == ["_x", "ret_1"] and names.gated(df, {"ret_": False, "a": True}).columns == ["b", "_x", "a"]
    assert checks.label_columns(df.columns) == ["ret_1"]
    with pytest.raises(ValueError):
        checks.required_columns(df, ["zz"])
    assert reports.coefficient_table(spark, {"20m": {"a": 1, "b": 2}}).count() == 2
    assert reports.at_source_clock(df, "_x", "a", [3]).count() == 0
