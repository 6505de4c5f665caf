"""Models are fitted on rows that are worked out once."""

import datetime as dt

import pytest

from tidemark.operators import modeling as mo
from tidemark.plans import REGISTRY


class _Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["regressor_scores", "classifier_scores"])
def test_fits_read_rows_and_not_their_sources(spark, tmp_path, monkeypatch, name):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), i % 9, "error" if i % 3 else "view", i / 7, '{"k": %d}' % (i % 10)) for i in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))

    def fit(train, *_):
        plan = train._jdf.queryExecution().optimizedPlan().toString()
        assert "get_json_object" not in plan and "parquet" not in plan.lower()
        assert 40 < train.count() < 60
        raise _Seen

    monkeypatch.setattr(mo, "fit", fit)
    with pytest.raises(_Seen):
        REGISTRY[name](spark, str(tmp_path)).collect()
