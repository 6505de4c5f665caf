"""Rules checked by hand: names, digests, missing values and item sets."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import mining as mi
from tidemark.operators import quality as qu
from tidemark.sources import manifest as mf
from tidemark import session


def test_feature_names_by_prefix_and_exact_name():
    names = ["HR_30s", "Hrv_a", "Temp", "O2", "O2_low", "Movement", "threshold_x", "three", "temp_x", "Main_eeg_a", "Main_eeg_a_s", "Main_eeg_perm",
             "SSDeep", "SSMinsUntilWake", "Microwakings", "MicrowakingsDbg", "minsSinceX", "epochs", "Epoch"]
    pick = lambda *s, **k: qu.chosen_columns(names, s, **k)
    assert pick("physical") == ["HR_30s", "Hrv_a", "Temp", "O2", "Movement"]
    assert pick("temp") == ["Temp"] and pick("eeg") == ["Main_eeg_a"]
    assert pick("sleep_stage") == ["SSDeep", "SSMinsUntilWake"] and pick("sleep_stage_no_times") == ["SSDeep"]
    assert pick("microwakings") == ["Microwakings"] and pick("times") == ["minsSinceX", "epochs", "Epoch"]
    assert pick("literally_all") == names and pick("prefix:SS", "temp") == ["Temp", "SSDeep", "SSMinsUntilWake"]


def test_curated_keys_of_a_stage():
    keys = [k for k, _ in qu.stage_day_keys("R")]
    assert keys[0] == "night:yasa:adjusted:remSleepSecs" and "night:yasaExtended:Stability:Aggregated:REM" in keys
    assert "night:aggregated:microwakingsWithinRemPerHour" in keys and len(keys) == len(set(keys)) == 30
    assert len(qu.stage_day_keys("Sleep")) == 28 and len(set(qu.best_night_keys())) == len(qu.best_night_keys())


def test_digests_tell_fields_apart(spark):
    digest = lambda *row: mf.content_digests(spark.createDataFrame([(1, *row)], "k int, a string, b string"), ["k"], ["a", "b"]).first()["digest"]
    rows = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ("-", "c"), ("", "c"), ("1:a", "c")]
    assert len({digest(*r) for r in rows}) == len(rows)


def test_item_sets_have_any_size(spark):
    baskets = spark.createDataFrame([(i, list("abcde")) for i in range(4)] + [(9, ["a"])], "id int, items array<string>")
    sets, total = mi.frequent_itemsets(baskets, "items", 0.5)
    sizes = sets.groupBy(F.size("items").alias("n")).count().collect()
    assert {r["n"]: r["count"] for r in sizes} == {1: 5, 2: 10, 3: 10, 4: 5, 5: 1} and total == 5
    rules = mi.association_rules(sets, total)
    assert rules.count() == 10 * 2 + 10 * 6 + 5 * 14 + 30
    one = rules.filter("antecedent = array('a') AND consequent = array('b', 'c', 'd', 'e')").first()
    assert one["confidence"] == 0.8 and one["support"] == 0.8 and one["lift"] == 1.0


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(float(i) if i % 5 else nan,) for i in range(100)], "v double")
    assert qu.missing_profile(df, ["v"]).first()["missing"] == 20
    clipped = qu.clip_to_quantiles(df, ["v"]).agg(F.max("v"), F.count("v")).first()
    assert clipped[0] < 99 and clipped[1] == 80
    scaled = qu.min_max_scale(df, ["v"]).agg(F.min("v"), F.max("v"), F.count("v")).first()
    assert tuple(scaled) == (0.0, 1.0, 80)
    with pytest.raises(Exception):
        qu.require_complete(df, ["v"]).collect()


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())
