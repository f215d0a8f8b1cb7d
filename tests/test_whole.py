"""Queries over all events: no event is outside of the job, and all branches occur."""

from __future__ import annotations

from pyspark.sql import functions as F

from pantryline.plans import registry

SF = "/root/testdata/sf0.001"


def test_all_events_take_part(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = registry.QUERIES["u5_source_fallback_whole"](spark, SF)
    assert got.select("page").distinct().count() == events.select("user_id", F.floor(F.dayofmonth("ts") / 2)).distinct().count()
    assert {"primary_url", "fallback_website", "combined"} <= {r["label"] for r in got.select("label").distinct().collect()}
    ranks = registry.QUERIES["u2_cascade_whole"](spark, SF).select(F.col("event_id") % 3).distinct().count()
    assert ranks == 3
    zero = registry.QUERIES["u2_cascade_whole"](spark, SF).filter("event_id % 3 = 0").count()
    assert zero == events.filter("event_id % 3 = 0").count()
    kinds = {r["change_type"] for r in registry.QUERIES["j10_snapshot_diff_whole"](spark, SF).collect()}
    assert {"new", "removed", "updated", "menu_changed"} <= kinds
