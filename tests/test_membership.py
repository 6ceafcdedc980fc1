"""The index of a table's keys: sketches, what a batch reads, repeated and broken batches, several writers."""

import pytest
from pyspark.sql import functions as F

from helpers import at, make_readings, plan_of, same_rows
from voltrail.operators.cleaning import add_primary_key, conform
from voltrail.operators.dedup import IDENTITY
from voltrail.session import work_path
from voltrail.sources import membership
from voltrail.sources.membership import KeyIndex, add_new_readings
from voltrail.sources.tables import DAY, append_readings, read_table


def fleet(spark, n, first=0, days=2):
    """n readings with keys of their own over some days."""
    one = make_readings(spark, {}).drop("__primary_key", "vin_id", "ts")
    rows = spark.range(first, first + n).select(
        F.concat(F.lit("V"), "id").alias("vin_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % days * 86400).alias("ts"))
    return conform(add_primary_key(rows.crossJoin(F.broadcast(one))))


def keyed(df):
    return membership.located(df.withColumn(IDENTITY, F.col("__primary_key")), 16)


def test_sketches_never_miss_and_rarely_err(spark):
    held = keyed(fleet(spark, 20_000))
    sketches = membership.sketches_of(held)
    assert membership.ask(held, sketches).where("NOT maybe").count() == 0
    wrong = membership.ask(keyed(fleet(spark, 20_000, first=50_000)), sketches).where("maybe").count()
    assert wrong < 200
    two = membership.sketches_of(held.where("bucket < 8")).unionByName(membership.sketches_of(held.where("bucket >= 4")))
    merged = membership.merge_sketches(two)
    assert merged.count() == 32 and membership.ask(held, merged).where("NOT maybe").count() == 0


def test_a_batch_reads_only_what_may_hold_its_keys(spark):
    path = work_path(spark, "table")
    assert add_new_readings(fleet(spark, 6_000), path, 0, "stream", 64).rows == 6_000
    index = KeyIndex(spark, path, "stream", 64)
    days = [19723, 19724]
    everything = index.keys(days, list(range(64)), 1)
    assert everything.count() == 6_000
    asked = membership.ask(membership.located(fleet(spark, 40, first=5_990).withColumn(IDENTITY, F.col("__primary_key")), 64), index.sketches(days, 1))
    suspected = sorted({r.bucket for r in asked.where("maybe").collect()})
    assert asked.where("maybe").count() == 10 and len(suspected) <= 10
    read = index.keys(days, suspected, 1)
    assert read.count() < 6_000 * 0.25
    plan = plan_of(read)
    assert "In(bucket" in plan and "In(day" in plan
    added = add_new_readings(fleet(spark, 40, first=5_990), path, 1, "stream", 64)
    assert (added.rows, added.before, len(added.days)) == (30, 6_000, 2)


def test_a_repeated_batch_adds_nothing(spark):
    path, rows = work_path(spark, "table"), fleet(spark, 100).unionByName(make_readings(spark, {"ts": None}, {"vin_id": None}))
    assert [add_new_readings(rows, path, 0, "stream").rows for _ in range(3)] == [102, 0, 0]
    assert add_new_readings(rows, path, 1, "stream").rows == 0
    assert read_table(spark, path).count() == 102


@pytest.mark.parametrize("broken", ["append_counted", "write"])
def test_a_batch_that_broke_off_is_made_whole(spark, monkeypatch, broken):
    """The first run ends after its index was written, or before; the second has a drop less and one more."""
    path = work_path(spark, "table")
    add_new_readings(fleet(spark, 50), path, 0, "load")

    def fail(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(*((membership, broken) if broken == "append_counted" else (KeyIndex, broken)), fail)
        with pytest.raises(RuntimeError):
            add_new_readings(fleet(spark, 80), path, 1, "load")
    assert add_new_readings(fleet(spark, 60), path, 1, "load").rows == 10
    assert add_new_readings(fleet(spark, 90), path, 2, "load").rows == 30
    assert read_table(spark, path).count() == 90


def test_appended_rows_of_a_broken_batch_stay_known(spark):
    """The first run was whole but for its end; what it appended is not delivered again until later."""
    path = work_path(spark, "table")
    assert add_new_readings(fleet(spark, 80), path, 0, "load").rows == 80
    again = add_new_readings(fleet(spark, 40, first=60), path, 0, "load")
    assert (again.rows, again.before) == (20, 80)
    assert add_new_readings(fleet(spark, 100), path, 1, "load").rows == 0


def test_several_writers_and_a_table_that_was_there_before(spark):
    path = work_path(spark, "table")
    append_readings(fleet(spark, 30), path)
    assert add_new_readings(fleet(spark, 50), path, 0, "load").rows == 20
    assert add_new_readings(fleet(spark, 70), path, 0, "stream").rows == 20
    assert add_new_readings(fleet(spark, 70), path, 1, "load").rows == 0
    assert add_new_readings(fleet(spark, 70), path, 1, "stream", 32).rows == 0
    assert same_rows(read_table(spark, path).drop(DAY), fleet(spark, 70))


def test_folded_batches_answer_alike(spark):
    path = work_path(spark, "table")
    for batch in range(4):
        add_new_readings(fleet(spark, 20, first=batch * 20), path, batch, "stream")
    index = KeyIndex(spark, path, "stream")
    assert index.compact(grace_seconds=0) == 2
    assert add_new_readings(fleet(spark, 90), path, 4, "stream").rows == 10
    assert add_new_readings(make_readings(spark, {"ts": at(-24 * 400)}), path, 5, "stream").before == 0
