"""Key, path and time functions against the standard library on many random cases."""

import posixpath
import random
from urllib.parse import unquote_plus

from helpers import as_dicts, at, make_readings
from voltrail.functions import keys, signals
from pyspark.sql import functions as F


def texts(pieces, n, longest, seed):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(pieces) for _ in range(rng.randint(0, longest))) for _ in range(n)})


def test_decoding_equals_the_standard_library(spark):
    cases = texts(["%", "2F", "%2F", "+", "a", "/", "%C3%A9", "%c3", "%41", "é", "zz", " ", "%%", "&="], 800, 8, 1)
    df = spark.createDataFrame([(c,) for c in cases], "k string")
    got = as_dicts(df.select("k", keys.decode_key(F.col("k")).alias("d")))
    assert {r["k"]: r["d"] for r in got} == {c: unquote_plus(c) for c in cases}


def test_basename_equals_the_standard_library(spark):
    cases = texts(["a", "/", "b.zip", ".", " "], 300, 7, 2)
    df = spark.createDataFrame([(c,) for c in cases], "k string")
    got = as_dicts(df.select("k", keys.basename(F.col("k")).alias("b")))
    assert {r["k"]: r["b"] for r in got} == {c: posixpath.basename(c) for c in cases}


def test_safe_paths_equal_normpath(spark):
    cases = texts(["..", "/", "a", ".", "/", "root", "zone", "..", "x.txt", "/../"], 1500, 9, 3)
    df = spark.createDataFrame([(c,) for c in cases], "k string")

    def expected(name):
        whole = posixpath.normpath("/root/zone/" + name.lstrip("/"))
        if whole == "/root/zone":
            return ""
        return whole[len("/root/zone/"):] if whole.startswith("/root/zone/") else None

    got = as_dicts(df.select("k", keys.safe_member_path(F.col("k"), "/root/zone").alias("p")))
    assert {r["k"]: r["p"] for r in got} == {c: expected(c) for c in cases}


def test_landing_keys(spark):
    cases = {"raw/a.zip": True, "x/raw/a.7z": True, "raw/a.txt": False, "a.zip": False, "draw/a.zip": True, "raw/zip": False}
    df = spark.createDataFrame([(c,) for c in cases], "k string")
    got = as_dicts(df.select("k", keys.is_landing_key(F.col("k")).alias("l")))
    assert {r["k"]: r["l"] for r in got} == cases


def test_hours_and_days(spark):
    df = make_readings(spark, {"ts": at(25, minutes=59, seconds=59, microseconds=999999)}, {"ts": None})
    rows = df.select(signals.hour_of().cast("string"), signals.date_of().cast("string")).collect()
    assert [tuple(r) for r in rows] == [("2024-01-02 01:00:00", "2024-01-02"), (None, None)]


def test_predicates_on_null(spark):
    df = make_readings(spark, {"charging_time_remain_minute": None, "ress_power_low_flag": None, "target_soc": None})
    row = df.select(signals.is_charging(), signals.low_power_count(), signals.is_low_battery(20)).first()
    assert tuple(row) == (None, 0, False)
