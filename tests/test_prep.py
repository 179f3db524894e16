import datetime as dt

import pytest
from pyspark.sql import functions as F

from logwarden.functions import jsonflat, scalars, syslog, timestamps
from logwarden.operators import encode, missing, standardize, validate
from logwarden.plans.preprocess import Preprocessing, Step, default_steps


@pytest.mark.parametrize("text,kind", [
    ("1", "bool"), ("0", "int"), ("no", "str"), ("yes", "bool"), ("-5", "int"), ("1.5", "float"), ("1e5", "float"), ("inf", "str"),
    (" N/A ", "null"), ("false", "bool"), ("abc", "str"), ("1d", "str"), (None, "null")])
def test_cell_types(spark, text, kind):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(scalars.infer_type("s")["kind"]).first()[0] == kind


@pytest.mark.parametrize("text,iso", [
    ("2024-01-05T10:00:00Z", "2024-01-05T10:00:00.000Z"), ("2024-01-05T10:00:00.123999", "2024-01-05T10:00:00.123Z"),
    ("2024-01-05T10:00:00+02:00", "2024-01-05T08:00:00.000Z"), ("2024-01-05 10:00:00", "2024-01-05T10:00:00.000Z"),
    ("1704448800", "2024-01-05T10:00:00.000Z"), ("1704448800123", "2024-01-05T10:00:00.123Z"),
    ("10/Oct/2000:13:55:36 -0700", "2000-10-10T20:55:36.000Z"), ("Jan  7 10:00:00", "2026-01-07T10:00:00.000Z"),
    ("2024-01-05", "2024-01-05T00:00:00.000Z"), ("01/05/2024 10:00:00", "2024-01-05T10:00:00.000Z"),
    ("Fri, 5 Jan 2024 10:00:00 +0000", "2024-01-05T10:00:00.000Z"), ("junk", None), ("", None), (None, None)])
def test_timestamps(spark, text, iso):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(timestamps.iso8601(timestamps.to_utc(timestamps.parse_timestamp("s", 2026)))).first()[0] == iso


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 9, 10),), (dt.datetime(2026, 1, 10, 10),), (None,)], "ts timestamp_ntz")
    out = df.select(*timestamps.calendar_features(F.col("ts"), cyclical=False)).collect()
    assert [tuple(r) for r in out] == [(10, 4, 0, 1), (10, 5, 1, 0), (0, 0, 0, 0)]


def test_syslog_forms(spark):
    lines = ["<34>Jan  7 10:00:00 webserver nginx: 10.0.0.1 - - GET / 200", "<86>Jan  7 10:00:02 auth sshd[12345]: Failed password",
             "<13>Jan  7 10:00:03 db no tag here", '<165>1 2026-01-07T10:00:04.000Z fw.local fw - - [meta eventID="1001"] Blocked',
             "<200>1 - - fw - - - hi", "nonsense"]
    p = [r["parsed"] for r in syslog.parse_lines(spark.createDataFrame([(x,) for x in lines], "l string"), "l", 2026).collect()]
    assert (p[0]["timestamp"], p[0]["facility_name"], p[0]["severity_name"], p[0]["program"]) == ("2026-01-07T10:00:00", "auth", "crit", "nginx")
    assert (p[1]["tag"], p[1]["program"], p[1]["message"]) == ("sshd[12345]", "sshd", "Failed password")
    assert (p[2]["tag"], p[2]["message"]) == (None, "no tag here")
    assert (p[3]["format"], p[3]["version"], p[3]["sd"], p[3]["proc_id"]) == ("RFC5424", 1, {"meta.eventID": "1001"}, None)
    assert (p[4]["facility_name"], p[4]["timestamp"], p[4]["sd"]) == ("unknown(25)", "", {})
    assert p[5] is None


def test_flatten_spreads_lists_of_objects(spark):
    df = spark.createDataFrame([('{"u":{"id":1},"t":["a","b"],"i":[{"v":1.5,"q":[1,2]},{"v":2}]}',), ('{"u":{"id":2}}',)], "j string")
    flat = jsonflat.flatten_json(df, "j")
    first = flat.where("`j.u.id` = 1").first().asDict()
    assert first["j.t[1]"] == "b" and float(first["j.i[1].v"]) == 2.0 and first["j.i[0].q[1]"] == 2
    assert first["j.t"] == ["a", "b"]


def test_names_and_collisions(spark):
    assert scalars.normalize_name("a.b[0] / C-d") == "a_b_0_c_d"
    df = spark.createDataFrame([(None, "1.1.1.1", 5), ("2.2.2.2", "9.9.9.9", 6)], "`Source IP` string, ClientIP string, `x-y` int")
    out = standardize.standardize_fields(df)
    assert out.columns == ["src_ip", "x_y"]
    assert [r["src_ip"] for r in out.collect()] == ["1.1.1.1", "2.2.2.2"]
    assert standardize.standardize_fields(df, drop=["x_y"]).columns == ["src_ip"]
    assert standardize.standardize_fields(df, keep_unmapped=False).columns == ["src_ip"]


def test_validation_messages(spark):
    df = spark.createDataFrame([("t", "1.1.1.1", None, "x"), (None, "1.1.1.1", "2.2.2.2", "80")], "timestamp string, SrcIP string, dst string, dst_port string")
    bad, good = validate.validate(df, validate.NETWORK_FLOW).orderBy(F.col("timestamp").desc_nulls_last()).collect()
    assert bad["errors"] == ["Missing required field: dst_ip"] and bad["warnings"] == ["Field dst_port: expected int, got str"]
    assert good["errors"] == ["Missing required timestamp field"] and not good["valid"] and good["dst_port"] == "80"
    assert validate.schema_for_format("Syslog").name == "syslog" and validate.schema_for_format("CSV").name == "generic"


def test_missing_policy(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, " - ", None), (3, "N/A", 3.0), (4, None, float("nan"))], "id int, txt string, num double")
    policy = missing.MissingPolicy(rules=[missing.FieldRule("num", "fill_mean"), missing.FieldRule("txt", "forward_fill", required=False)], order=["id"])
    out = sorted((r["id"], r["txt"], r["num"]) for r in missing.handle_missing(df, policy).collect())
    assert out == [(1, "a", 1.0), (2, "a", 2.0), (3, "a", 3.0), (4, "a", 2.0)]
    assert missing.handle_missing(df, missing.MissingPolicy(required=["txt"])).count() == 1
    flagged = missing.flag_missing(df, "txt").collect()
    assert [r["txt_missing"] for r in flagged] == [None, True, True, True]


def test_codes_round_trip(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "f string")
    codes = encode.fit_codes(df, ["f"], max_categories=4)
    out = [r["f_encoded"] for r in encode.encode(df, codes, ["f"]).collect()]
    assert out == [2, 3, 2, 1, 0]
    back = encode.decode(encode.encode(df, codes, ["f"]).drop("f"), codes, ["f"])
    assert [r["f"] for r in back.collect()] == ["b", "a", "b", "<RARE>", "<UNKNOWN>"]


def test_preprocessing_steps_count_rows(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", "a"), ("?", "b")], "Time string, EventType string")
    run = Preprocessing(default_steps() + [Step("off", lambda d: d.limit(0), enabled=False)], observe=True)
    assert run(df).count() == 1
    assert run.stats()["field_standardizer"]["rows"] == 2
    assert run.stats()["timestamp_normalizer"]["with_time"] == 1


def test_timestamp_error_modes(spark):
    df = spark.createDataFrame([(1, "bad"), (2, ""), (3, "1704448800")], "id int, Time string")
    keep = {r["id"]: r for r in standardize.normalize_timestamps(df).collect()}
    assert keep[1]["timestamp_normalized"] is None and keep[3]["Time_raw"] == "1704448800" and keep[1]["Time_raw"] is None
    assert {r["id"] for r in standardize.normalize_timestamps(df, on_error="drop").collect()} == {2, 3}
    empty = {r["id"]: r["timestamp_normalized"] for r in standardize.normalize_timestamps(df, on_error="empty").collect()}
    assert empty == {1: "", 2: None, 3: "2024-01-05T10:00:00.000Z"}


def test_step_counters(spark):
    rows = [("2026-01-01 00:00:00", "a", None, "1", None, "x"), ("?", "b", "5", "2", "n", None), ("", "a", None, "3", None, "y"),
            ("2026-01-01 00:00:01", None, "7", "4", "n", "x"), ("2026-01-01 00:00:02", "c", "9", "5", "N/A", None)]
    df = spark.createDataFrame(rows, "Time string, EventType string, size string, id string, hint string, kind string")
    rule = missing.FieldRule
    policy = missing.MissingPolicy(required=["action"], order=["id"], rules=[
        rule("size", "fill_mean"), rule("hint", "flag_missing"), rule("kind", "forward_fill"), rule("gone", "fill_mode"), rule("note", "fill_default", "none")])
    codes = encode.fit_codes(spark.createDataFrame([("a",), ("a",), ("b",)], "action string"), ["action"], max_categories=3)
    run = Preprocessing(default_steps(policy, ["action"], codes), required=[], observe=True)
    assert run(df).count() == 4
    got = run.stats()
    counts = {s: {n: v for n, v in c.items() if n not in ("rows", "with_time")} for s, c in got.items()}
    assert counts["timestamp_normalizer"] == {"total_records": 5, "normalized": 3, "parse_errors": 1, "no_timestamp": 1}
    assert counts["field_standardizer"]["total_records"] == 5 and counts["field_standardizer"]["fields_dropped"] == 0
    # The mode of a field without values is null, so it fills nothing; the first row in order has no earlier kind only if it lacks one.
    assert counts["missing_values"] == {"total_records": 5, "dropped_records": 1, "filled_values": 2 + 2 + 4, "flagged_missing": 3, "filled_values.size": 2,
                                        "filled_values.kind": 2, "filled_values.note": 4, "flagged_missing.hint": 3}
    assert counts["categorical_encoder"] == {"total_records": 4, "fields_encoded": 4, "unknown_values": 0, "rare_values": 2}


def test_counters_of_several_partitions_add_up(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 4 > 0, F.lit("2026-01-01 00:00:00")).alias("Time"), F.col("id").cast("string").alias("action")).repartition(9)
    run = Preprocessing(default_steps(), observe=True)
    assert run(df).count() == 750
    assert run.stats()["timestamp_normalizer"]["no_timestamp"] == 250
    assert run.stats()["field_standardizer"]["rows"] == 1000
