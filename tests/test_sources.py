import logs

from conftest import epoch
from tidemark.sources import text

ORDERS = logs.order_rows(seed=5, n=20)


def test_crlf_and_types(spark, tmp_path):
    df = text.read_events(spark, logs.write_csv(tmp_path / "order.csv", ORDERS), "order")
    got = [(r.order_id, r.event_type, r.tx_id, epoch(r.ts)) for r in df.orderBy("seq").collect()]
    assert got == [r[:4] for r in ORDERS]
    assert dict(df.dtypes)["ts"] == "timestamp_ntz"


def test_rejects(spark, tmp_path):
    p = tmp_path / "login.csv"
    p.write_text("1,1.1.1.1,fail,100\r\n2,2.2.2.2,success\r\nx,3.3.3.3,fail,5\r\n4,4.4.4.4,fail,notatime\r\n")
    parsed = text.parse(text.read_lines(spark, str(p)), "login")
    assert text.accepted(parsed).count() == 1
    errs = sorted(r._error for r in text.rejected(parsed).collect())
    assert errs == ["bad ts", "bad user_id", "too few fields"]


def test_access_log(spark, tmp_path):
    p = tmp_path / "apache.log"
    p.write_text("83.149.9.216 - - 17/05/2015:10:05:03 +0000 GET /presentations/\n"
                 "83.149.9.216 - - 31/02/2015:10:05:03 +0000 GET /bad-date\n")
    parsed = text.parse(text.read_lines(spark, str(p)), "access_log")
    ok = text.accepted(parsed).collect()
    assert len(ok) == 1 and ok[0].url == "/presentations/" and ok[0].method == "GET"
    assert ok[0].ts.isoformat() == "2015-05-17T10:05:03"
    assert [r._error for r in text.rejected(parsed).collect()] == ["bad ts"]


def test_access_time_in_a_skipped_hour(spark, tmp_path):
    p = tmp_path / "apache.log"
    p.write_text("1.2.3.4 7 - 10/03/2024:02:30:00 +0000 GET /a\n")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = text.accepted(text.parse(text.read_lines(spark, str(p)), "access_log"))
        assert df.first().ts.isoformat() == "2024-03-10T02:30:00"
        line = text.format_lines(df, "access_log").first().value
        assert line == "1.2.3.4 7 - 10/03/2024:02:30:00 - GET /a"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_null_fields_keep_their_place(spark):
    df = spark.createDataFrame([(1, None, 3, "pv", 100)],
                               "user_id long, item_id long, category_id int, behavior string, t long")
    df = df.selectExpr("user_id", "item_id", "category_id", "behavior",
                       "timestampadd(SECOND, t, TIMESTAMP_NTZ'1970-01-01 00:00:00') AS ts")
    assert text.format_lines(df, "user_behavior").first().value == "1,,3,pv,100"


def test_format_round_trip(spark, tmp_path):
    rows = logs.receipt_rows(ORDERS)
    df = text.read_events(spark, logs.write_csv(tmp_path / "receipt.csv", rows), "receipt").drop("seq")
    assert [r.value for r in text.format_lines(df, "receipt").collect()] == logs.lines(rows)
    back = text.accepted(text.parse(text.format_lines(df, "receipt"), "receipt"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
