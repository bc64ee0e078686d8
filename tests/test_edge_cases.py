"""Hand-made cases and independence of the input order."""

import os
import tempfile

from pyspark.sql import functions as F

import logs

from conftest import epoch, frame
from tidemark.operators import distinct, joins, login, market, orders, sequences, traffic
from tidemark.operators.windows import sliding_count
from tidemark.sources import text

UB = "user_id long, item_id long, category_id int, behavior string, ts long, seq long"
LOGIN = "user_id long, event_type string, ts long, seq long"
ORDER = "order_id long, event_type string, tx_id string, ts long, seq long"
RECEIPT = "tx_id string, pay_channel string, ts long, seq long"


def test_empty_inputs(spark):
    ub = frame(spark, [], UB)
    assert traffic.hot_items_topn(ub).count() == 0
    assert distinct.unique_visitors_hourly(ub).count() == 0
    assert distinct.uv_running(ub, partitions=2).count() == 0
    lg = frame(spark, [], LOGIN)
    assert login.login_fail_burst(lg).count() == 0
    assert login.login_fail_pattern(lg).count() == 0
    od, rc = frame(spark, [], ORDER), frame(spark, [], RECEIPT)
    assert orders.order_pay_match(od).count() == 0
    assert orders.order_timeout_status(od).count() == 0
    assert joins.tx_reconcile(od, rc).count() == 0


def test_duplicate_pays_keep_all_pairs(spark):
    od = frame(spark, [(1, "pay", "t", 100, 1), (1, "pay", "t", 102, 2)], ORDER)
    rc = frame(spark, [("t", "wechat", 101, 1)], RECEIPT)
    pairs = sorted((epoch(r.pay_ts), epoch(r.receipt_ts)) for r in joins.tx_pairs(od, rc, "5 seconds").collect())
    assert pairs == [(100, 101), (102, 101)]
    assert joins.tx_unmatched_pays(od, rc, "5 seconds").count() == 0


def test_pay_before_create(spark):
    od = frame(spark, [(7, "pay", "t7", 100, 1), (7, "create", "", 200, 2),
                       (8, "create", "", 100, 3), (8, "pay", "t8", 2000, 4)], ORDER)
    match = {r.order_id: r.result for r in orders.order_pay_match(od, "15 minutes").collect()}
    assert match == {7: "payed successfully", 8: "payed but already timeout"}
    # A create preceded by a pay produces no status row.
    status = {r.order_id: r.result for r in orders.order_timeout_status(od, "15 minutes").collect()}
    assert status == {8: "order timeout"}
    pattern = {r.order_id: r.result for r in orders.order_pattern(od, "15 minutes").collect()}
    assert pattern == {7: "timeout", 8: "timeout"}


def test_late_access_rows_inside_and_outside_the_delay(spark):
    from tidemark.streaming import windows as SW
    d = tempfile.mkdtemp(prefix="tm-late-")
    batches = [
        # max 00:07:00 -> watermark 00:05:59: window [00:00, 00:05) closes.
        ["1.1.1.1 u - 01/01/2024:00:00:10 +0000 GET /a", "1.1.1.1 u - 01/01/2024:00:07:00 +0000 GET /b"],
        # 30 s behind the max, window [00:05, 00:10) still open: counted.
        # 00:04:30 belongs to the closed window: dropped.
        ["1.1.1.1 u - 01/01/2024:00:06:30 +0000 GET /a", "1.1.1.1 u - 01/01/2024:00:04:30 +0000 GET /a"],
        ["1.1.1.1 u - 01/01/2024:01:00:00 +0000 GET /c"],
    ]
    lines = text.read_lines(spark, d, streaming=True)
    access = text.accepted(text.parse(lines, "access_log"))
    counts = SW.stream_window_count(access, "ts", ["url"], "5 minutes", None, delay="61 seconds")
    q = (counts.writeStream.format("memory").queryName("late").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tm-ck-")).start())
    for i, b in enumerate(batches):
        with open(os.path.join(d, f"b{i}.log"), "w") as f:
            f.write("\n".join(b) + "\n")
        q.processAllAvailable()
    q.stop()
    got = {(r.url, r.window_start.minute): r.cnt for r in spark.table("late").collect()}
    assert got[("/a", 0)] == 1
    assert got[("/a", 5)] == 1
    assert got[("/b", 5)] == 1


def test_results_do_not_depend_on_input_order(spark):
    lg = frame(spark, [(u, k, t, n) for u, _, k, t, n in logs.login_rows()], LOGIN)
    shuffled = lg.orderBy(F.rand(7)).repartition(5)
    for fn in (lambda d: login.login_fail_burst(d, "10 seconds", 2),
               lambda d: login.login_fail_pattern(d, "10 seconds"),
               lambda d: sequences.seq_times(d, "user_id", F.col("event_type") == "fail", 2)):
        assert sorted(map(tuple, fn(lg).collect())) == sorted(map(tuple, fn(shuffled).collect()))
    od = frame(spark, logs.order_rows(), ORDER)
    rc = frame(spark, logs.receipt_rows(logs.order_rows()), RECEIPT)
    a = sorted(map(tuple, joins.tx_reconcile(od, rc, "5 seconds").collect()), key=repr)
    b = sorted(map(tuple, joins.tx_reconcile(od.orderBy(F.rand(3)), rc.orderBy(F.rand(4)),
                                             "5 seconds").collect()), key=repr)
    assert a == b
    ads = frame(spark, [(u % 3, u % 2, "P", "C", 100 + u, u) for u in range(40)],
                "user_id long, ad_id long, province string, city string, ts long, seq long")
    x = sorted(map(tuple, market.ad_click_capped(ads, 3).collect()))
    y = sorted(map(tuple, market.ad_click_capped(ads.orderBy(F.rand(1)).repartition(3), 3).collect()))
    assert x == y
    cnt = sorted(map(tuple, sliding_count(ads, "ts", ["province"], "20 seconds", "5 seconds").collect()))
    cnt2 = sorted(map(tuple, sliding_count(ads.repartition(4), "ts", ["province"], "20 seconds",
                                           "5 seconds").collect()))
    assert cnt == cnt2
