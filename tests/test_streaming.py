"""Streaming forms against the batch operators (closed windows / fired timers only:
a stream does not flush its open state at the end of the input)."""

import os
import random
import tempfile

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import logs

from conftest import SF_SMALL, epoch, frame
from tidemark.operators import market, windows
from tidemark.streaming import joins as SJ
from tidemark.streaming import processors as SP
from tidemark.streaming import sinks
from tidemark.streaming import windows as SW


def _split_parquet(src: str, parts: int, sort_col: str) -> str:
    t = pq.read_table(src).sort_by(sort_col)
    d = tempfile.mkdtemp(prefix="tm-stream-")
    step = (t.num_rows + parts - 1) // parts
    for i in range(parts):
        pq.write_table(t.slice(i * step, step), os.path.join(d, f"part-{i:03d}.parquet"))
    return d


def _feed(spark, rows, schema, parts, name):
    """A file stream whose ``parts`` batches hold consecutive rows; seq is part of the rows."""
    d = tempfile.mkdtemp(prefix=f"tm-{name}-")
    step = -(-len(rows) // parts)
    for i in range(parts):
        df = frame(spark, rows[i * step:(i + 1) * step], schema)
        pq.write_table(df.toArrow(), os.path.join(d, f"part-{i:03d}.parquet"))
        os.utime(os.path.join(d, f"part-{i:03d}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(d)


def _run_memory(df, name, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode)
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tm-ck-")).start())
    q.processAllAvailable()
    wm = q.lastProgress["eventTime"].get("watermark") if q.lastProgress else None
    q.stop()
    return wm


@pytest.fixture(scope="module")
def event_stream(spark):
    d = _split_parquet(os.path.join(SF_SMALL, "events.parquet"), 6, "ts")
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(d)


@pytest.mark.parametrize("size,slide", [("1 day", "6 hours"), ("2 hours", "1 minute")])
def test_stream_window_counts(spark, event_stream, size, slide):
    name = "wc_" + size.replace(" ", "") + slide.replace(" ", "")
    _run_memory(SW.stream_window_count(event_stream, "ts", ["event_type"], size, slide), name)
    got = {(r.window_end, r.event_type): r.cnt for r in spark.table(name).collect()}
    assert got, "no window closed"
    batch = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    want = {(r.window_end, r.event_type): r.cnt
            for r in windows.sliding_count(batch, "ts", ["event_type"], size, slide).collect()}
    for k, v in got.items():
        assert want[k] == v
    # Every window that ends before the last closed one was emitted.
    last = max(e for e, _ in got)
    assert {k for k in want if k[0] <= last} == set(got)


def test_stream_unique_visitors(spark, event_stream):
    _run_memory(SW.stream_unique_visitors(event_stream, "ts", "1 day"), "uv_stream")
    got = {r.window_start: r.uv for r in spark.table("uv_stream").collect()}
    assert got
    batch = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    from tidemark.operators.windows import tumbling_agg
    want = {r.window_start: r.uv for r in
            tumbling_agg(batch, "ts", [], "1 day", [F.countDistinct("user_id").alias("uv")]).collect()}
    for k, v in got.items():
        assert want[k] == v


def test_stream_topn_foreach_batch(spark, event_stream):
    counts = SW.stream_window_count(event_stream.withColumn("item", F.get_json_object("props", "$.k")),
                                    "ts", ["item"], "1 day", "12 hours")
    out = tempfile.mkdtemp(prefix="tm-topn-")
    q = sinks.start_batches(counts, sinks.topn_batches(out, "window_end", "cnt", "item", 3),
                            tempfile.mkdtemp(prefix="tm-ck-"))
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() > 0
    assert got.groupBy("window_end").count().where("count > 3").count() == 0


LOGIN = "user_id long, ip string, event_type string, ts long, seq long"
ORDER = "order_id long, event_type string, tx_id string, ts long, seq long"
RECEIPT = "tx_id string, pay_channel string, ts long, seq long"
CLICK = "user_id long, ad_id long, province string, city string, ts long, seq long"
FAR = 10_000_000  # a last event this much later closes everything before it


def _rows(spark, df, name):
    _run_memory(df, name)
    return spark.table(name).collect()


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_click_cap_equals_batch_for_any_split(spark, parts):
    rnd = random.Random(4)
    # Six days of clicks in disorder of up to an hour, so days overlap between batches.
    clicks = [(u, 1, "P", "C", 1_700_000_000 + rnd.randrange(6 * 86_400), k)
              for k, u in enumerate(rnd.choices([7, 8], k=120))]
    clicks.sort(key=lambda r: r[4] + rnd.randrange(3600))
    clicks.append((99, 1, "P", "C", clicks[-1][4] + FAR, 1000))
    stream = _feed(spark, clicks, CLICK, parts, "clicks")
    got = _rows(spark, SP.stream_click_cap(stream, 3, "1 day", delay="1 hour"), f"cap{parts}")
    batch = frame(spark, clicks, CLICK)
    main = {r.seq for r in market.ad_click_capped(batch, 3, "1 day").collect()} - {1000}
    black = {(r.user_id, epoch(r.ts)) for r in market.ad_click_blacklist(batch, 3, "1 day").collect()}
    assert {r.seq for r in got if r.tag == "main"} == main
    assert {(r.user_id, epoch(r.ts)) for r in got if r.tag == "blacklist"} == black and black


def test_late_click_of_the_day_before_does_not_reset_the_count(spark):
    day = 86_400 * 20_000
    clicks = [(1, 1, "P", "C", day + 10, 1), (1, 1, "P", "C", day + 20, 2), (1, 1, "P", "C", day - 5, 3),
              (1, 1, "P", "C", day + 30, 4), (1, 1, "P", "C", day + 40, 5), (2, 1, "P", "C", day + FAR, 6)]
    got = _rows(spark, SP.stream_click_cap(_feed(spark, clicks, CLICK, 6, "late"), 2, "1 day", delay="1 minute"), "lateday")
    assert sorted(r.seq for r in got if r.tag == "main") == [1, 2, 3]
    assert [r.seq for r in got if r.tag == "blacklist"] == [4]


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_logins_equal_batch_for_any_split(spark, parts):
    rows = logs.login_rows(seed=parts)
    stream = lambda: _feed(spark, [*rows, (999, "-", "success", rows[-1][3] + FAR, 10_000)], LOGIN, parts, "login")
    pairs = logs.fail_pairs(rows, 8)
    for k, fn in enumerate((SP.stream_login_fail_consecutive, SP.stream_login_fail_pattern)):
        got = _rows(spark, fn(stream(), "8 seconds", "5 seconds"), f"pairs{parts}_{k}")
        assert sorted((r.user_id, epoch(r.first_fail_ts), epoch(r.last_fail_ts)) for r in got) == pairs
    got = _rows(spark, SP.stream_login_fail_burst(stream(), "10 seconds", 2, "5 seconds"), f"burst{parts}")
    assert sorted((r.user_id, epoch(r.first_fail_ts), epoch(r.last_fail_ts)) for r in got) \
        == [x[:3] for x in logs.fail_bursts(rows, 10, 2)]


def test_failures_in_reverse_arrival_do_not_warn_backwards(spark):
    rows = [(1, "-", "fail", 100, 1), (1, "-", "fail", 50, 2), (2, "-", "success", FAR, 3)]
    got = _rows(spark, SP.stream_login_fail_consecutive(_feed(spark, rows, LOGIN, 3, "back"), "10 seconds", "60 seconds"),
                "backwards")
    assert got == []


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_orders_equal_batch_for_any_split(spark, parts):
    rows = logs.order_rows(seed=parts)
    stream = lambda: _feed(spark, [*rows, (999, "create", "", rows[-1][3] + FAR, 10_000)], ORDER, parts, "order")
    got = _rows(spark, SP.stream_order_pattern(stream(), "15 minutes", "5 seconds"), f"opat{parts}")
    assert {(r.order_id, epoch(r.create_ts)): r.pay_ts and epoch(r.pay_ts) for r in got} == logs.order_pattern(rows, 900)
    got = _rows(spark, SP.stream_order_status(stream(), "15 minutes", "5 seconds"), f"ostat{parts}")
    assert {(r.order_id, epoch(r.create_ts)): r.result == "order payed successfully" for r in got} \
        == logs.order_status(rows, 900)
    got = _rows(spark, SP.stream_order_match(stream(), "15 minutes", "1000 seconds", "5 seconds"), f"omatch{parts}")
    assert {r.order_id: r.result for r in got} == logs.order_match(rows, 900, 1000)


def test_two_creates_and_two_pays(spark):
    rows = [(1, "create", "", 100, 1), (1, "create", "", 200, 2), (1, "pay", "a", 300, 3), (1, "pay", "b", 350, 4),
            (9, "create", "", FAR, 5)]
    got = _rows(spark, SP.stream_order_status(_feed(spark, rows, ORDER, 5, "twice"), "15 minutes"), "twice_s")
    assert sorted((epoch(r.create_ts), r.result) for r in got) == [(100, "order payed successfully"),
                                                                   (200, "order payed successfully")]
    got = _rows(spark, SP.stream_order_pattern(_feed(spark, rows, ORDER, 5, "twice"), "15 minutes"), "twice_p")
    assert sorted((epoch(r.create_ts), epoch(r.pay_ts)) for r in got) == [(100, 300), (200, 300)]


@pytest.mark.parametrize("parts,bucket", [(1, None), (4, None), (4, "10 seconds"), (2, "1 hour")])
def test_stream_tx_reconcile(spark, parts, bucket):
    rows = logs.order_rows(seed=7)
    recs = logs.receipt_rows(rows)
    end = max(r[3] for r in rows) + FAR
    orders = _feed(spark, [*rows, (999, "pay", "end", end, 10_000)], ORDER, parts, "od")
    receipts = _feed(spark, [*recs, ("other", "cash", end, 10_000)], RECEIPT, parts, "rc")
    got = _rows(spark, SJ.stream_tx_reconcile(orders, receipts, "5 seconds", "1 hour", bucket), f"tx{parts}{(bucket or '')[:2].strip()}")
    pairs, lone_pays, lone_receipts = logs.tx_pairs(rows, recs, 5)
    assert sorted((r.tx_id, r.order_id, epoch(r.receipt_ts) - epoch(r.pay_ts)) for r in got if r.tag == "matched") == pairs
    assert sorted(r.tx_id for r in got if r.tag == "unmatched_pay") == lone_pays
    assert sorted(r.tx_id for r in got if r.tag == "unmatched_receipt") == lone_receipts


def test_click_cap_processing_time_reset(spark):
    # The counter is cleared by a processing-time timer, after which the same user passes again.
    import time
    clicks = [(9, 1, "P", "C", 100 + i, i) for i in range(4)]
    d = tempfile.mkdtemp(prefix="tm-reset-")
    table = frame(spark, clicks, CLICK)
    pq.write_table(table.toArrow(), os.path.join(d, "a.parquet"))
    stream = spark.readStream.schema(table.schema).parquet(d)
    q = (SP.stream_click_cap(stream, 2, reset=None, processing_reset="4 seconds").writeStream
         .format("memory").queryName("capped_pt").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tm-ck-"))
         .trigger(processingTime="1 second").start())

    def wait(n):
        deadline = time.time() + 90
        while time.time() < deadline and spark.table("capped_pt").count() < n:
            time.sleep(0.5)
        return sorted(r.tag for r in spark.table("capped_pt").collect())
    try:
        assert wait(3) == ["blacklist", "main", "main"]
        time.sleep(9)                                  # the timer has fired
        pq.write_table(table.toArrow(), os.path.join(d, "b.parquet"))
        assert wait(6) == ["blacklist"] * 2 + ["main"] * 4
    finally:
        q.stop()


def test_stream_uv_running_update_mode(spark, event_stream):
    q = (SW.stream_uv_running(event_stream, "ts", "1 day").writeStream.format("memory")
         .queryName("uv_run").outputMode("update")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tm-ck-")).start())
    q.processAllAvailable()
    q.stop()
    latest = {}
    for r in spark.table("uv_run").collect():
        latest[r.window_start] = max(latest.get(r.window_start, 0), r.uv)
    batch = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet"))
    from tidemark.operators.distinct import user_slot
    from tidemark.operators.windows import tumbling_agg
    b = batch.withColumn("slot", user_slot(batch, "user_id"))
    want = {r.window_start: r.uv for r in
            tumbling_agg(b, "ts", [], "1 day", [F.countDistinct("slot").alias("uv")]).collect()}
    assert latest == want


def test_kafka_without_connector(spark):
    from tidemark.sources.streams import read_kafka_lines
    with pytest.raises(RuntimeError, match="connector"):
        read_kafka_lines(spark, "localhost:9092", "events")


def test_start_hot_items_topn(spark, event_stream):
    from tidemark.streaming.sinks import start_hot_items_topn
    ub = event_stream.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"),
                             F.when(F.col("event_type") == "view", "pv").otherwise("x").alias("behavior"), "ts")
    out = tempfile.mkdtemp(prefix="tm-hot-")
    start_hot_items_topn(ub, out, tempfile.mkdtemp(prefix="tm-ck-"), "1 day", "12 hours").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() > 0 and got.agg(F.max("rank")).first()[0] <= 3


def test_registered_streams_run_with_the_default_state_store(spark):
    """A caller's session has Spark's default store; a registered query brings its own and puts it back."""
    import __spark_entry__ as entry
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(SP.PROVIDER)
    spark.conf.set(SP.PROVIDER, default)
    try:
        assert entry.queries()["stream_ad_click_blacklist"](spark, SF_SMALL).count() >= 0
        assert spark.conf.get(SP.PROVIDER) == default
        with pytest.raises(RuntimeError, match="RocksDB"):
            SP.stream_click_cap(_feed(spark, [(1, 1, "P", "C", 5, 1)], CLICK, 1, "plain"), 2, "1 day")
    finally:
        spark.conf.set(SP.PROVIDER, before)


def test_oracles_name_no_view_they_do_not_define():
    import duckdb
    import __spark_entry__ as entry
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
              "labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    for name, sql in entry.catalog.ORACLE.items():
        con.execute(f"EXPLAIN {sql}")
