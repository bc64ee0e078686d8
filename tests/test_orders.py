from collections import Counter

import logs
import pytest

from conftest import epoch, frame
from tidemark.operators.joins import tx_pairs, tx_reconcile, tx_unmatched_pays, tx_unmatched_receipts
from tidemark.operators.orders import (order_pattern, order_pay_match, order_payed_pattern, order_timeout_pattern,
                                       order_timeout_status)
from tidemark.sources.text import read_events

ORDERS = logs.order_rows()
RECEIPTS = logs.receipt_rows(ORDERS)


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    path = logs.write_csv(tmp_path_factory.mktemp("logs") / "order.csv", ORDERS)
    return read_events(spark, path, "order").cache()


@pytest.fixture(scope="module")
def receipts(spark, tmp_path_factory):
    path = logs.write_csv(tmp_path_factory.mktemp("logs") / "receipt.csv", RECEIPTS)
    return read_events(spark, path, "receipt").cache()


def test_pattern(orders):
    want = logs.order_pattern(ORDERS, 900)
    got = {(r.order_id, epoch(r.create_ts)): r.pay_ts and epoch(r.pay_ts)
           for r in order_pattern(orders, "15 minutes").collect()}
    assert got == want
    assert {r.order_id for r in order_payed_pattern(orders, "15 minutes").collect()} \
        == {o for (o, _), p in want.items() if p is not None}
    assert {r.order_id for r in order_timeout_pattern(orders, "15 minutes").collect()} \
        == {o for (o, _), p in want.items() if p is None}


def test_status(orders):
    got = {(r.order_id, epoch(r.create_ts)): r.result == "order payed successfully"
           for r in order_timeout_status(orders, "15 minutes").collect()}
    assert got == logs.order_status(ORDERS, 900)


@pytest.mark.parametrize("horizon", [None, 1000])
def test_pay_match(orders, horizon):
    rows = order_pay_match(orders, "15 minutes", None if horizon is None else f"{horizon} seconds").collect()
    want = logs.order_match(ORDERS, 900, horizon)
    assert {r.order_id: r.result for r in rows} == want
    assert {r.output for r in rows if r.result == "payed successfully"} == {"payed"}
    assert len(set(want.values())) >= 3


def test_reconciliation(orders, receipts):
    pairs, lone_pays, lone_receipts = logs.tx_pairs(ORDERS, RECEIPTS, 5)
    got = sorted((r.tx_id, r.order_id, epoch(r.receipt_ts) - epoch(r.pay_ts))
                 for r in tx_pairs(orders, receipts, "5 seconds").collect())
    assert got == pairs and pairs and lone_pays and lone_receipts
    assert sorted(r.tx_id for r in tx_unmatched_pays(orders, receipts, "5 seconds").collect()) == lone_pays
    assert sorted(r.tx_id for r in tx_unmatched_receipts(orders, receipts, "5 seconds").collect()) == lone_receipts
    rows = tx_reconcile(orders, receipts, "5 seconds").collect()
    assert Counter(r.tag for r in rows) == {"matched": len(pairs), "unmatched_pay": len(lone_pays),
                                            "unmatched_receipt": len(lone_receipts)}


@pytest.mark.parametrize("bucket", [None, "7 seconds", "1 hour"])
def test_reconcile_in_one_join(spark, bucket):
    rows = [*ORDERS, *ORDERS[:40], (1, "pay", "tx1", None, 1), (2, "pay", None, 50, 2)]
    recs = [*RECEIPTS, *RECEIPTS[:40], (None, "cash", 60, 7), ("tx1", "cash", None, 8)]
    pays = [r for r in rows if r[1] == "pay" and r[2] and r[3] is not None]
    recs_in = [r for r in recs if r[2] is not None]
    near = lambda p, r: p[2] == r[0] and abs(p[3] - r[2]) <= 5
    want = Counter((p[2], p[0], p[4], r[1], r[3], "matched") for p in pays for r in recs_in if near(p, r))
    want += Counter((p[2], p[0], p[4], None, None, "unmatched_pay") for p in pays if not any(near(p, r) for r in recs_in))
    want += Counter((r[0], None, None, r[1], r[3], "unmatched_receipt") for r in recs_in if not any(near(p, r) for p in pays))
    got = tx_reconcile(frame(spark, rows, "order_id long, event_type string, tx_id string, ts long, seq long"),
                       frame(spark, recs, "tx_id string, pay_channel string, ts long, seq long"), "5 seconds", bucket)
    assert Counter((r.tx_id, r.order_id, r.pay_seq, r.pay_channel, r.receipt_seq, r.tag) for r in got.collect()) == want
    # Each side goes through one shuffle, and is read once.
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan and plan.count("Scan") <= 2


def test_key_only_matching(orders, receipts):
    pairs, lone_pays, _ = logs.tx_pairs(ORDERS, RECEIPTS, 3650 * 86400)
    assert tx_pairs(orders, receipts, "3650 days").count() == len(pairs)
    assert {r.tx_id for r in tx_unmatched_pays(orders, receipts, "3650 days").collect()} == set(lone_pays)
