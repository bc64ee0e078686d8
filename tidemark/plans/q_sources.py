"""Parser queries: log lines of the domain views, written out field by field here, go through the parsers.

The lines are built from the documented layouts and not from the parsers' field tables, so a wrong
index shows.  Epoch-second formats keep whole seconds, hence the oracle truncates ``ts`` to the second."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_root
from ..sources import text, views
from ..streaming.runner import run_side_outputs
from . import oracle as O
from .catalog import register

SEC = "make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS ts"
_S = "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS STRING)"

#: Lines of each log.
LINES = {
    "user_behavior": f"concat(user_id, ',', item_id, ',', category_id, ',', behavior, ',', {_S})",
    "access_log": "concat(ip, ' ', user_id, ' - ', date_format(ts, 'dd/MM/yyyy:HH:mm:ss'), ' +0000 ', method, ' ', url)",
    "ad_click": f"concat(user_id, ',', ad_id, ',', province, ',', city, ',', {_S})",
    "login": f"concat(user_id, ',', ip, ',', event_type, ',', {_S})",
    "order": f"concat(order_id, ',', event_type, ',', tx_id, ',', {_S})",
    "receipt": f"concat(tx_id, ',', pay_channel, ',', {_S})",
}


def _lines(df, kind):
    return df.select(F.expr(LINES[kind]).alias("value"))


def _round_trip(df, kind):
    return text.accepted(text.parse(_lines(df, kind), kind))


@register("parse_user_behavior", O.with_views("user_behavior")
          + f"SELECT user_id, item_id, category_id, behavior, {SEC} FROM user_behavior")
def parse_user_behavior(spark, sf_dir):
    return _round_trip(views.user_behavior(spark, sf_dir), "user_behavior")


@register("parse_access_log", O.with_views("access_log")
          + f"SELECT ip, user_id, {SEC}, method, url FROM access_log")
def parse_access_log(spark, sf_dir):
    return _round_trip(views.access_log(spark, sf_dir), "access_log")


@register("parse_ad_click", O.with_views("ad_click")
          + f"SELECT user_id, ad_id, province, city, {SEC} FROM ad_click")
def parse_ad_click(spark, sf_dir):
    return _round_trip(views.ad_click(spark, sf_dir), "ad_click")


@register("parse_login_event", O.with_views("login")
          + f"SELECT user_id, ip, event_type, {SEC} FROM login")
def parse_login_event(spark, sf_dir):
    return _round_trip(views.login(spark, sf_dir), "login")


@register("parse_order_event", O.with_views("order_events")
          + f"SELECT order_id, event_type, tx_id, {SEC} FROM order_events")
def parse_order_event(spark, sf_dir):
    return _round_trip(views.order_events(spark, sf_dir), "order")


@register("parse_receipt_event", O.with_views("receipts")
          + f"SELECT tx_id, pay_channel, {SEC} FROM receipts")
def parse_receipt_event(spark, sf_dir):
    return _round_trip(views.receipts(spark, sf_dir), "receipt")


@register("parse_rejects", "SELECT props AS _line, 'too few fields' AS _error FROM events")
def parse_rejects(spark, sf_dir):
    """Good login lines mixed with lines that are not login records (the JSON
    ``props`` strings); only the latter are rejected."""
    good = _lines(views.login(spark, sf_dir), "login")
    junk = views._events(spark, sf_dir).select(F.col("props").alias("value"))
    return text.rejected(text.parse(good.unionByName(junk), "login"))


_LOGIN_TEXT = O.with_views("login") + f"""
SELECT 'accepted' AS tag, user_id, ip, event_type, {SEC}, NULL AS _line, NULL AS _error FROM login
UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, props, 'too few fields' FROM events"""


def _login_text(spark, sf_dir) -> str:
    """A folder of text files with all login lines and, between them, lines that are no logins."""
    path = os.path.join(checkpoint_root(spark), "text", uuid.uuid4().hex)
    junk = views._events(spark, sf_dir).select(F.col("props").alias("value"))
    _lines(views.login(spark, sf_dir), "login").unionByName(junk).write.text(path)
    return path


def _login_rows(tagged):
    ok = F.col("tag") == "accepted"
    return tagged.select("tag", *[F.when(ok, F.col(c)).alias(c) for c in ("user_id", "ip", "event_type", "ts")],
                         F.when(~ok, F.col("_line")).alias("_line"), "_error")


@register("text_login_rows", _LOGIN_TEXT)
def text_login_rows(spark, sf_dir):
    """Text files in, typed rows and rejects out."""
    return _login_rows(text.tagged(text.parse(text.read_lines(spark, _login_text(spark, sf_dir)), "login")))


@register("stream_text_login_rows", _LOGIN_TEXT)
def stream_text_login_rows(spark, sf_dir):
    """Text files as a stream, typed rows into one sink and rejects into another."""
    lines = text.read_lines(spark, _login_text(spark, sf_dir), streaming=True)
    return _login_rows(run_side_outputs(text.tagged(text.parse(lines, "login")), ["accepted", "rejected"], "login_text"))
