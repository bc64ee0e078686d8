"""Domain views derived from the driver tables.

The driver tables carry no clickstream logs, so each domain record type of the
analytics jobs is derived from ``events``/``orders``/``lineitem`` plus their
dimension tables.  All derivations are declarative: joins against dimension
tables are left to the planner, which broadcasts a side only when its measured
size is under ``spark.sql.autoBroadcastJoinThreshold`` (and AQE re-plans from
runtime sizes); otherwise it shuffles.

``seq`` is the arrival number used as the tie-break after event time (unique
except for receipts, where an order has one for each line item).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# Fixed values of the view derivations.
ITEM_JSON_PATH = "$.k"
AD_MODULUS = 5             # ad_id = k % 5
CATEGORY_MODULUS = 10      # category_id = item_id % 10
PAY_DAYS = 60              # an invoice is paid customer key % 60 days later


def _table(spark: SparkSession, sf_dir: str, name: str, streaming=False) -> DataFrame:
    """A fact table: read whole, as a file stream (True), or as the stream of a ``runner.Feed``."""
    if not streaming:
        return read_table(spark, sf_dir, name)
    if streaming is True:
        from ..streaming.runner import stream_table
        return stream_table(spark, sf_dir, name)
    return streaming.stream(name)


def _events(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    return _table(spark, sf_dir, "events", streaming)


def _item(props_col: str = "props"):
    return F.get_json_object(F.col(props_col), ITEM_JSON_PATH).cast("long")


def user_behavior(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """UserBehavior(user_id, item_id, category_id, behavior, ts, seq); views are 'pv'."""
    ev = _events(spark, sf_dir, streaming)
    item = _item()
    return ev.select(
        F.col("user_id"),
        item.alias("item_id"),
        (item % CATEGORY_MODULUS).cast("int").alias("category_id"),
        F.when(F.col("event_type") == "view", F.lit("pv")).otherwise(F.col("event_type")).alias("behavior"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event stream per user: user_id, event_type, value, ts, seq."""
    return _events(spark, sf_dir).select(
        "user_id", "event_type", "value", "ts", F.col("event_id").alias("seq"))


def access_log(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """ApacheLogEvent(ip, user_id, ts, method, url, seq): every event is a GET of a page.

    page_id = (k squared + user_id) modulo the number of pages (counted in the plan), so all pages
    are visited and small k are visited by more users."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
    ev = _events(spark, sf_dir, streaming).select(
        "user_id", "ts", "event_id", F.pmod(_item() * _item() + F.col("user_id"), n_pages).alias("page_id"))
    return ev.join(pages, "page_id").select(
        F.format_string("10.0.%d.%d", (F.col("user_id") / 256).cast("long") % 256,
                        F.col("user_id") % 256).alias("ip"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts"),
        F.lit("GET").alias("method"),
        F.col("url"),
        F.col("event_id").alias("seq"),
    )


def marketing(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """MarketingUserBehavior(user_id, behavior, channel, ts, seq).

    behavior = upper(event_type) with 'error' standing for an uninstall;
    channel = the customer's market segment.
    """
    ev = _events(spark, sf_dir, streaming).select("user_id", "event_type", "ts", "event_id")
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("channel"))
    return ev.join(cust, "user_id").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_type") == "error", F.lit("UNINSTALL"))
         .otherwise(F.upper("event_type")).alias("behavior"),
        F.col("channel"),
        F.col("ts"),
        F.col("event_id").alias("seq"),
    )


def ad_click(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """AdClickEvent(user_id, ad_id, province, city, ts, seq) from click events."""
    ev = (_events(spark, sf_dir, streaming)
          .where(F.col("event_type") == "click")
          .select("user_id", "ts", "event_id", (_item() % AD_MODULUS).alias("ad_id")))
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), "c_nationkey", F.col("c_mktsegment").alias("city"))
    nation = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("province"))
    return (ev.join(cust, "user_id").join(nation, "c_nationkey")
            .select("user_id", "ad_id", "province", "city", "ts", F.col("event_id").alias("seq")))


def login(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """LoginEvent(user_id, ip, event_type in {fail, success}, ts, seq); errors are failures."""
    ev = _events(spark, sf_dir, streaming)
    return ev.select(
        "user_id",
        F.format_string("192.168.%d.%d", (F.col("user_id") / 256).cast("long") % 256,
                        F.col("user_id") % 256).alias("ip"),
        F.when(F.col("event_type") == "error", F.lit("fail")).otherwise(F.lit("success")).alias("event_type"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def order_events(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """OrderEvent(order_id, event_type in {create, pay}, tx_id, ts, seq).

    create = an order, at its order date, with an empty tx id; pay = each of its line items, at the
    ship date, tx id 'tx' + order key.  Orders without line items are never paid.
    """
    creates = _table(spark, sf_dir, "orders", streaming).select(
        F.col("o_orderkey").alias("order_id"),
        F.lit("create").alias("event_type"),
        F.lit("").alias("tx_id"),
        F.col("o_orderdate").alias("ts"),
        (F.col("o_orderkey") * 10).alias("seq"))
    pays = _table(spark, sf_dir, "lineitem", streaming).select(
        F.col("l_orderkey").alias("order_id"),
        F.lit("pay").alias("event_type"),
        F.concat(F.lit("tx"), F.col("l_orderkey").cast("string")).alias("tx_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return creates.unionByName(pays)


def receipts(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """ReceiptEvent(tx_id, pay_channel, ts, seq): every part sold acknowledges a payment of its order.

    The receipt of a line item comes its quantity in days after the ship date; seq = order
    key * 10 + line number, which orders receipts but does not identify one.
    """
    items = _table(spark, sf_dir, "lineitem", streaming)
    return items.select(
        F.concat(F.lit("tx"), F.col("l_orderkey").cast("string")).alias("tx_id"),
        F.col("l_returnflag").alias("pay_channel"),
        F.timestamp_add("DAY", F.col("l_quantity").cast("int"), F.col("l_shipdate")).alias("ts"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


def invoice_events(spark: SparkSession, sf_dir: str, streaming=False) -> DataFrame:
    """OrderEvent rows with at most one create and one pay of an order.

    An order of status O or F is invoiced at its order date (create); one of status O or P is paid, its customer key
    modulo 60 in days after that date.  So O is paid in time or late, F never, and P without an invoice."""
    orders = _table(spark, sf_dir, "orders", streaming).withColumn("order_id", F.col("o_orderkey"))
    create = F.when(F.col("o_orderstatus") != "P", F.struct(F.lit("create").alias("event_type"), F.col("o_orderdate").alias("ts")))
    pay = F.when(F.col("o_orderstatus") != "F", F.struct(
        F.lit("pay").alias("event_type"), F.timestamp_add("DAY", (F.col("o_custkey") % PAY_DAYS).cast("int"), F.col("o_orderdate")).alias("ts")))
    return orders.select("order_id", F.explode(F.filter(F.array(create, pay), lambda e: e.isNotNull())).alias("e")) \
        .select("order_id", "e.event_type", F.lit("").alias("tx_id"), "e.ts", F.col("order_id").alias("seq"))
