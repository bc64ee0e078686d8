"""Delimited text sources: one record per line, positional fields.

``read_lines`` reads text files (batch or streaming) into ``value``; the
``parse_*`` functions split, trim and ``try_cast`` each field.  A line that does
not parse (missing field, non-numeric number, bad date) is not dropped silently:
``_error`` names the first failing field, and :func:`accepted` / :func:`rejected`
split the frame into the good rows and the reject rows (:func:`tagged` keeps both, for two sinks).  Carriage
returns of CRLF files are stripped.

Event times of the logs are epoch seconds (``ts``) or a ``dd/MM/yyyy:HH:mm:ss``
wall-clock string; both become ``timestamp_ntz``.  ``seq`` is the line's position (see :func:`read_lines`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

# Fixed values of the log formats.
ACCESS_TIME_FORMAT = "dd/MM/yyyy:HH:mm:ss"
ACCESS_TIME = r"^([0-9]{2})/([0-9]{2})/([0-9]{4}):([0-9]{2}):([0-9]{2}):([0-9]{2})$"


@dataclass(frozen=True)
class Field:
    name: str
    index: int
    kind: str  # long | int | string | epoch_s | access_time


@dataclass(frozen=True)
class LineFormat:
    sep: str
    fields: tuple[Field, ...]

    @property
    def width(self) -> int:
        return max(f.index for f in self.fields) + 1


def _f(spec: str, sep: str) -> LineFormat:
    out = []
    for i, part in enumerate(spec.split()):
        if part == "_":
            continue
        name, kind = part.split(":")
        out.append(Field(name, i, kind))
    return LineFormat(sep, tuple(out))


# Field layout of each log, in order ("_" = unused position).
FORMATS = {
    "user_behavior": _f("user_id:long item_id:long category_id:int behavior:string ts:epoch_s", ","),
    "access_log": _f("ip:string user_id:string _ ts:access_time _ method:string url:string", " "),
    "ad_click": _f("user_id:long ad_id:long province:string city:string ts:epoch_s", ","),
    "login": _f("user_id:long ip:string event_type:string ts:epoch_s", ","),
    "order": _f("order_id:long event_type:string tx_id:string ts:epoch_s", ","),
    "receipt": _f("tx_id:string pay_channel:string ts:epoch_s", ","),
}


def read_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Text lines of a file or folder as ``value`` (``\\r`` stripped), with ``seq``, batch or stream.

    ``seq`` orders lines as they were written: by the file's modification second, then by the place in the
    file.  Place = start of the file's block + row number in its task: a block has at least as many bytes
    as lines, so places rise along a file however it is split (files up to 2 GB)."""
    df = (spark.readStream if streaming else spark.read).text(path)
    df = df.select(F.regexp_replace("value", "\r$", "").alias("value"),
                   (F.unix_seconds("_metadata.file_modification_time") * (1 << 31) + F.col("_metadata.file_block_start")).alias("seq"))
    if streaming:
        return df.mapInArrow(_number_rows, "value string, seq long")
    return df.withColumn("seq", F.col("seq") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the row number in the task to ``seq`` (a stream has no built-in for it)."""
    n = 0
    for batch in batches:
        seq = pc.add(batch.column(1), pa.array(range(n, n + batch.num_rows), pa.int64()))
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column(0), seq], names=["value", "seq"])


def _typed(raw: Column, kind: str) -> Column:
    v = F.trim(raw)
    if kind == "long":
        return v.try_cast("long")
    if kind == "int":
        return v.try_cast("int")
    if kind == "string":
        return v
    if kind == "epoch_s":
        return F.timestamp_add("SECOND", v.try_cast("long"), _epoch())
    if kind == "access_time":
        # Built from its fields as a wall clock, so the session time zone (and its missing hours) plays no part.
        part = lambda at, n: F.substring(v, at, n)
        iso = F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2), F.lit(" "), part(12, 8))
        return F.when(v.rlike(ACCESS_TIME), iso.try_cast("timestamp_ntz"))
    raise ValueError(kind)


def _once(df: DataFrame, keep: list[str], name: str, value: Column) -> DataFrame:
    """``value`` as a column that is evaluated once a row: filters and later columns on it are not pushed below the
    generator, where they would evaluate the expression again."""
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def parse(lines: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Typed columns of format ``kind`` plus ``_error`` (null when the line parsed)."""
    fmt = FORMATS[kind]
    keep = [c for c in lines.columns if c != value]
    lines = _once(lines.withColumnRenamed(value, "_line"), keep, "_l",
                  F.struct("_line", F.split(F.coalesce("_line", F.lit("")), fmt.sep, -1).alias("parts")))
    raw = {f.name: F.get(F.col("_l.parts"), F.lit(f.index)) for f in fmt.fields}
    typed = _once(lines, [*keep, "_l"], "_t", F.struct(*[_typed(raw[f.name], f.kind).alias(f.name) for f in fmt.fields]))
    error = F.lit(None).cast("string")
    for f in reversed(fmt.fields):
        bad = F.col(f"_t.{f.name}").isNull()
        error = F.when(bad, F.lit(f"bad {f.name}")).otherwise(error)
    error = F.when(F.size("_l.parts") < fmt.width, F.lit("too few fields")).otherwise(error)
    return typed.select(*[F.col(f"_t.{f.name}").alias(f.name) for f in fmt.fields], *keep, error.alias("_error"), F.col("_l._line").alias("_line"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_error").isNull()).drop("_error", "_line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("_error").isNotNull()).select("_line", "_error")


def tagged(parsed: DataFrame) -> DataFrame:
    """All rows with ``tag`` 'accepted' or 'rejected', for ``sinks.fan_out``: one pass, two sinks."""
    return parsed.withColumn("tag", F.when(F.col("_error").isNull(), F.lit("accepted")).otherwise(F.lit("rejected")))


def parse_user_behavior(lines: DataFrame) -> DataFrame:
    return accepted(parse(lines, "user_behavior"))


def parse_access_log(lines: DataFrame) -> DataFrame:
    return accepted(parse(lines, "access_log"))


def parse_ad_click(lines: DataFrame) -> DataFrame:
    return accepted(parse(lines, "ad_click"))


def parse_login_event(lines: DataFrame) -> DataFrame:
    return accepted(parse(lines, "login"))


def parse_order_event(lines: DataFrame) -> DataFrame:
    return accepted(parse(lines, "order"))


def parse_receipt_event(lines: DataFrame) -> DataFrame:
    return accepted(parse(lines, "receipt"))


def read_events(spark: SparkSession, path: str, kind: str, streaming: bool = False) -> DataFrame:
    """Read a log of format ``kind`` and return its accepted, typed rows."""
    return accepted(parse(read_lines(spark, path, streaming), kind))


def format_lines(df: DataFrame, kind: str) -> DataFrame:
    """Render typed rows back to log lines (the inverse of :func:`parse`)."""
    fmt = FORMATS[kind]
    by_index = {f.index: f for f in fmt.fields}
    pieces = []
    for i in range(fmt.width):
        fld = by_index.get(i)
        if fld is None:
            pieces.append(F.lit("-"))
        elif fld.kind == "epoch_s":
            pieces.append(F.expr(
                f"CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{fld.name}`) AS STRING)"))
        elif fld.kind == "access_time":
            c = F.col(fld.name)
            pieces.append(F.format_string("%02d/%02d/%04d:%02d:%02d:%02d", F.dayofmonth(c), F.month(c), F.year(c),
                                          F.hour(c), F.minute(c), F.floor(F.second(c)).cast("int")))
        else:
            pieces.append(F.col(fld.name).cast("string"))
    # A null field stays an empty field; concat_ws alone would shift the fields behind it.
    return df.select(F.concat_ws(fmt.sep, *[F.coalesce(x, F.lit("")) for x in pieces]).alias("value"))
