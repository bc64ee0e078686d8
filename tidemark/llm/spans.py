"""Regular-expression spans with code-point positions, from built-in functions alone.

Positions come from ``split``: with limit -1 it returns the text between matches, so match k starts
behind the lengths of the gaps and matches before it.  All lengths are in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<start:long,end:long,order:int,kind:string,value:string>>"


@dataclass(frozen=True)
class Rule:
    """A kind of span.  ``pattern`` finds it, ``hint`` is a cheap necessary condition on the text, and
    ``keep`` drops failing matches (a condition on the matched value)."""

    kind: str
    version: int
    pattern: str
    hint: object
    keep: object


def matches(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule, leftmost and not overlapping, as an array of spans."""
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.char_length(x).cast("long"))
    values = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN_TYPE).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.char_length(x["value"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(order).alias("order"),
                        F.lit(rule.kind).alias("kind"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(rule.keep(x["value"]), F.concat(acc["out"], F.array(span)))
                        .otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(values)), values,
                       lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def find(text: Column, rule: Rule, order: int, wanted: Column | None = None) -> Column:
    """Spans of a rule; an empty array, without a regex pass, where the hint rules it out."""
    go = rule.hint(text) if wanted is None else wanted & rule.hint(text)
    return F.when(go, matches(text, rule, order)).otherwise(F.array().cast(SPAN_TYPE))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
