"""Personal data: fixed kinds, and bootstrapped contextual extraction.

Fixed kinds (email, ip, card, phone) are found by patterns and are the seed entities.  Bootstrapping
then learns where personal data stands:

* Occurrences: every seed, and every other identifier-like token (at least ``MIN_DIGITS`` digits),
  with the words before it.  Its lexical patterns are the two words before it, and the word before
  it alone where that is a label (it ends in ``:``, ``=`` or ``#``).
* The pattern-instance graph (pattern, instance, count) is aggregated over the corpus.  In each
  round a pattern's confidence is the share of its instances that are known, and it counts as
  reliable with ``MIN_CONFIDENCE`` and at least ``MIN_SUPPORT`` known instances; an unknown instance is
  accepted if the noisy-or of its reliable patterns reaches ``MIN_BELIEF``, and is known in the next round.
  Accepted instances only ever become more, and the rounds end when one accepts nothing new.
* Accepted instances become spans of kind ``context`` wherever they follow a reliable pattern.

All of it is DataFrame work: one pass over the texts, then joins and partial aggregations on patterns
and instances (a hot pattern costs one row a task before the shuffle); each round is written to the
shared folder.  No Python runs on the executors.

Edge cases: a null or empty text has no spans; repeated rows each get their spans and count as often
as they come; an empty table gives no rows; other columns are ignored, and kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save
from .spans import SPAN_TYPE, Rule, count_kind, find, joined

MIN_DIGITS = 4
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
MIN_BELIEF = 0.5
CONTEXT = "context"
#: Characters before an occurrence in which its context words are looked for first; where they hold less than two
#: whole words, all of the text before it is taken.
REACH = 120


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))

    def step(x: Column, i: Column) -> Column:
        n = x.cast("int") * (1 + i % 2)
        return F.when(n > 9, n - 9).otherwise(n)

    numbers = F.transform(F.filter(F.split(d, ""), lambda x: x != ""), step)
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x) % 10 == 0


_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Fixed patterns.  Possessive repeats and the conditions in front start a match where the plain
#: pattern would, and keep long runs linear.
RULES: tuple[Rule, ...] = (
    Rule("email", 1, rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
         lambda t: t.contains("@"), lambda v: F.lit(True)),
    Rule("ip", 1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
         lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    Rule("card", 1, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
         lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _luhn),
    Rule("phone", 1, r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"),
         lambda v: F.char_length(_digits(v)).between(8, 15)),
)
#: Identifier-like tokens.
CANDIDATE = Rule("candidate", 1, r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[./_#-]?[A-Za-z0-9])++",
                 lambda t: t.rlike(r"[0-9][^\s0-9]?[0-9][^\s0-9]?[0-9][^\s0-9]?[0-9]"),
                 lambda v: F.char_length(_digits(v)) >= MIN_DIGITS)


def base_spans(text: Column) -> Column:
    """Spans of the fixed kinds, by kind as listed, then start."""
    return F.concat(*[find(text, r, k) for k, r in enumerate(RULES)])


def _contexts(text: Column, start: Column) -> Column:
    """Lexical patterns of an occurrence that starts at ``start``."""
    def words_from(low: Column) -> Column:
        before = F.substring(text, (low + 1).cast("int"), (start - low).cast("int"))
        return F.filter(F.split(F.lower(before), r"\s+"), lambda w: F.regexp_replace(w, r"[\"'(\[{]+$", "") != "")

    low = F.greatest(start - REACH, F.lit(0).cast("long"))
    near = words_from(low)
    # The first word of the window may be cut.
    words = F.when((low == 0) | (F.size(near) > 2), near).otherwise(words_from(F.lit(0).cast("long")))
    n = F.size(words)
    two = F.when(n >= 2, F.concat_ws(" ", F.element_at(words, -2), F.element_at(words, -1)))
    one = F.when((n >= 1) & F.element_at(words, -1).rlike("[:=#]$"), F.element_at(words, -1))
    return F.array_compact(F.array(two, one))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, marks): fixed spans of each row, and every occurrence with its contexts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), text.alias("t")) \
        .withColumn("base", base_spans(F.col("t"))) \
        .withColumn("cand", find(F.col("t"), CANDIDATE, len(RULES)))
    free = F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    marks = F.transform(F.concat(F.col("base"), free), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), (s["kind"] != CANDIDATE.kind).alias("known"),
        F.lower(s["value"]).alias("instance"), _contexts(F.col("t"), s["start"]).alias("patterns")))
    return rows.select("doc_id", "text_key", "base", F.when(F.size("base") + F.size(free) > 0, marks).alias("marks"))


def bootstrap(found: DataFrame, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pattern) that are reliable and (instance) that they let in, when nothing new comes in (or after ``rounds``)."""
    spark = found.sparkSession
    graph = save(found.select(F.explode("marks").alias("m"))
                 .select(F.explode("m.patterns").alias("pattern"), "m.instance", "m.known")
                 .groupBy("pattern", "instance").agg(F.max("known").alias("known")), "pattern_graph")
    accepted = spark.createDataFrame([], "instance string")
    reliable = spark.createDataFrame([], "pattern string, confidence double")
    known = done = 0
    while rounds is None or done < rounds:
        marked = graph.join(accepted.withColumn("new", F.lit(True)), "instance", "left") \
            .withColumn("is_known", (F.col("known") | F.coalesce("new", F.lit(False))).cast("long"))
        scores = marked.groupBy("pattern").agg(F.sum("is_known").alias("hits"), F.count("*").alias("n"))
        reliable = save(scores.withColumn("confidence", F.col("hits") / F.col("n"))
                        .filter((F.col("hits") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
                        .select("pattern", "confidence"), "reliable_patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        accepted = save(graph.filter(~F.col("known")).join(reliable, "pattern").groupBy("instance")
                        .agg((1 - doubt).alias("belief")).filter(F.col("belief") >= MIN_BELIEF)
                        .select("instance"), "accepted_instances")
        done, before, known = done + 1, known, accepted.count()
        if known == before:
            break
    return reliable.select("pattern"), accepted


def find_personal_data(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(doc_id, text_key, base, extra) of every row: fixed spans, and the spans that contexts add."""
    found = save(occurrences(docs), "occurrences")
    patterns, instances = bootstrap(found, rounds)
    hits = (found.filter("marks is not null").select("doc_id", "text_key", F.explode("marks").alias("m"))
            .filter(~F.col("m.known")).select("doc_id", "text_key", "m.*")
            .join(instances, "instance", "left_semi")
            .withColumn("pattern", F.explode("patterns")).join(patterns, "pattern", "left_semi")
            .select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_null"),
                    "text_key", "start", "end").distinct()
            .groupBy("_id", "_null", "text_key")
            .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("extra")))
    keyed = found.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_null", F.col("doc_id").isNull())
    extra = F.transform("extra", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(len(RULES)).alias("order"),
        F.lit(CONTEXT).alias("kind"), F.lit("").alias("value")))
    return keyed.join(hits, ["_id", "_null", "text_key"], "left").select(
        "doc_id", "text_key", "base", F.coalesce(extra, F.array().cast(SPAN_TYPE)).alias("extra"))


def summarise(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, their digest, and the list of all spans of each row."""
    base = joined(F.col("base"))
    return found.select("doc_id", *[count_kind(F.col("base"), r.kind).alias(f"n_{r.kind}") for r in RULES],
                        F.sha2(base, 256).alias("base_sha256"),
                        joined(F.concat("base", "extra")).alias("spans"))


def redact(docs: DataFrame, rounds: int | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets (``n_chars``, if there, follows).

    Of overlapping spans the one that starts first (then the longer one) is replaced, and the rest of the
    other with it.  Rows without spans, and null texts, stay as they are."""
    found = find_personal_data(docs, rounds).filter((F.size("base") > 0) | (F.size("extra") > 0))
    keys = ["__tm_id", "__tm_null", "__tm_key"]
    spans = found.select(
        F.coalesce("doc_id", F.lit(0)).alias(keys[0]), F.col("doc_id").isNull().alias(keys[1]),
        F.col("text_key").alias(keys[2]), F.array_sort(F.transform(F.concat("base", "extra"), lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("minus_end"), s["kind"].alias("kind")))).alias("__tm_spans")
    ).dropDuplicates(keys)
    rows = docs.withColumns({keys[0]: F.coalesce("doc_id", F.lit(0)), keys[1]: F.col("doc_id").isNull(),
                             keys[2]: F.xxhash64("text")}).join(spans, keys, "left")
    text, start = F.col("text"), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        end = -s["minus_end"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return (F.when(s["start"] >= acc["at"], F.struct(
                    end.alias("at"), F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out")))
                .otherwise(F.struct(F.greatest(acc["at"], end).alias("at"), acc["out"].alias("out"))))

    new = F.aggregate("__tm_spans", start, cut, lambda acc: F.concat(
        acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    out = rows.withColumn("text", F.when(F.col("__tm_spans").isNull(), text).otherwise(new))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__tm_spans").isNull(), F.col("n_chars"))
                             .otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
