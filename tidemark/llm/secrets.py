"""Secret scans over an incremental blob ledger.

Versions of files (here: documents) are content-addressed: a version names the blob that holds
its text (SHA-256).  The ledger, a parquet table in a folder of its own, has one entry for each
scan of a blob: its address, the rule versions that were run, and what they found.  A scan

1. lists the distinct addresses of the versions and subtracts the (blob, rule version) pairs that
   the ledger has, without a text;
2. runs the pending rules on each unseen blob once, and appends the entries (one atomic write).  Only texts of
   pending blobs are moved; where nothing is pending, no text is;
3. joins the findings of the wanted rule versions back to all versions.

A second scan with the same rules scans no text twice; a new version of one rule runs that rule
alone.  The ledger says where a secret is and of what kind, and never holds the secret itself.  Everything is built-in functions: no Python runs on the executors.

Equal blobs are reduced to one in the map tasks before the shuffle, so a hot blob costs one row a
task; joining findings back moves (version, address) rows, never texts.

Edge cases: a null text is the empty blob; repeated rows are versions of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save, scratch_path
from .spans import Rule, count_kind, find, joined

#: Fixed patterns.  Runs are maximal, so a least length in the pattern drops the same matches as a
#: check behind it; the value of an assignment is checked behind it.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, ASSIGN,
         lambda t: t.rlike(r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
         lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 2)) >= 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", lambda t: t.contains("AKIA"), lambda v: F.lit(True)),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{32,}", lambda t: t.rlike(r"(?<![0-9a-f])[0-9a-f]{32}"), lambda v: F.lit(True)),
)

#: Places and kinds only.
PLACE_TYPE = "array<struct<start:long,order:int,end:long,kind:string>>"
ENTRY_SCHEMA = f"blob binary, rules array<string>, spans {PLACE_TYPE}"


def rule_name(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def address(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def read_ledger(spark, path: str) -> DataFrame | None:
    """Entries of a ledger, or None where none was written yet."""
    try:
        return spark.read.schema(ENTRY_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in (e.getCondition() or ""):
            return None
        raise


def pending_pairs(addresses: DataFrame, ledger: DataFrame | None, names: Sequence[str]) -> DataFrame:
    """(blob, pending): distinct addresses with the rule versions that the ledger has not run on them."""
    wanted = F.array(*[F.lit(n) for n in names])
    blobs = addresses.select("blob").distinct()
    if ledger is None:
        return blobs.withColumn("pending", wanted)
    done = ledger.select("blob", F.explode("rules").alias("rule")).filter(F.col("rule").isin(list(names)))
    known = done.groupBy("blob").agg(F.collect_set("rule").alias("known"))   # at most one entry a rule
    return (blobs.join(known, "blob", "left")
            .withColumn("pending", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))))
            .filter(F.size("pending") > 0).drop("known"))


def pending_texts(docs: DataFrame, pending: DataFrame, everything: bool) -> DataFrame:
    """(blob, text, pending): one text of each pending blob.  ``everything``: all blobs of ``docs`` are pending."""
    texts = docs.select(address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if everything:  # copies meet in the map tasks, and the join finds the rows dealt already
        return texts.groupBy("blob").agg(F.first("text").alias("text")).join(pending, "blob")
    return texts.join(pending, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger entries of blobs: the rules run and the places of what they found."""
    parts = [find(F.col("text"), r, k, F.array_contains("pending", rule_name(r))) for k, r in enumerate(rules)]
    places = F.transform(F.concat(*parts), lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"]))
    return blobs.select("blob", F.col("pending").alias("rules"), places.alias("spans"))


def scan_versions(docs: DataFrame, ledger_path: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``; spans are sorted by start, then rule.

    Unseen (blob, rule version) pairs are scanned and added to the ledger at ``ledger_path``
    (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    path = ledger_path or scratch_path(spark, "blob_ledger")
    names = [rule_name(r) for r in rules]
    versions = save(docs.select("doc_id", address().alias("blob")), "versions")
    ledger = read_ledger(spark, path)
    pending = save(pending_pairs(versions, ledger, names), "pending")
    todo = pending.count()
    if todo or ledger is None:
        everything = ledger is None or todo == versions.select("blob").distinct().count()
        scan_blobs(pending_texts(docs, pending, everything), rules).write.mode("append").parquet(path)

    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(k))])
    found = (read_ledger(spark, path).filter(F.size("spans") > 0)
             .select("blob", F.arrays_overlap("rules", F.array(*[F.lit(n) for n in names])).alias("_ours"), "spans")
             .filter("_ours").groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    ordered = F.array_sort(F.array_distinct(F.transform(
        F.filter("spans", lambda s: rank[s["kind"]].isNotNull()),
        lambda s: F.struct(s["start"], rank[s["kind"]].alias("order"), s["end"], s["kind"]))))
    return versions.join(found.select("blob", ordered.alias("spans")), "blob", "left") \
        .select("doc_id", F.col("spans").alias("spans"))


def summarise(findings: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of each row."""
    spans = F.coalesce("spans", F.array().cast(PLACE_TYPE))
    rows = findings.select("doc_id", spans.alias("s"))
    text = joined(F.col("s"))
    return rows.select("doc_id", *[count_kind(F.col("s"), r.kind).alias(f"n_{r.kind}") for r in RULES],
                       F.sha2(text, 256).alias("base_sha256"), text.alias("spans"))
