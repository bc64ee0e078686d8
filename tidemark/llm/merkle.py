"""Merkle manifest of a data set: a content-addressed DAG with membership proofs.

Leaves are hashes of rows.  Inside a group (here: a language) they ascend by an order, and while
several nodes remain, every two consecutive ones become their hash (a last single one, too).  What
remains is the group's *subroot*; the subroots in the order of the groups give the *root* likewise.

* Ranks.  Rows are range-partitioned by (group, order, row number), so a hot group spans many
  tasks; places inside a partition plus the offsets of the partitions before it are the ranks.
* Records.  The binary tree is stored in *segments* of ``HEIGHT`` levels: a record maps the digest
  of a segment's top to its children, level by level, down to the at most 2^HEIGHT digests of the
  next segments.  Records are content-addressed: equal subtrees are stored once.  A segment is
  one row, so no task ever holds more than 2^HEIGHT digests of a group at once.
* Descent.  Requests for leaves go down from the root by the digits of their ranks (HEIGHT bits a
  digit).  All requests that share their leading digits travel as one, with one path; each join
  with the records takes one digit, collects the unselected children on its way, and at the last
  digit the request's own leaves are looked up inside the record.  Segments of a path are collected
  from the top, so a path is reversed at the end.

Everything is built-in functions.  Texts are hashed where they are read and never move; the
shuffles carry digests.  Every step is a table in the shared folder, so a lost executor costs a reread.

Edge cases: nulls in any column have their own mark in the leaf and null languages and ids come
first; an empty text differs from a null one; rows equal in id ascend by digest, and equal rows are
leaves of their own; a lone leaf is its group's subroot, and a lone subroot is the root; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_crc, save

#: Levels of the binary tree in one record, and bits of one rank digit.
HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<sibling:string,left:boolean>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field_mark(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest(F.concat(*[field_mark(c) for c in fields]))


def number(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``rank`` (long, from 0) of each row in its group and ``members``, the size of the group.

    ``order`` must end in a column that is unique, so that no range is hotter than others."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = save(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                  .withColumn("_at", F.monotonically_increasing_id()), "placed")
    # One row for each partition and group in it.
    runs = placed.groupBy(F.col(group), F.shiftright("_at", 33).alias("_part")) \
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part")
    runs = runs.select(
        F.col(group).alias("_group"), "_part", "_first",
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(group)).alias("members"))
    return (placed.withColumn("_part", F.shiftright("_at", 33))
            .join(runs.withColumnRenamed("_part", "_run"),
                  F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_run")))
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_offset"))
            .drop("_at", "_part", "_run", "_group", "_first", "_offset"))


def tree_height(members: Column) -> Column:
    """Levels above the leaves: the least h with 2^h >= members."""
    return F.when(members <= 1, 0).otherwise(F.length(F.bin(members - 1))).cast("int")


def fold_levels(nodes: Column, height: Column) -> Column:
    """Levels of a segment from its lowest nodes up: array of arrays of digests."""
    def above(level: Column) -> Column:
        half = F.ceil(F.size(level) / 2).cast("int")
        return F.transform(F.sequence(F.lit(1), half), lambda i: digest(
            F.concat(F.element_at(level, 2 * i - 1), F.coalesce(F.get(level, 2 * i - 1), F.lit("")))))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(nodes), lambda acc, _: F.concat(acc, F.array(above(F.element_at(acc, -1)))))


def build_tree(nodes: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """Segments of all groups, a table for each layer from the leaves up, and (group, members, top).

    ``nodes``: (group, rank, digest, members).  A segment: (group, place, top, levels)."""
    layers: list[DataFrame] = []
    tops: DataFrame | None = None
    layer, size = 0, 1 << HEIGHT
    while True:
        tall = F.least(F.lit(HEIGHT), tree_height(F.col("members")) - layer * HEIGHT)
        grouped = (nodes.groupBy(group, F.shiftright("rank", HEIGHT).alias("place"))
                   .agg(F.first("members").alias("members"),
                        F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"]).alias("nodes")))
        segments = save(grouped.withColumn("levels", fold_levels(F.col("nodes"), tall))
                        .select(group, "place", "members", F.element_at(F.element_at("levels", -1), 1).alias("top"), "levels"),
                        f"segments-{layer}")
        layers.append(segments)
        done = tree_height(F.col("members")) <= (layer + 1) * HEIGHT
        found = segments.filter(done).select(group, "members", "top")
        tops = found if tops is None else tops.union(found)
        nodes = segments.filter(~done).select(group, F.col("place").alias("rank"), F.col("top").alias("digest"), "members")
        layer += 1
        if not nodes.limit(1).count():
            return layers, tops


def records(layers: Sequence[DataFrame]) -> DataFrame:
    """The store: digest -> levels of children, each digest once."""
    out = None
    for x in layers:
        part = x.select(F.col("top").alias("digest"), "levels")
        out = part if out is None else out.union(part)
    return out.groupBy("digest").agg(F.first("levels").alias("levels"))


def unselected(levels: Column, digit: Column) -> Column:
    """Steps of one digit from a segment's top down: the child not taken on each level (null where a
    node has one child), and whether it stands left of the taken one."""
    def step(k: Column) -> Column:
        at = F.call_function("shiftright", digit, k).cast("int")  # the taken node of level k
        left = at.bitwiseAND(F.lit(1)) == 1
        return F.struct(F.get(F.element_at(levels, k + 1), F.when(left, at - 1).otherwise(at + 1)).alias("sibling"),
                        left.alias("left"))

    below = F.size(levels) - 2
    return F.when(below >= 0, F.transform(F.sequence(below, F.lit(0), F.lit(-1)), step)) \
        .otherwise(F.array().cast(f"array<{STEP}>"))


def descend(layers: Sequence[DataFrame], wanted: DataFrame, start: DataFrame, group: str, payload: Sequence[str]) -> DataFrame:
    """Paths of the wanted leaves: ``wanted`` (group, rank, payload...) with the found ``leaf`` digest and ``path``
    (steps from the top down, those of ``start`` first).

    ``start``: (group, members, digest, path), one row a group.  Groups whose top is below a layer join at their own."""
    store = records(layers)
    g = F.col(group)
    frontier = start.select(group, "members", F.lit(0).cast("long").alias("place"), "digest", "path")
    for layer in range(len(layers) - 1, 0, -1):
        here = tree_height(F.col("members")) > layer * HEIGHT
        digits = (wanted.select(g.alias("_g"), F.shiftright("rank", layer * HEIGHT).alias("_child")).distinct()
                  .groupBy("_g", F.shiftright("_child", HEIGHT).alias("_place"))
                  .agg(F.collect_list(F.col("_child").bitwiseAND(F.lit((1 << HEIGHT) - 1)).cast("int")).alias("_digits")))
        down = (frontier.filter(here)
                .join(digits, g.eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_place")))
                .join(store, "digest")
                .select(group, "members", "place", "path", "levels", F.explode("_digits").alias("_d"))
                .select(group, "members", (F.shiftleft("place", HEIGHT) + F.col("_d")).alias("place"),
                        F.get(F.element_at("levels", 1), F.col("_d")).alias("digest"),
                        F.concat("path", unselected(F.col("levels"), F.col("_d"))).alias("path")))
        frontier = save(down.union(frontier.filter(~here)), f"frontier-{layer}")
    asked = (wanted.groupBy(g.alias("_g"), F.shiftright("rank", HEIGHT).alias("_place"))
             .agg(F.collect_list(F.struct(F.col("rank").bitwiseAND(F.lit((1 << HEIGHT) - 1)).cast("int").alias("digit"),
                                          *payload)).alias("_asked")))
    found = (frontier.join(asked, g.eqNullSafe(F.col("_g")) & (F.col("place") == F.col("_place")))
             .join(store, "digest"))
    each = F.transform("_asked", lambda a: F.struct(
        *[a[c].alias(c) for c in payload], F.get(F.element_at(F.col("levels"), 1), a["digit"]).alias("leaf"),
        unselected(F.col("levels"), a["digit"]).alias("tail")))
    return (found.select(group, "path", F.explode(each).alias("_a"))
            .select(group, *[F.col(f"_a.{c}") for c in payload], F.col("_a.leaf").alias("leaf"),
                    F.concat("path", "_a.tail").alias("path")))


def fold_path(leaf: Column, path: Column) -> Column:
    """Root recomputed from a leaf and its path (steps from the leaf up)."""
    return F.aggregate(path, leaf, lambda acc, s: digest(
        F.when(s["left"], F.concat(s["sibling"], acc)).otherwise(F.concat(acc, F.coalesce(s["sibling"], F.lit(""))))))


def manifest(docs: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame], DataFrame]:
    """Leaves with ranks, the segments of the group trees, the subroots, and the segments and top of the tree over them."""
    c = {f: F.col(f) for f in FIELDS}
    changed = F.coalesce(id_crc() % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    leaves = save(docs.select(
        "doc_id", "lang", leaf_digest([c[f] for f in FIELDS]).alias("digest"),
        F.when(changed, leaf_digest([c[f] + 1 if f == "n_chars" else c[f] for f in FIELDS])).alias("tampered"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    ranked = save(number(leaves, "lang", ("doc_id", "digest", "row")), "ranked")
    layers, tops = build_tree(ranked.select("lang", "rank", "digest", "members"), "lang")
    subroots = save(number(tops.select(F.lit(0).alias("all"), "lang", F.col("members").alias("leaves"), F.col("top").alias("digest")),
                           "all", ("lang",)), "subroots")
    upper, top = build_tree(subroots.select("all", "rank", "digest", "members"), "all")
    return ranked, layers, subroots, upper, top


def prove(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, subroot, root, path, tampered) of every row; ``path`` has the steps from the leaf up,
    ``tampered`` the digest of the row with one more in n_chars (null where it is not tampered)."""
    ranked, layers, subroots, upper, top = manifest(docs)
    none = F.array().cast(f"array<{STEP}>")
    start = top.select("all", "members", F.col("top").alias("digest"), none.alias("path"))
    langs = save(descend(upper, subroots, start, "all", ("lang", "leaves"))
                 .join(top.select("all", F.col("top").alias("root")), "all")
                 .select("lang", F.col("leaves").alias("members"), F.col("leaf").alias("digest"), "path", "root"), "langs")
    rows = descend(layers, ranked, langs.drop("root"), "lang", ("doc_id", "tampered"))
    ends = langs.select(F.col("lang").alias("_lang"), F.col("digest").alias("subroot"), "root")
    return (rows.join(ends, F.col("lang").eqNullSafe(F.col("_lang")))
            .select("doc_id", "lang", "leaf", "subroot", "root", F.reverse("path").alias("path"), "tampered"))


def audit(proofs: DataFrame) -> DataFrame:
    """Digest of each proof, and the root folded from the tampered (else the original) leaf."""
    siblings = F.transform(F.filter("path", lambda s: s["sibling"].isNotNull()), lambda s: s["sibling"])
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", digest(F.array_join(siblings, "")).alias("proof_sha256"),
        fold_path(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))
