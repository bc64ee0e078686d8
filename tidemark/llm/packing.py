"""Sequence packing: first-fit decreasing with a tournament tree, in random groups of documents.

Each text becomes token ids plus an end id and is cut into pieces of at most ``capacity`` ids.
Full pieces are sequences of their own.  The rest is dealt at random into groups of about
``group_size`` pieces, and each group is packed on its own (one task per group, so the work
scales out and a group has a fixed size whatever the corpus has).  Within a group, pieces go
longest first into the first bin with room; a tournament tree over the bins, whose nodes hold
the largest room below them, finds that bin in O(log n).

Token ids are made in one map pass by the rank file of the tokenizer's vocabulary; they equal
those of ``tokenizers`` on the whole text (tested).

Edge cases: a null or empty text has the end id alone; repeated rows are packed as often as they
come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, save, small_batches

CAPACITY = 2048
END_ID = 1
GROUP_SIZE = 8192
VOCABULARY = "byte_bpe_50k"
#: Characters of white space in a row that are safe with the rank file (it fails at about a million).
SAFE_SPACE = 100_000
LONG_SPACE = re.compile(r"\S\s{%d}|^\s{%d}" % (SAFE_SPACE, SAFE_SPACE))

PIECE_SCHEMA = "piece long, doc_id long, start long, length long, doc_tokens long, ids binary"


class Encoder:
    """Token ids of whole texts.  The rank file has the vocabulary of the tokenizer file and is several
    times faster; texts that spell a special token, or have more white space in a row than its pattern
    matcher has stack for, go to the tokenizer itself, loaded when one comes."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import public_tokenizers as P
        import tiktoken

        self.path = P.path(f"{vocabulary}.json")
        with open(self.path) as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding(vocabulary, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.exact = None

    def encode(self, text: str) -> list[int]:
        if not any(s in text for s in self.special) and not (len(text) > SAFE_SPACE and LONG_SPACE.search(text)):
            return self.plain.encode_ordinary(text)
        if self.exact is None:
            from tokenizers import Tokenizer
            self.exact = Tokenizer.from_file(self.path)
        return self.exact.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder (loaded once per Python worker)."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
               end_id: int = END_ID) -> DataFrame:
    """Pieces of every document with their ids (little-endian unsigned 32-bit): one map pass, no shuffle."""
    schema = pa.schema([("piece", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()),
                        ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, piece = encoder(vocabulary), TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), as_text(batch.column(1))):
                ids = np.array([*enc.encode(text), end_id], dtype="<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start:start + capacity]
                    rows.append((piece, doc_id, start, len(part), len(ids), part.tobytes()))
                    piece += 1
                held += ids.nbytes
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                                     schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                                 schema=schema)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE_SCHEMA)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length.  ``room[1]`` is the tree's root, leaves are bins from left to right."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for k in sorted(range(n), key=lambda k: -lengths[k]):
        need, node = lengths[k], 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[k], offsets[k] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces that has ``piece`` (unique) and ``length``.

    Full pieces get odd sequence ids without any shuffle; bins get even ones.  The group of a
    piece is a seeded hash of its number, so a task that runs again makes the same groups.
    """
    if not pieces.schema["length"].dataType.typeName() == "long":
        pieces = pieces.withColumn("length", F.col("length").cast("long"))
    full = pieces.filter(F.col("length") >= capacity) \
        .withColumn("sequence_id", F.col("piece") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_size))
    schema = full.schema

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        table = table.drop_columns(["_group"])
        table = table.append_column("sequence_id", pa.array([2 * ((group << 24) + b) for b in bins], pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64()))

    packed = (short.withColumn("_group", F.pmod(F.xxhash64("piece", F.lit(seed)), F.lit(groups)))
              .groupBy("_group").applyInArrow(run, schema))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
                   end_id: int = END_ID) -> DataFrame:
    """Placement of every piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The ids are digested where they are made; the table of pieces is written once, so tokenising
    never runs again.  :func:`sequences` gives the ids of whole sequences.
    """
    pieces = cut_pieces(docs, capacity, vocabulary, end_id)
    digests = save(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return pack(digests, capacity).drop("piece")


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY,
              end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """Training sequences: (sequence_id, input_ids, length), padded to ``capacity``.

    A sequence has at most ``capacity`` ids, so the grouping by sequence is bounded."""
    packed = pack(save(cut_pieces(docs, capacity, vocabulary, end_id), "pieces"), capacity)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), dtype="<u4")
        padded = np.concatenate([ids, np.full(capacity - len(ids), pad_id, dtype="<u4")]).astype(np.int32)
        return pa.table({"sequence_id": [key[0].as_py()], "input_ids": pa.array([padded], pa.list_(pa.int32())),
                         "length": pa.array([len(ids)], pa.int32())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(
        run, "sequence_id long, input_ids array<int>, length int")
