"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else becomes a blank, and all n-grams of 1 to 3 characters
hash into ``n_buckets`` counters.  Fitting counts them over a bounded, stratified sample of the
labelled rows (``per_language`` documents of each language, picked by a hash of the id); the
partial counts have a fixed size.  The log-probability matrix (languages x buckets, fixed size)
is broadcast, and texts are scored in numpy: a gather of each n-gram's row and a sum per text.

Edge cases: null texts and texts without any letter give ``und`` with score 0; so does every text
when there is no labelled row.  Ties go to the alphabetically first language.  Null ids are
never fitted on.  Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, small_batches, text_blocks

N_BUCKETS = 1 << 15
PER_LANGUAGE = 5000
SMOOTHING = 0.5
UNKNOWN = "und"

_CANON: list[np.ndarray] = []


def canon_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for what is no letter."""
    if not _CANON:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CANON.append(table)
    return _CANON[0]


def ngram_buckets(texts: list[str], n_buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the n-grams (n = 1, 2, 3) that start at each position of the texts laid end to
    end, two blanks behind each, and the positions where texts start and end by turns."""
    raw = "  ".join(texts) + "  "
    codes = canon_table()[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths + 2) - 2
    bounds = np.empty(2 * len(texts), dtype=np.int64)
    bounds[0::2], bounds[1::2] = ends - lengths, ends
    shift = np.uint32(32 - int(math.log2(n_buckets)))
    one = codes * np.uint32(0x9E3779B1)
    two = np.zeros_like(one)
    two[:-1] = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[1:]
    three = np.zeros_like(one)
    three[:-2] = (two[:-2] ^ (two[:-2] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + codes[2:]
    return [((x ^ (x >> np.uint32(16))) * np.uint32(0x9E3779B1)) >> shift
            for x in (one, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1))], bounds


def sample_rows(docs: DataFrame, per_language: int) -> DataFrame:
    """At most about ``per_language`` rows (doc_id, text, lang) of each language, by id hash."""
    counts = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        part = F.lit(True) if n <= per_language else \
            F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * per_language / n)
        keep = keep | ((F.col("lang") == lang) & part)
    return docs.filter(keep)


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, n_buckets: int = N_BUCKETS) -> dict:
    """Model from (doc_id, text, lang) rows: languages in order and their log-probability matrix."""
    small_batches(train.sparkSession)
    sample = sample_rows(train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
                         .select("doc_id", "text", "lang"), per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(as_text(batch.column(0)), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                total = totals.setdefault(lang, np.zeros(n_buckets, dtype=np.int64))
                for i, j in text_blocks(texts, 1 << 20):
                    grams, _ = ngram_buckets(texts[i:j], n_buckets)
                    for g in grams:
                        total += np.bincount(g, minlength=n_buckets)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.string()), pa.array([t.tobytes() for t in totals.values()], pa.binary())],
                names=["lang", "counts"])

    # A few partitions hold the bounded sample, so the driver adds up a few fixed-size vectors.
    parts = sample.select("text", "lang").repartition(8).mapInArrow(run, "lang string, counts binary").collect()
    totals: dict[str, np.ndarray] = {}
    for r in parts:
        totals[r.lang] = totals.get(r.lang, 0) + np.frombuffer(r.counts, dtype=np.int64)
    langs = sorted(totals)
    if not langs:
        return {"langs": [], "logp": np.zeros((0, n_buckets), dtype=np.float32)}
    counts = np.stack([totals[x] for x in langs]).astype(np.float64) + SMOOTHING
    return {"langs": langs, "logp": np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)}


def score_texts(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Index of the most likely language and its posterior probability, for each text."""
    logp = model["logp"]
    n_langs, n_buckets = logp.shape
    best, prob = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    for i, j in text_blocks(texts, 1 << 20):
        grams, bounds = ngram_buckets(texts[i:j], n_buckets)
        total = np.zeros((n_langs, j - i))
        for g in grams:
            for k in range(n_langs):
                total[k] += np.add.reduceat(logp[k][g], bounds, dtype=np.float64)[0::2]
        total -= total.max(axis=0)
        best[i:j] = total.argmax(axis=0)
        prob[i:j] = 1.0 / np.exp(total).sum(axis=0)
    return best, prob


def predictor(spark, model: dict, text: str = "text") -> Column:
    """Column of struct<lang_pred, score> for a text column; the fixed-size model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        langs = shared.value["langs"]
        for col in batches:
            texts = as_text(col)
            names = np.array([UNKNOWN] * len(texts), dtype=object)
            scores = np.zeros(len(texts))
            rows = [k for k, t in enumerate(texts) if any(unicodedata.category(c)[0] == "L" for c in t)]
            if langs and rows:
                best, prob = score_texts([texts[k] for k in rows], shared.value)
                names[rows], scores[rows] = np.array(langs, dtype=object)[best], prob
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["lang_pred", "score"])

    return run(F.col(text))


def identify(docs: DataFrame, train: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of ``docs``, by a model fitted on ``train``."""
    model = fit(train, per_language)
    return docs.select("doc_id", predictor(docs.sparkSession, model).alias("_p")) \
        .select("doc_id", F.col("_p.lang_pred").alias("lang_pred"), F.col("_p.score").alias("score"))
