"""Small documents tables for the operators: nulls, empty and long texts, repeats, clashing columns."""

import random

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, fp long, score double, spans string, _n int"


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary):03d}" for _ in range(n))


def awkward(seed=0):
    """(doc_id, text) rows: plain, copies, repeated rows, nulls in either column, white space, a long text."""
    rnd = random.Random(seed)
    base = [words(rnd, rnd.randrange(1, 60)) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + k, base[k]) for k in range(5)]                       # copies under other ids
    rows += [(3, base[3]), (3, base[3])]                                 # the same row again
    rows += [(4, base[7])]                                               # an id used twice
    rows += [(None, base[1]), (None, base[1]), (None, None)]
    rows += [(200, None), (201, ""), (202, " \t\n "), (203, "ÄÖ é 日本 🙂  x")]
    rows += [(204, words(rnd, 6000))]
    return rows


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    """The same rows with the columns of ``documents`` and some that operators use themselves."""
    return spark.createDataFrame([(d, t, "en", None, None, 7, None, "x", 3) for d, t in rows], CLASHING)
