"""Slot hash of the one-hash bitmap used for unique-visitor counting.

slot(v) = (sum over the characters c_i of str(v) of ord(c_i) * seed^(n-1-i)) mod 2^bits,
i.e. the polynomial string hash ``h = h * seed + ord(c)`` masked to ``bits`` bits.
Masking at every step gives the same low bits as wrap-around 64-bit arithmetic.

For integer ids the hash is unrolled over the decimal digits into plain long
arithmetic (no higher-order function, so it stays in generated code); other
columns use ``aggregate`` over the characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .time import idiv

# Fixed values of the bitmap: polynomial seed and bitmap width (2^29 bits).
DEFAULT_SEED = 61
DEFAULT_BITS = 29

_MAX_DIGITS = 19  # decimal digits of the largest long


def slot_hash_string(c: Column, seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS) -> Column:
    """Slot of a string column, folding over its characters."""
    mod = 1 << bits
    chars = F.transform(F.split(c, ""), lambda ch: F.ascii(ch).cast("long"))
    # split(x, '') of an empty string yields [''] whose ascii is 0; drop it.
    chars = F.filter(chars, lambda x: x > 0)
    return F.aggregate(chars, F.lit(0).cast("long"),
                       lambda acc, x: F.pmod(acc * seed + x, F.lit(mod)))


def slot_hash_long(c: Column, seed: int = DEFAULT_SEED, bits: int = DEFAULT_BITS) -> Column:
    """Slot of a non-negative integer column via its decimal digits.

    Digit j (from the right) contributes (ord('0') + d_j) * seed^j.  Negative
    values fall back to the string form.
    """
    mod = 1 << bits
    v = c.cast("long")
    total = None
    for j in range(_MAX_DIGITS):
        weight = pow(seed, j, mod)
        digit = F.pmod(idiv(v, 10 ** j), F.lit(10))
        term = (digit + ord("0")) * F.lit(weight)
        if j > 0:
            term = F.when(v >= F.lit(10 ** j), term).otherwise(F.lit(0))
        total = term if total is None else total + term
    arithmetic = F.pmod(total, F.lit(mod))
    return F.when(v >= 0, arithmetic).otherwise(slot_hash_string(v.cast("string"), seed, bits))
