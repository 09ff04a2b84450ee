"""Rarity weights of character pairs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequency ranks of pairs; rarer pairs weigh more.
FREQUENCY = {
    "th": 980000, "he": 970000, "in": 960000, "er": 950000, "re": 740000, "on": 930000, "an": 920000, "st": 910000,
    "at": 900000, "en": 890000, "nd": 880000, "ti": 870000, "es": 860000, "or": 850000, "te": 840000, "of": 830000,
    "ed": 820000, "is": 810000, "it": 800000, "al": 790000, "ar": 780000, "nt": 770000, "co": 760000, "de": 750000,
    "ng": 730000, "se": 570000, "le": 710000, "io": 700000, "cl": 690000, "as": 680000, "fu": 670000, "nc": 660000,
    "ct": 650000, "va": 640000, "ri": 630000, "ab": 620000, "pr": 610000, "op": 600000, "if": 590000, "el": 580000,
    "wh": 560000, "il": 550000, "fo": 540000, "rt": 480000, "ex": 520000, "po": 490000, "im": 500000, "=>": 470000,
    "()": 460000, "{}": 450000, "[]": 440000, "::": 430000, "==": 420000, "!=": 410000, "&&": 400000, "||": 390000,
    "->": 380000, "__": 370000, "//": 360000, "/*": 350000, "*/": 340000, "  ": 330000, "\n ": 320000,
}
# The scale of the ranks and the weight of pairs without one.
SCALE, UNRANKED, SYMBOL_BONUS, FIRST, SECOND, SPREAD = 1_000_000, 400_000, 50_000, 131, 17, 350_000


def _alnum(c: np.ndarray) -> np.ndarray:
    return ((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122))


def _unranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    symbol = ~(_alnum(a) & _alnum(b))
    return UNRANKED + SYMBOL_BONUS * symbol + (a * FIRST + b * SECOND) % SPREAD


@lru_cache(maxsize=1)
def _ascii_table() -> np.ndarray:
    codes = np.arange(128, dtype=np.int64)
    table = _unranked(codes[:, None], codes[None, :])
    for pair, n in FREQUENCY.items():
        table[ord(pair[0]), ord(pair[1])] = max(1, SCALE - n)
    return table


def pair_weights(codes: np.ndarray) -> np.ndarray:
    """Weights of the adjacent pairs of a sequence of code points."""
    a, b = codes[:-1].astype(np.int64), codes[1:].astype(np.int64)
    out = _unranked(a, b)
    plain = (a < 128) & (b < 128)
    out[plain] = _ascii_table()[a[plain], b[plain]]
    return out


def weight_column(pair: Column) -> Column:
    """Weight of a two-character string column."""
    table = F.create_map(*[x for p, n in FREQUENCY.items() for x in (F.lit(p), F.lit(max(1, SCALE - n)))])
    a, b = F.ascii(F.substring(pair, 1, 1)), F.ascii(F.substring(pair, 2, 1))
    rest = F.lit(UNRANKED) + F.when(pair.rlike("[^a-zA-Z0-9]"), SYMBOL_BONUS).otherwise(0) + (a * FIRST + b * SECOND) % SPREAD
    return F.coalesce(F.try_element_at(table, pair), rest)
