"""Scalar expressions shared by the plans. All of them are built-in column expressions."""

from pyspark.sql import Column, functions as F

# Ranks compare scores at this many digits, so that two sums of the same terms
# taken in another order rank alike.
RANK_DIGITS = 9


def decay(now, then, alpha: float) -> Column:
    """exp(-alpha * (now - then)), the weight of a rating given ``now - then`` steps ago."""
    return F.exp(F.lit(-float(alpha)) * (_col(now) - _col(then)))


def pair_similarity(p, q_i, q_j) -> Column:
    """Adjusted cosine: P / (sqrt(Qi) sqrt(Qj)), 0 without a norm, 12 digits, within [-1, 1]."""
    norm = F.sqrt(_col(q_i)) * F.sqrt(_col(q_j))
    return clamp(F.when(norm != 0, _col(p) / norm).otherwise(F.lit(0.0)))


def clamp(sim) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), units(sim, 12) / F.lit(1e12)))


def units(value, digits: int) -> Column:
    """``value`` in whole units of the given decimal digit.

    Plain double arithmetic: ``round`` goes through big decimals, which costs more than
    the rest of a pair row.
    """
    return F.floor(_col(value) * F.lit(10.0**digits) + F.lit(0.5))


def rank_key(score) -> Column:
    """The value a descending rank sorts by, ascending."""
    return -units(score, RANK_DIGITS)


def majority_sign(positive, negative) -> Column:
    """+1 unless the negative votes outnumber the positive ones."""
    return F.when(_col(positive) >= _col(negative), F.lit(1)).otherwise(F.lit(-1))


def to_epoch(text, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.unix_timestamp(_col(text), pattern)


def from_epoch(seconds, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.from_unixtime(_col(seconds), pattern)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
