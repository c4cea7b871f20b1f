"""Explicit schemas of every relation."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()

RATINGS = _struct(user_id=_LONG, item_id=_LONG, rating=_DOUBLE, ts=_LONG)
VOTES = _struct(electee_id=_LONG, voter_id=_LONG, vote=_DOUBLE, ts=_LONG)

USER_RATINGS = _struct(user_id=_LONG, item_id=_LONG, rating=_DOUBLE, timestep=_LONG)
ITEM_INFO = _struct(item_id=_LONG, l=_DOUBLE, n=_LONG, q=_DOUBLE)
PAIR_INFO = _struct(item_i=_LONG, item_j=_LONG, l_i=_DOUBLE, l_j=_DOUBLE, p=_DOUBLE)

NEIGHBOR = _struct(neighbor_id=_LONG, sim=_DOUBLE)
RECOMMENDATION = _struct(item_id=_LONG, pred=_DOUBLE)
NEIGHBORS = _struct(item_id=_LONG, neighbors=T.ArrayType(NEIGHBOR))
RECOMMENDATIONS = _struct(user_id=_LONG, recommendations=T.ArrayType(RECOMMENDATION))

# The stored relations, the key that finds one row of each, and the columns it is looked
# up by. The short list of popular items has none: every version holds the whole list.
STATE = {
    "user_ratings": (USER_RATINGS, ("user_id", "item_id"), ("user_id",)),
    "item_info": (ITEM_INFO, ("item_id",), ("item_id",)),
    # Pairs lie by their first item: the few items of a batch open few buckets.
    "pair_info": (PAIR_INFO, ("item_i", "item_j"), ("item_i",)),
    "neighbors": (NEIGHBORS, ("item_id",), ("item_id",)),
    "recommendations": (RECOMMENDATIONS, ("user_id",), ("user_id",)),
    "popular": (_struct(item_id=_LONG, n=_LONG), (), ()),
}

# How often an item was in the longest lists of a user. Kept where repeats are capped.
COUNTERS = {
    "turns": (_struct(user_id=_LONG, item_id=_LONG, n=_LONG), ("user_id", "item_id"), ("user_id",)),
}

# The state of trust between voters after a batch of votes.
TRUST_STATE = {
    # The last vote of each voter on each electee, found by electee.
    "applied_votes": (_struct(voter_id=_LONG, electee_id=_LONG, vote=_DOUBLE), ("voter_id", "electee_id"), ("electee_id",)),
    "voter_norms": (_struct(voter_id=_LONG, q=_DOUBLE), ("voter_id",), ("voter_id",)),
    "voter_products": (_struct(voter_i=_LONG, voter_j=_LONG, p=_DOUBLE), ("voter_i", "voter_j"), ("voter_i",)),
}

_SEEN = {"batch": _LONG, "arrival": _LONG, "user_id": _LONG, "item_id": _LONG}
# What the serving loop notes of every batch.
LOGS = {
    "observations": _struct(**_SEEN, rating=_DOUBLE, ts=_LONG),
    "predictions": _struct(**_SEEN, rating=_DOUBLE, ts=_LONG, mean=_DOUBLE, pred=_DOUBLE),
    "messages": _struct(batch=_LONG, cutoff=_INT, arrival=_LONG, value=T.StringType()),
    "served": _struct(**_SEEN, rank=_INT),
    "metrics": _struct(batch=_LONG, phase=T.StringType(), started=_DOUBLE, ended=_DOUBLE, seconds=_DOUBLE, rows=_LONG),
}
