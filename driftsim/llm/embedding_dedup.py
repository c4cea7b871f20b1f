"""Near-duplicate vectors by int8 tile products with exact error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from driftsim.llm.components import components
from driftsim.session import durable

COSINE = 0.95
#: Vectors of a tile, and at most so many centres of cells.
TILE, CENTRES = 4096, 512
#: Rows of a tile multiplied at once.
STRIP = 1024
#: Below this many components products of int8 values are whole in single precision.
EXACT_WIDTH = (1 << 24) // (127 * 127)
_SLACK = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that no square of it is too large or too small.

    Angles stay as they are, to the last bit.
    """
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, length of the quantised vector and of the error, by row."""
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    near = whole * scale[:, None]
    return whole, scale, np.linalg.norm(near, axis=1), np.linalg.norm(unit - near, axis=1)


def close_pairs(a: np.ndarray, b: np.ndarray, cosine: float, same: bool):
    """Strips of index pairs of rows of ``a`` and ``b`` with at least the cosine.

    With unit vectors x = x' + e and y = y' + f (x', y' quantised) the product x.y differs
    from x'.y' by at most |e| + |x'||f|. Pairs whose product and bound stay below the
    threshold are out; the others are computed from the vectors in double precision.
    ``same``: the two are one tile, and only pairs of a smaller and a larger index count.
    """
    lengths = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ua, ub = a / lengths[0][:, None], b / lengths[1][:, None]
    qa, sa, na, ea = quantise(ua)
    qb, sb, _, eb = quantise(ub)
    kind = np.float32 if a.shape[1] <= EXACT_WIDTH else np.float64
    right = qb.astype(kind).T
    for lo in range(0, len(a), STRIP):
        part = slice(lo, lo + STRIP)
        product = qa[part].astype(kind) @ right
        # In single precision with room for its rounding; far below the quantisation error.
        bar = (cosine - ea[part][:, None] - na[part][:, None] * eb[None, :].max() - 1e-5) / (sa[part][:, None] * sb.max() + 1e-300)
        i, j = np.nonzero(product >= bar.astype(kind))
        i += lo
        exact = sa[i] * sb[j] * product[i - lo, j].astype(np.float64) + ea[i] + na[i] * eb[j] >= cosine - _SLACK
        if same:
            exact &= i < j
        i, j = i[exact], j[exact]
        for k in range(0, len(i), 1 << 18):
            x, y = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            true = np.einsum("ij,ij->i", a[x], b[y]) / (lengths[0][x] * lengths[1][y]) >= cosine
            yield x[true], y[true]


def _tile_links(group: pd.DataFrame) -> pd.DataFrame:
    """(node, links, root) of the vectors of a pair of tiles that are linked within it."""
    left, right = group[group["side"] == 0], group[group["side"] == 1]
    same = right.empty
    if same:
        right = left
    if left.empty:
        return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
    a, b = (scaled(np.stack(side["vector"]).astype(np.float64)) for side in (left, right))
    nodes = left["node"].to_numpy() if same else np.concatenate([left["node"].to_numpy(), right["node"].to_numpy()])
    times = left["times"].to_numpy() if same else np.concatenate([left["times"].to_numpy(), right["times"].to_numpy()])
    shift = 0 if same else len(left)
    links = np.zeros(len(nodes), np.int64)
    root = np.arange(len(nodes))
    for i, j in close_pairs(a, b, COSINE, same):
        j = j + shift
        np.add.at(links, i, times[j])
        np.add.at(links, j, times[i])
        # Join the classes of both ends: all hang on the smallest root around.
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            if (before == root).all():
                break
    some = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[some], "links": links[some], "root": nodes[root[some]]})


def _finite() -> Column:
    return F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)


def embedding_links(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding).

    Rows link at a cosine of COSINE or more, in double precision; a vector links to other
    rows only. A vector that is null, empty or zero, or holds a null or non-finite
    component, links with nothing and is its own component; vectors of different lengths
    do not link. Equal vectors are one class with a count, so copies are never paired. A
    class gets a cell, that of the nearest of some centres; a cell is cut into tiles of
    about TILE classes, and two tiles meet in one task unless the angle between their
    centres and their widest angles rule out a link. The centres come from the data, their
    number follows it up to CENTRES. A task returns a row per linked vector, never the
    pairs. A null vec_id counts as a link and is never a component's name unless alone.
    """
    spark = vectors.sparkSession
    good = vectors.filter(_finite()).select("vec_id", "embedding")
    classes = durable(
        good.groupBy("embedding")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
        .select(F.monotonically_increasing_id().alias("node"), "least", "times", F.col("embedding").cast("array<double>").alias("vector"), "embedding")
    )
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    parts = [_width_links(classes.filter(F.size("vector") == d).select("node", "times", "vector"), d, n) for d, n in sorted(sizes.items())]
    found = spark.createDataFrame([], "node long, links long, root long")
    for part in parts:
        found = found.unionByName(part)
    found = durable(found)
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    totals = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "least", "times", "embedding").join(totals, "node", "left").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = durable(named)
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    classed = named.join(names, "root").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "component")
    whole = vectors.select("vec_id", F.when(_finite(), F.col("embedding")).alias("embedding"))
    lone = whole.filter("embedding is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = (
        whole.filter("embedding is not null")
        .join(classed, "embedding")
        .select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    )
    return linked.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _width_links(classes: DataFrame, width: int, n: int) -> DataFrame:
    """(node, links, root) within tiles, for the classes of one vector length."""
    tile = max(64, min(TILE, (1 << 22) // width))
    want = min(CENTRES, -(-n // tile))
    # A bounded sample; the centres decide what is compared first, never what is found.
    drawn = classes.orderBy(F.xxhash64("vector"), "node").limit(want).select("vector").collect()
    centres = scaled(np.array([r["vector"] for r in drawn]))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)

    def place(batches):
        for batch in batches:
            x = scaled(np.stack(batch["vector"].to_numpy()))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = x @ centres.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
            yield batch.assign(cell=cell.astype(np.int32), angle=angle)

    placed = durable(classes.mapInPandas(place, "node long, times long, vector array<double>, cell int, angle double"))
    cells = {r["cell"]: (r["n"], r["widest"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()}
    between = np.arccos(np.clip(centres @ centres.T, -1, 1))
    reach = float(np.arccos(COSINE)) + 1e-6
    tiles = {c: -(-size // tile) for c, (size, _) in cells.items()}
    partners = {
        c: [d for d in sorted(cells) if between[c, d] <= reach + cells[c][1] + cells[d][1]] for c in sorted(cells)
    }
    # For a cell: every partner cell with its number of tiles. Bounded by CENTRES squared.
    plan = classes.sparkSession.createDataFrame(
        [(c, tiles[c], [(d, tiles[d]) for d in partners[c]]) for c in sorted(cells)],
        "cell int, own int, partners array<struct<cell: int, tiles: int>>",
    )
    mine = F.struct(F.col("cell"), F.col("tile"))
    other = F.struct(F.col("partner.cell").alias("cell"), F.col("t").alias("tile"))
    spread = (
        placed.join(F.broadcast(plan), "cell")
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("own")).cast("int"))
        .select("node", "times", "vector", "cell", "tile", F.explode("partners").alias("partner"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("partner.tiles") - 1)).alias("t"))
        .select(
            "node", "times", "vector",
            F.least(mine, other).alias("low"), F.greatest(mine, other).alias("high"),
            F.when(mine <= other, 0).otherwise(1).alias("side"),
        )
    )
    return spread.groupBy("low", "high").applyInPandas(lambda g: _tile_links(g[["node", "times", "vector", "side"]]), "node long, links long, root long")
