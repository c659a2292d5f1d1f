"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Unit vectors are projected on random orthonormal directions. Along one direction the projections of a pair at the cosine limit
differ like a normal variable of known width, so a window around each query holds its partner with a known probability; how
many of the directions must agree is the largest count that such a pair still reaches with the wanted recall. The first
direction orders all vectors: cells of one (wide) window are cut into blocks of bounded size, and only blocks of the same or
the next cell meet. In a block pair the collisions of every pair are counted over all directions, pairs that reach the count are
verified by their cosine in double precision, and each vector leaves one row: how many it links, and the smallest vector its links
reach there. No pair leaves the task. Equal vectors are one entry with a weight.
"""

from __future__ import annotations

from math import comb, erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.graph import components
from flowlens.operators.storage import cut

LIMIT = 0.9
DIRECTIONS = 24
RECALL = 0.998
WIDE, NARROW = 3.3, 1.5
BLOCK = 4096
ROWS = 512


def directions(dim: int, many: int = DIRECTIONS) -> np.ndarray:
    """``many`` orthonormal columns (as far as ``dim`` allows, then further sets), the same in every task."""
    random = np.random.default_rng(dim)
    sets = [np.linalg.qr(random.normal(size=(dim, dim)))[0] for _ in range(-(-many // dim))]
    return np.concatenate(sets, axis=1)[:, :many]


def width(dim: int, limit: float) -> float:
    """Standard deviation of the projected difference of two unit vectors at the limit."""
    return sqrt(2 * (1 - limit) / dim)


def needed(many: int = DIRECTIONS, recall: float = RECALL) -> int:
    """The largest collision count that a pair at the limit reaches with the wanted probability."""
    p = erf(NARROW / sqrt(2))
    tail = 0.0
    for count in range(many, -1, -1):
        tail += comb(many, count) * p ** count * (1 - p) ** (many - count)
        if tail >= recall:
            return count
    return 0


def links_of_block(left: pd.DataFrame, right: pd.DataFrame | None, limit: float) -> pd.DataFrame:
    """(vec, n, root) of each vector with a link between the blocks, or inside ``left`` where ``right`` is None."""
    whole = left if right is None else pd.concat([left, right], ignore_index=True)
    x = np.stack(whole["unit"].to_numpy())
    dim, first = x.shape[1], len(left)
    window = NARROW * width(dim, limit)
    p = x @ directions(dim)
    # 8-bit steps of a sixteenth of the window, plus one step for rounding; wrapping only adds candidates
    coarse = np.floor(p / (window / 16)).astype(np.int64).astype(np.uint8).T.copy()
    many, least = coarse.shape[0], needed(coarse.shape[0])
    pairs = []
    for at in range(0, first, ROWS):
        to = min(at + ROWS, first)
        start = at if right is None else first
        count = np.zeros((to - at, len(x) - start), np.uint8)
        for j in range(many):
            apart = coarse[j, at:to, None] - coarse[j, None, start:]
            apart += np.uint8(17)
            count += apart <= 34
        a, b = np.nonzero(count >= least)
        a, b = a + at, b + start
        keep = a < b
        a, b = a[keep], b[keep]
        for k in range(0, len(a), 1 << 16):
            i, j = a[k:k + (1 << 16)], b[k:k + (1 << 16)]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= limit
            pairs.append((i[near], j[near]))
    a, b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (list(zip(*pairs, strict=True)) or [(), ()]))
    weight, ids = whole["copies"].to_numpy(), whole["vec"].to_numpy()
    n = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
    root = ids.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        if (low == root).all():
            break
        root = low
    linked = np.flatnonzero(n)
    return pd.DataFrame({"vec": ids[linked], "n": n[linked].astype(np.int64), "root": root[linked]})


def classes(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, digest) of every row, digest null where it can link with nothing; (vec, copies, unit) of the different vectors."""
    sound = F.expr(
        "embedding IS NOT NULL AND size(embedding) > 0 AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(embedding, x -> x <> 0)"
    )
    doubles = F.expr("transform(embedding, x -> double(x) + 0.0D)")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("e", F.when(sound, doubles))
    rows = rows.withColumn("digest", F.when(F.col("e").isNotNull(), F.sha2(F.to_json(F.struct("e")), 256)))
    holders = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("vec"), F.count(F.lit(1)).alias("copies")
    )
    same = (F.col("r.digest") == F.col("h.digest")) & F.col("r.vec_id").eqNullSafe(F.col("h.vec"))
    first = rows.alias("r").join(holders.alias("h"), same).dropDuplicates(["digest"])
    big = "array_max(transform(e, x -> abs(x)))"
    scaled = F.expr(f"transform(e, x -> x / {big})")
    norm = "sqrt(aggregate(s, 0.0D, (a, x) -> a + x * x))"
    unit = first.select(F.col("h.digest").alias("digest"), "vec", "copies", "e").withColumn("s", scaled)
    return rows.select("vec_id", "digest"), unit.select("digest", "vec", "copies", F.expr(f"transform(s, x -> x / {norm})").alias("unit"))


def near_duplicates(embeddings: DataFrame, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different
    lengths. Equal vectors link. Repeated rows count as vectors of their own. A null vec_id counts as a link of others; where a
    group has no other id its component is null. Other columns are not read. An empty table gives no rows.
    """
    all_rows, different = classes(embeddings)
    all_rows, known = cut(all_rows), cut(different.withColumn("node", F.xxhash64("digest")))
    spark = embeddings.sparkSession
    dims = [r[0] for r in known.select(F.size("unit").alias("dim")).distinct().collect()]  # lengths, a few numbers
    if not dims:
        return _named(all_rows, known, None)
    axis = spark.createDataFrame(
        [(d, directions(d)[:, 0].tolist(), WIDE * width(d, limit)) for d in dims], "dim int, axis array<double>, step double"
    )
    placed = known.withColumn("dim", F.size("unit")).join(F.broadcast(axis), "dim").select(
        F.col("node").alias("vec"), "copies", "unit", "dim",
        F.expr("CAST(floor(aggregate(zip_with(unit, axis, (a, b) -> a * b), 0.0D, (s, v) -> s + v) / step) AS INT)").alias("cell"),
    )
    placed = cut(placed)
    sizes = cut(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")))
    near = sizes.alias("m").join(sizes.alias("x"), F.expr("m.dim = x.dim AND m.cell + 1 = x.cell"), "left").join(
        sizes.alias("p"), F.expr("m.dim = p.dim AND m.cell - 1 = p.cell"), "left"
    ).select("m.dim", "m.cell", "m.parts", F.coalesce("x.parts", F.lit(0)).alias("after"), F.coalesce("p.parts", F.lit(0)).alias("before"))
    seq = lambda low, high, body: f"transform(filter(sequence({low}, greatest({high}, {low})), i -> i < {high}), i -> {body})"
    key = "named_struct('c', {}, 's', {}, 'd', {}, 't', {}, 'right', {})"
    homes = F.expr(
        "concat("
        + seq("part", "parts", key.format("cell", "part", "cell", "i", "false")) + ", "
        + seq("0", "after", key.format("cell", "part", "cell + 1", "i", "false")) + ", "
        + seq("0", "part", key.format("cell", "i", "cell", "part", "true")) + ", "
        + seq("0", "before", key.format("cell - 1", "i", "cell", "part", "true")) + ")"
    )
    dealt = (
        placed.join(near, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int"))
        .select("vec", "copies", "unit", "dim", F.explode(homes).alias("k")).select("vec", "copies", "unit", "dim", "k.*")
    )

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        one = (rows["c"].iat[0], rows["s"].iat[0]) == (rows["d"].iat[0], rows["t"].iat[0])
        left, right = rows[~rows["right"]], rows[rows["right"]]
        if not one and (len(left) == 0 or len(right) == 0):
            return pd.DataFrame({"vec": [], "n": [], "root": []}).astype("int64")
        return links_of_block(left.reset_index(drop=True), None if one else right.reset_index(drop=True), limit)

    links = cut(dealt.groupBy("dim", "c", "s", "d", "t").applyInPandas(meet, "vec long, n long, root long"))
    return _named(all_rows, known, links)


def _named(all_rows: DataFrame, known: DataFrame, links: DataFrame | None) -> DataFrame:
    groups = known.select("digest", "node", "vec", "copies")
    if links is None:
        named = groups.select("digest", F.col("vec").alias("least"), (F.col("copies") - 1).alias("n_links"))
    else:
        comp = components(links.select(F.col("vec").alias("a"), F.col("root").alias("b")))
        total = links.groupBy(F.col("vec").alias("node")).agg(F.sum("n").alias("n"))
        groups = groups.join(total, "node", "left").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        groups = cut(groups)
        least = groups.groupBy("comp").agg(F.min("vec").alias("least"))
        named = groups.join(least, "comp").select(
            "digest", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
        )
    out = all_rows.join(cut(named), "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
