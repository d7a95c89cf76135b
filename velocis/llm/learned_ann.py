"""Approximate nearest neighbours (largest inner product) over learned partitions.

Fitted on the driver from a bounded sample: a neighbour graph of the sample is
cut into balanced parts (recursive bisection along the graph's slow
eigenvector, then swaps that cut fewer edges), and a small network learns to
tell from a vector in which parts its neighbours lie. Every vector is then
indexed in its most probable part; a query is routed to its several most
probable parts, as many as the sample needs for the wanted recall, and all
vectors there are ranked by the exact inner product. A query that finds fewer
than ``k`` there is sought in all other parts too.

Equal vectors are one class with its ``k + 1`` smallest ids, for queries and
candidates alike, so copies cost nothing. A part is searched in cells of at
most ``CELL`` candidates and ``CELL_QUERIES`` queries: no part, however popular,
is in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velocis.llm.common import about, materialise
from velocis.session import ship_code

#: About so many rows (by hash of the vector) the partitions are learned on; the index itself holds every row.
SAMPLE = 4096
CELL, CELL_QUERIES = 4096, 1024
#: Rows of a part; small tables are cut finer, up to ``FINE_PARTS`` parts.
PART_ROWS, FINE_ROWS, FINE_PARTS = 1500, 64, 64
#: Rows of the sample that a part is learned from at least.
LEARN_ROWS = 8
_KEY = ["k1", "k2"]


# ---- learning, on the sample ------------------------------------------------

def neighbour_graph(x: np.ndarray, k: int = 12) -> tuple:
    """Undirected edges (i, j) between each row and its k largest inner products."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(k, len(x) - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    i = np.repeat(np.arange(len(x)), k)
    j = near.reshape(-1)
    pair = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0)
    return near, np.r_[pair[:, 0], pair[:, 1]], np.r_[pair[:, 1], pair[:, 0]]


def balanced_parts(n: int, src: np.ndarray, dst: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Cut the graph into ``parts`` (a power of two) parts of equal size."""
    rng = np.random.default_rng(seed)
    label = np.zeros(n, np.int64)
    for level in range(int(np.log2(parts))):
        for part in range(1 << level):
            nodes = np.flatnonzero(label == part)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[src] >= 0) & (place[dst] >= 0)
            label[nodes] = part + (_bisect(len(nodes), place[src[inside]], place[dst[inside]], rng) << level)
    return label


def _bisect(n: int, src: np.ndarray, dst: np.ndarray, rng) -> np.ndarray:
    degree = np.bincount(src, minlength=n) + 1.0
    v = rng.standard_normal(n)
    for _ in range(60):  # lazy random walk, without the constant part: the slowest cut remains
        v = 0.5 * v + 0.5 * (np.bincount(src, v[dst], minlength=n) + v) / degree
        v -= np.average(v, weights=degree)
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, np.int64)
    side[np.argsort(v, kind="stable")[n - n // 2:]] = 1
    for _ in range(8):  # swap the pairs that gain most, so that both sides keep their size
        other = np.bincount(src, side[dst] != side[src], minlength=n)
        gain = 2 * other - np.bincount(src, minlength=n)
        a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (0, 1))
        m = min(len(a), len(b)) // 2 + (min(len(a), len(b)) == 1)
        if not m:
            break
        a, b = a[np.argsort(-gain[a], kind="stable")[:m]], b[np.argsort(-gain[b], kind="stable")[:m]]
        side[a], side[b] = 1, 0
    return side


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 96, epochs: int = 15, seed: int = 7) -> tuple:
    """A one-layer network from vectors to part probabilities (cross entropy, Adam)."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    scale = 1.0 / (np.abs(x).mean() + 1e-30)
    x = x * scale
    w = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden),
         rng.standard_normal((hidden, p)) / np.sqrt(hidden), np.zeros(p)]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            b = order[i:i + 256]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[b]) / len(b)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for j, gr in enumerate((x[b].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[j] += 0.1 * (gr - m[j])
                v[j] += 0.001 * (gr * gr - v[j])
                w[j] -= 0.003 * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.999 ** step)) + 1e-8)
    return (scale, *w)


def route(model: tuple, x: np.ndarray) -> np.ndarray:
    """Log-odds of the parts, a row per vector."""
    scale, w0, b0, w1, b1 = model
    return np.maximum((x * scale) @ w0 + b0, 0) @ w1 + b1


def part_count(n: int, sample: int) -> int:
    """A power of two, at least 2, that grows with the ``n`` rows as long as the
    sample can teach so many parts."""
    wanted = max(min(n / FINE_ROWS, FINE_PARTS), n / PART_ROWS, 2)
    return 1 << int(min(round(np.log2(wanted)), max(np.log2(max(sample, 1) / LEARN_ROWS), 1)))


def fit(x: np.ndarray, parts: int, k: int, recall: float) -> tuple:
    """Router and number of parts a query visits to find ``recall`` of the
    sample's own neighbours. Fewer than four rows make one part."""
    if len(x) < 4:
        return None, 1, 1
    near, src, dst = neighbour_graph(x)
    label = balanced_parts(len(x), src, dst, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 3.0)
    for c in range(near.shape[1]):
        np.add.at(target, (np.arange(len(x)), label[near[:, c]]), 1.0)
    held = np.arange(len(x)) % 8 == 0  # not trained on: they show how many parts a query needs
    model = train_router(x[~held], (target / target.sum(1, keepdims=True))[~held])
    odds = route(model, x)
    part = odds.argmax(1)
    place = np.argsort(np.argsort(-odds[held], axis=1), axis=1)  # rank of each part in a query's order
    found = np.take_along_axis(place, part[near[held]], 1).reshape(-1)
    visits = next(v for v in range(1, parts + 1) if (found < v).mean() >= recall)
    return model, parts, visits


# ---- over the cluster -------------------------------------------------------

def _valid(emb: Column) -> Column:
    finite = F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return emb.isNotNull() & (F.size(emb) > 0) & finite & F.exists(emb, lambda v: v != 0)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            sample: int = SAMPLE, recall: float = 0.95) -> DataFrame:
    """For each row whose id is divisible by ``every``, its ``k`` nearest other
    rows: ``query_id, rank, vec_id, score``.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows with a null id or of another length than the most common
    one. Rows that repeat an id and its vector count once; a query never finds
    its own id. Ties go to the smaller id. Fewer candidates than ``k`` are all
    returned; other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship_code(spark)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                       F.col(vec_col).cast("array<double>").alias("emb"))
    v = v.where(F.col("vec_id").isNotNull() & _valid(F.col("emb")))
    size = v.groupBy(F.size("emb").alias("d")).count().orderBy(F.desc("count"), "d").first()
    v = v.where(F.size("emb") == (size["d"] if size else 0))
    v = v.withColumns({"k1": F.xxhash64(F.lit(1), "emb"), "k2": F.xxhash64(F.lit(2), "emb")})
    rows = materialise(v.groupBy("vec_id", *_KEY).agg(F.first("emb").alias("emb")), "ann-rows")
    lowest = Window.partitionBy(*_KEY).orderBy("vec_id")
    classes = rows.withColumn("r", F.row_number().over(lowest)).where(F.col("r") <= k + 1).groupBy(*_KEY).agg(
        F.first("emb").alias("emb"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = materialise(classes, "ann-classes")
    n = classes.count()
    picked = sorted(about(classes, sample, *_KEY).select(*_KEY, "emb").collect(), key=lambda r: (r["k1"], r["k2"]))
    x = np.array([r["emb"] for r in picked], np.float64)
    model, parts, visits = fit(x, part_count(n, len(x)), k, recall)

    def route_all(take):
        def run(batches):
            import pyarrow as pa
            from velocis.llm.learned_ann import route
            for b in batches:
                if not b.num_rows:
                    continue
                x = b.column("emb").flatten().to_numpy().reshape(b.num_rows, -1)
                best = np.zeros((len(x), 1), np.int64) if model is None else \
                    np.argsort(-route(model, x), axis=1, kind="stable")[:, :take]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(best), pa.list_(pa.int64()))],
                                                 names=[*b.schema.names, "parts"])
        return run

    def routed(df, take):
        fields = df.schema.simpleString()[7:-1]
        return df.mapInArrow(route_all(take), f"{fields},parts:array<bigint>")

    index = materialise(routed(classes, 1).withColumn("part", F.col("parts")[0]).drop("parts"), "ann-index")
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = asked.groupBy(*_KEY).agg(F.first("emb").alias("emb"))

    def rank_cell(left, right):
        """One row per query of the cell, with its best k + 1 ids there."""
        import pandas as pd
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in ("k1", "k2", "scores", "ids")})
        c, q = np.stack(left["emb"].to_list()), np.stack(right["emb"].to_list())
        by_id = np.argsort([i[0] for i in left["ids"]], kind="stable")
        c, ids = c[by_id], [left["ids"].iloc[i] for i in by_id]
        low = np.array([i[0] for i in ids])
        several = np.array([len(i) > 1 for i in ids])
        scores, found = [], []
        for i in range(0, len(q), 256):
            s = q[i:i + 256] @ c.T
            m = min(k + 1, s.shape[1])
            last = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
            for row, low_score in zip(s, last):
                near = np.flatnonzero(row >= low_score)
                near = near[np.argsort(-row[near], kind="stable")[:m]]
                if several[near].any():  # classes of copies: their ids, ties to the smaller
                    pairs = sorted((-row[x], v) for x in near for v in ids[x])[:k + 1]
                    scores.append([-x for x, _ in pairs])
                    found.append([v for _, v in pairs])
                else:
                    scores.append(row[near])
                    found.append(low[near])
        return pd.DataFrame({"k1": right["k1"], "k2": right["k2"], "scores": scores, "ids": found})

    # the best k + 1 ids of each class of queries (a list per visited cell), then of each query without itself
    def search(queries, name):
        # cells: at most CELL candidates and CELL_QUERIES queries of one part (a row per part: small)
        queries = materialise(queries, "ann-queries")
        shape = index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("nb")).join(
            queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("nq")), "part")
        shape = materialise(shape, "ann-cells")

        def cells(df, own, others):
            mine = F.pmod("k1", F.col(own)).alias(own)
            out = df.join(shape, "part").withColumns({f"_{own}": mine, f"_{others}": F.explode(
                F.sequence(F.lit(0).cast("long"), F.col(others) - 1))})
            return out.withColumn("cell", F.struct("part", F.col("_nb").alias("b"), F.col("_nq").alias("q")))

        cand = cells(index, "nb", "nq").select("cell", "emb", "ids")
        ask = cells(queries, "nq", "nb").select("cell", *_KEY, "emb")
        found = cand.groupBy("cell").cogroup(ask.groupBy("cell")).applyInPandas(
            rank_cell, "k1 long, k2 long, scores array<double>, ids array<long>")
        ordered = F.array_sort(F.flatten(F.collect_list(F.transform(
            F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("v"))))))
        return materialise(found.groupBy(*_KEY).agg(F.slice(ordered, 1, k + 1).alias("best")), name)

    per_class = search(routed(queries, visits).withColumn("part", F.explode("parts")).drop("parts"), "ann-found")
    short = per_class.where(F.size("best") < k + 1)
    if visits < parts and not short.isEmpty():
        # too few candidates in the visited parts: these classes, and no others, are sought in all the rest
        rest = routed(queries.join(short.select(*_KEY), _KEY, "left_semi"), parts) \
            .withColumn("part", F.explode(F.slice("parts", visits + 1, parts))).drop("parts")
        both = per_class.unionByName(search(rest, "ann-more"))
        per_class = both.groupBy(*_KEY).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    per_class = per_class.select(*_KEY, F.explode("best").alias("b")) \
        .select(*_KEY, (-F.col("b")["s"]).alias("score"), F.col("b")["v"].alias("vec_id"))
    answers = asked.select(F.col("vec_id").alias("query_id"), *_KEY).join(per_class, _KEY) \
        .where("vec_id != query_id")
    mine = Window.partitionBy("query_id", *_KEY).orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
