"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are the leaves of a binary trie. Node pairs are traversed
together from the top, adding the bits in which the two nodes differ, and a
pair is pruned when the sum exceeds the error budget.

Spread over a cluster: 64 bits are cut into budget + 1 blocks; two
fingerprints within the budget agree on one block, so the trie is built once
per block with that block's bits on top, and a pair of nodes needs traversing
only below equal tops. Each fingerprint is shuffled budget + 1 times, however
many others it is near to. A top with more than ``leaves`` different
fingerprints is dealt into chunks, and each pair of chunks is a traversal of
its own, so no task holds more than two chunks. A task returns the links that
connect what it found (at most one per leaf), never all pairs; rows with equal
fingerprints are one leaf.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from velocis.llm.common import components, materialise, shuffle_partitions, text_or_empty
from velocis.session import ship_code

LEAVES = 2048
_FRONTIER = 1 << 18


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of UTF-8 text: ASCII letters lower-cased, words
    between ASCII white space, XXH64 (seed 42) of each run of ``shingle`` words;
    fewer words count as one shingle; none give 0."""
    from xxhash import xxh64_intdigest
    w = text.lower().split()
    n = max(1, len(w) - shingle + 1) if w else 0
    if not n:
        return 0
    runs = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    h = np.fromiter(map(xxh64_intdigest, runs, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = np.ascontiguousarray(h[i:i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def with_fingerprints(docs: DataFrame, text_col: str, shingle: int, name: str = "__fp") -> DataFrame:
    ship_code(docs.sparkSession)

    @pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        from velocis.llm.simhash_trie import fingerprint
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.withColumn(name, fp(text_or_empty(text_col).cast("binary")))


def trie_links(cell: np.ndarray, side: np.ndarray, key: np.ndarray, budget: int, depth: int) -> tuple:
    """Traverse the tries of many cells at once. ``key`` holds the bits in trie
    order; a cell with two sides pairs side 0 with side 1, one with a single
    side pairs it with itself. The first ``depth`` bits agree within a cell.
    Returns index pairs (node, smaller node) that connect all pairs of leaves
    within ``budget`` bits."""
    order = np.lexsort((key, side, cell))
    cell, side, key = cell[order], side[order], key[order]
    n = len(key)
    start = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])
    end = np.r_[start[1:], n]
    # pair up: a one-sided cell with itself, a two-sided one side 0 with side 1
    c = cell[start]
    two = np.r_[c[1:] == c[:-1], False]
    second = np.r_[False, two[:-1]]
    chunked = side[start] >= 0
    first = np.flatnonzero(~second & (two | ~chunked))
    other = np.where(two[first], first + 1, first)
    stack = [(depth, start[first], end[first], start[other], end[other], np.zeros(len(first), np.int8))]
    ones_before: dict[int, np.ndarray] = {}
    forest = _Forest(n)
    while stack:
        d, al, ah, bl, bh, err = stack.pop()
        if len(al) > _FRONTIER:
            for i in range(0, len(al), _FRONTIER):
                s = slice(i, i + _FRONTIER)
                stack.append((d, al[s], ah[s], bl[s], bh[s], err[s]))
            continue
        own = al == bl
        # what is left cannot exceed the budget: all leaves below are linked
        sure = 64 - d <= budget - err
        if sure.any():
            lone = sure & own
            for lo, hi in zip(al[lone], ah[lone]):
                forest.add(np.arange(lo + 1, hi), np.full(hi - lo - 1, lo))
            far = sure & ~own
            forest.add(al[far], bl[far])
        # two single leaves: the rest of the path in one step
        single = ~sure & ~own & (ah - al == 1) & (bh - bl == 1)
        near = np.bitwise_count(key[al[single]] ^ key[bl[single]]) <= budget
        forest.add(al[single][near], bl[single][near])
        go = ~(sure | single) & ~(own & (ah - al == 1))
        if not go.any():
            continue
        al, ah, bl, bh, err, own = al[go], ah[go], bl[go], bh[go], err[go], own[go]
        if d not in ones_before:
            bit = (key >> np.uint64(63 - d)) & np.uint64(1)
            ones_before[d] = np.r_[0, np.cumsum(bit, dtype=np.int64)]
        ob = ones_before[d]
        am, bm = ah - (ob[ah] - ob[al]), bh - (ob[bh] - ob[bl])
        kids = [(al, am, bl, bm, err, None), (am, ah, bm, bh, err, None),
                (al, am, bm, bh, err + 1, None), (am, ah, bl, bm, err + 1, ~own)]
        parts = []
        for x0, x1, y0, y1, e, only in kids:
            ok = (x1 > x0) & (y1 > y0) & (e <= budget)
            if only is not None:
                ok &= only
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok].astype(np.int8)))
        stack.append((d + 1, *(np.concatenate(x) for x in zip(*parts))))
    node, low = forest.links()
    return order[node], order[low]


class _Forest:
    """Collects links and keeps at most one per leaf."""

    def __init__(self, n: int):
        self.label, self.held, self.size = np.arange(n), [], 0

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        if len(u):
            self.held.append((u, v))
            self.size += len(u)
            if self.size > 1 << 20:
                self._merge()

    def _merge(self) -> None:
        if not self.held:
            return
        u, v = (np.concatenate(x) for x in zip(*self.held))
        while True:
            lu, lv = self.label[u], self.label[v]
            apart = lu != lv
            if not apart.any():
                break
            u, v = u[apart], v[apart]
            np.minimum.at(self.label, np.maximum(lu, lv)[apart], np.minimum(lu, lv)[apart])
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up
        self.held, self.size = [], 0

    def links(self) -> tuple:
        self._merge()
        node = np.flatnonzero(self.label != np.arange(len(self.label)))
        return node, self.label[node]


def near_links(prints: DataFrame, budget: int = 4, leaves: int = LEAVES) -> DataFrame:
    """``prints(fp)``, distinct -> links ``(a, b)`` that connect exactly the
    fingerprints reachable over steps of at most ``budget`` bits."""
    spark = prints.sparkSession
    ship_code(spark)
    blocks = budget + 1
    offsets = [64 * i // blocks for i in range(blocks)]
    depth = min(64 * (i + 1) // blocks - 64 * i // blocks for i in range(blocks))
    turned = F.array(*[F.struct(
        F.lit(i).alias("o"),
        (F.col("fp") if not off else F.shiftleft("fp", off).bitwiseOR(F.shiftrightunsigned("fp", 64 - off)))
        .alias("key")) for i, off in enumerate(offsets)])
    rows = prints.select("fp", F.explode(turned).alias("t")).select("fp", "t.o", "t.key")
    rows = rows.withColumn("top", F.shiftrightunsigned("key", 64 - depth).bitwiseOR(
        F.shiftleft(F.col("o").cast("long"), 24)))
    tops = materialise(rows.groupBy("top").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                       .select("top", F.ceil(F.col("n") / leaves).cast("int").alias("chunks")), "trie-tops")
    rows = rows.join(tops, "top")
    own = F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    i, j = F.least("own", "k"), F.greatest("own", "k")
    # a chunk paired with itself has side -1, else the lower chunk is side 0 and the higher side 1
    rows = rows.select(
        "fp", "key", F.xxhash64("top", i, j).alias("cell"), F.col("top"), (i * (1 << 20) + j).alias("pair"),
        F.when(i == j, -1).when(F.col("own") == i, 0).otherwise(1).alias("side"))
    parts = shuffle_partitions(spark)
    dealt = rows.repartition(parts, "cell").sortWithinPartitions("cell")

    def links(batches):
        import numpy as np
        import pyarrow as pa
        from velocis.llm.common import groups_of
        from velocis.llm.simhash_trie import trie_links
        for t in groups_of(batches, "cell", 1 << 17):
            fp = t.column("fp").to_numpy()
            cell = np.unique(np.stack([t.column("top").to_numpy(), t.column("pair").to_numpy()], 1), axis=0,
                             return_inverse=True)[1].reshape(-1)
            a, b = trie_links(cell, t.column("side").to_numpy(), t.column("key").to_numpy().view(np.uint64),
                              budget, depth)
            yield pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    return dealt.mapInArrow(links, "a long, b long")


def near_groups(rows: DataFrame, budget: int = 4, leaves: int = LEAVES) -> DataFrame:
    """``rows(__fp, __best)``, written -> ``(fp, best)``: the smallest ``__best`` of each
    fingerprint's component. ``__best`` is any ordered value."""
    prints = materialise(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("__best").alias("best")), "trie-leaves")
    comp = components(near_links(prints.select("fp"), budget, leaves))
    joined = prints.join(comp.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    joined = materialise(joined, "trie-roots")
    best = joined.groupBy("root").agg(F.min("best").alias("best"))
    return materialise(joined.drop("best").join(best, "root").select("fp", "best"), "trie-groups")


def _best(id_col: str, *more) -> Column:
    """Ordered: smallest id first, null last."""
    return F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), *more)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       budget: int = 4, leaves: int = LEAVES) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id`` (smallest id reachable).

    Null and empty texts have fingerprint zero, which links like any other; a
    null id is larger than all others (a component of null ids alone has a null
    component_id); repeated rows share fingerprint and component and appear as
    often as they came; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    rows = with_fingerprints(d, "__text", shingle).select("doc_id", "__fp", _best("doc_id").alias("__best"))
    rows = materialise(rows, "simhash-rows")
    groups = near_groups(rows, budget, leaves)
    return rows.join(groups.withColumnRenamed("fp", "__fp"), "__fp").select(
        "doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.col("best")["i"].alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         budget: int = 4, leaves: int = LEAVES) -> DataFrame:
    """The rows of ``docs``, with their own columns, that have the smallest id of
    their component (of repeated rows, one)."""
    cols = docs.columns
    rows = with_fingerprints(docs.withColumn("__rid", F.monotonically_increasing_id()), text_col, shingle)
    rows = materialise(rows.withColumn("__best", _best(id_col, F.col("__rid").alias("r"))), "simhash-docs")
    groups = near_groups(rows.select("__fp", "__best"), budget, leaves)
    keep = groups.select(F.col("best")["r"].alias("__rid")).distinct()
    # the same plan at every size: whole rows are shuffled once, by their own number
    return rows.join(keep.hint("merge"), "__rid", "left_semi").select(*cols)
