"""Rolling features of an entity with many events inside one window.

Time slices of at least one window (``skew``) put such an entity into one task.
Here its time is cut into *cells* narrower than every window: each window length
is a whole number of cells, so a frame ``[t - W, t]`` is

    the end of cell ``i - k`` from ``t - W`` on  +  cells ``i - k + 1 .. i - 1``  +  cell ``i`` up to ``t``

for ``t`` in cell ``i`` and ``W`` = ``k`` cells. The outer two are running
aggregates inside cell ``i`` of its own rows and of copies moved ``W`` ahead,
as in ``rolling``. The middle is the *opening balance* of the cell: mergeable
partial aggregates (count, sum, mean and squared deviations, extremes) of whole
cells, taken from the table of cells by the same two running aggregates, in
blocks of cells. A merchant in the middle is left out of the running marks and
counted in the opening balance: it entered with its cell and leaves with its
next one or ``k - 1`` cells later, a running sum of marks over cells in two
levels. Every cell is a group of its own for the exchange.

A frame capped at N rows (W2) is ``[rank - (N - 1), rank]`` in the entity's
order. Ranks count the rows of the cells before and those up to the row in its
own cell; blocks of ``N - 1`` ranks are then the groups, with at most 2 N rows.

Equal times cannot be parted: rows at one microsecond share a frame.
"""

from __future__ import annotations

from functools import lru_cache
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velocis.operators.rolling import (
    ALL_STATS, MICROS, feature_columns, merge_parts, running_parts, statistics,
)
from velocis.operators.skew import SplitPlan, join_null_safe
from velocis.schemas import WindowSet

#: Cells a task scans in one group of the second level.
SCAN = 4096


@lru_cache
def cell_widths(windows: WindowSet) -> list[int]:
    """Widths in micros (a millisecond at least) of which every window is a
    whole number, widest first, each at most 1/1.4 of the one before."""
    g = 0
    for w in windows.lengths:
        g = gcd(g, w * MICROS)
    widths = [g]
    for d in range(2, g // 1000 + 1):
        if g % d == 0 and widths[-1] >= 1.4 * (g // d):
            widths.append(g // d)
        if d > 1_000_000:
            break
    return widths


def plan_widths(events: DataFrame, entities: DataFrame, key: str, windows: WindowSet, rows: int) -> DataFrame:
    """``key, cell_us``: for each of ``entities`` the widest cell that leaves
    about ``rows`` rows in its fullest stretch of the widest width."""
    widths = cell_widths(windows)
    per = join_null_safe(events.select(key, "us"), entities.select(key), [key], "left_semi") \
        .groupBy(key, F.floor(F.col("us") / widths[0]).alias("_g")).agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy(key).agg(F.max("_n").alias("_n"))
    parts = F.ceil(F.col("_n") / rows)
    options = F.array(*[F.lit(w).cast("long") for w in widths])
    fit = F.filter(options, lambda w: F.lit(widths[0]) / w >= parts)
    return per.select(key, F.coalesce(F.get(fit, F.lit(0)), F.get(options, F.size(options) - 1)).alias("cell_us"))


def _cells(rows: DataFrame, key: str) -> DataFrame:
    """One row per (entity, cell): partial aggregates and the last event."""
    place = F.struct("us", "tid")
    event = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "us")
    return rows.groupBy(key, "cell", "cell_us").agg(
        F.count("amount").alias("n"), F.sum("amount").alias("s"), F.avg("amount").alias("a"),
        F.var_pop("amount").alias("v"), F.max("amount").alias("hi"), F.min("amount").alias("lo"),
        F.max_by(event, place).alias("last"), F.count(F.lit(1)).alias("rows"))


def _scan(df: DataFrame, key: str, pos: str, total: Column, running: str) -> DataFrame:
    """Adds ``running``: the sum of ``total`` over the entity's rows up to
    ``pos``. Two levels: inside groups of ``SCAN`` positions, and over the groups."""
    df = df.withColumn("_g", F.floor(F.col(pos) / SCAN))
    groups = df.groupBy(key, "_g").agg(F.sum(total).alias("_t"))
    upto = Window.partitionBy(key).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    opening = groups.select(key, "_g", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(key, "_g").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0)
    out = join_null_safe(df.withColumn("_i", F.coalesce(F.sum(total).over(inside), F.lit(0))), opening, [key, "_g"])
    return out.withColumn(running, F.col("_i") + F.col("_o")).drop("_g", "_i", "_o")


def _last_before(cells: DataFrame, key: str) -> DataFrame:
    """``key, cell, before``: the last event of the cells before each cell, in two levels."""
    c = cells.select(key, "cell", "last").withColumn("_g", F.floor(F.col("cell") / SCAN))
    groups = c.groupBy(key, "_g").agg(F.max_by("last", "cell").alias("_t"))
    over = Window.partitionBy(key).orderBy("_g")
    opening = groups.select(key, "_g", F.lag("_t").over(over).alias("_o"))
    inside = Window.partitionBy(key, "_g").orderBy("cell")
    c = c.withColumn("_i", F.lag("last").over(inside))
    return join_null_safe(c, opening, [key, "_g"]).select(key, "cell", F.coalesce("_i", "_o").alias("before"))


def _opening(cells: DataFrame, key: str, w: int) -> DataFrame:
    """``key, cell`` and the aggregates of the ``W / cell_us - 1`` cells before
    each cell, as columns ``n, s, a, v, hi, lo``.

    Sums of squares are taken about a pivot of the entity (the mean of its
    cells), so that merging cells subtracts only small numbers."""
    pivot = cells.groupBy(key).agg(F.avg("a").alias("_c"))
    whole = (F.lit(w * MICROS) / F.col("cell_us") - 1).cast("long")
    c = join_null_safe(cells, pivot, [key], "left").withColumn("_w", whole)
    off = F.col("a") - F.col("_c")
    zero = F.lit(0.0)
    c = c.withColumns({"_d": F.coalesce(F.col("n") * off, zero),
                       "_q": F.coalesce(F.col("n") * (F.col("v") + off * off), zero)})
    # own cells, copies moved by the number of whole cells, and the question of each cell at the one before it
    role = F.when(F.col("_w") > 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    c = c.withColumn("_role", F.explode(role))
    at = F.when(F.col("_role") == 0, F.col("cell")).when(F.col("_role") == 1, F.col("cell") + F.col("_w")) \
        .otherwise(F.col("cell") - 1)
    c = c.withColumn("_at", at).withColumn("_b", F.floor(F.col("_at") / F.greatest("_w", F.lit(1))))
    upto = Window.partitionBy(key, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    beyond = Window.partitionBy(key, "_b").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    cols = {}
    for col, agg in (("n", F.sum), ("s", F.sum), ("_d", F.sum), ("_q", F.sum), ("hi", F.max), ("lo", F.min)):
        cols[f"_p{col}"] = agg(F.when(F.col("_role") == 0, F.col(col))).over(upto)
        cols[f"_o{col}"] = agg(F.when(F.col("_role") == 1, F.col(col))).over(beyond)
    c = c.withColumns(cols).where("_role = 2")

    def both(col):
        return F.coalesce(f"_p{col}", F.lit(0)) + F.coalesce(f"_o{col}", F.lit(0))

    n = both("n")
    d, q = both("_d"), both("_q")
    return c.select(
        key, "cell", n.cast("long").alias("n"), F.when(n > 0, both("s")).alias("s"),
        F.when(n > 0, F.col("_c") + d / n).alias("a"),
        F.when(n > 0, F.greatest(q / n - (d / n) * (d / n), zero)).alias("v"),
        F.greatest("_phi", "_ohi").alias("hi"), F.least("_plo", "_olo").alias("lo"))


def _merchants(rows: DataFrame, key: str) -> DataFrame:
    """Different merchants of each cell, with the cells where each came last and comes next."""
    seen = rows.where("merchant_id IS NOT NULL").select(key, "merchant_id", "cell", "cell_us").distinct()
    by = Window.partitionBy(key, "merchant_id").orderBy("cell")
    return seen.withColumns({"_was": F.lag("cell").over(by), "_next": F.lead("cell").over(by)})


def _opening_merchants(seen: DataFrame, cells: DataFrame, key: str, w: int) -> DataFrame:
    """``key, cell, u``: different merchants in the whole cells before each cell."""
    whole = (F.lit(w * MICROS) / F.col("cell_us") - 1).cast("long")
    leaves = F.least(F.coalesce("_next", F.col("cell") + whole), F.col("cell") + whole) + 1
    marks = seen.where(whole > 0).select(key, F.inline(F.array(
        F.struct((F.col("cell") + 1).alias("at"), F.lit(1).alias("d")),
        F.struct(leaves.alias("at"), F.lit(-1).alias("d"))))).groupBy(key, "at").agg(F.sum("d").alias("d"))
    asked = cells.select(key, F.col("cell").alias("at"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("ask"))
    every = marks.withColumn("ask", F.lit(False)).unionByName(asked)
    return _scan(every, key, "at", F.col("d"), "u").where("ask").select(key, F.col("at").alias("cell"), "u")


def _ranks_before(cells: DataFrame, key: str) -> DataFrame:
    """``key, cell, ahead``: rows of the cells before each cell."""
    c = _scan(cells.select(key, "cell", "rows"), key, "cell", F.col("rows"), "_upto")
    return c.select(key, "cell", (F.col("_upto") - F.col("rows")).alias("ahead"))


def _capped_frames(rows: DataFrame, key: str, max_events: int, plan: SplitPlan | None) -> DataFrame:
    """Adds ``_c``: statistics and merchants (``uniq``) of the last
    ``max_events`` rows by ``_rank``, from running aggregates in blocks of ranks.
    Copies carry what the frames need, nothing else."""
    reach = max_events - 1
    need = {key, "amount", "merchant_id", "_rank"}
    rest = [c for c in rows.columns if c not in need]
    counts = F.col("amount").isNotNull() | F.col("merchant_id").isNotNull()
    rows = rows.select(*need, F.struct(*rest).alias("_rest"))
    rows = rows.withColumn("_role", F.explode(F.when(counts & F.lit(reach > 0), F.array(F.lit(0), F.lit(1)))
                                              .otherwise(F.array(F.lit(0)))))
    own, copy = F.col("_role") == 0, F.col("_role") == 1
    rows = rows.withColumns({"_rest": F.when(own, F.col("_rest")), "_vr": F.col("_rank") + F.col("_role") * F.lit(reach)})
    rows = rows.withColumn("_br", F.floor(F.col("_vr") / max(reach, 1)))
    rows = _spread(rows, plan, key, "_br").withColumns({
        "_x": F.col("amount"), "_m": F.col("merchant_id"), "_rid": F.monotonically_increasing_id()})
    rows, (p, q), uniq = running_parts(rows, [key, "_br"], "_vr", own, copy, {"n", "s", "a", "v", "hi", "lo"}, True)
    found = statistics(merge_parts(p, q)) | {"uniq": uniq}
    rows = rows.withColumn("_c", F.struct(*[c.alias(k) for k, c in found.items()])).where(own)
    return rows.select(*need, "_c", *[F.col(f"_rest.{c}").alias(c) for c in rest])


def _spread(rows: DataFrame, plan: SplitPlan | None, *keys: str) -> DataFrame:
    return rows.repartition(*keys) if plan is None or plan.rows is None else plan.spread(rows, *keys)


def with_cell_frames(rows: DataFrame, windows: WindowSet, key: str, stats: str = "snapshot",
                     unique_all: bool = False, max_events: int | None = None,
                     plan: SplitPlan | None = None) -> tuple[DataFrame, list[str]]:
    """Feature columns of ``rows`` (event rows with ``cell_us``), and ``_prev``,
    the struct of the event before each row."""
    base = rows.columns
    rows = rows.withColumn("cell", F.floor(F.col("us") / F.col("cell_us")))
    cells = _cells(rows, key)
    seen = _merchants(rows, key)
    # one row per own row and length; copies carry what the frames need, nothing else
    wide = [c for c in base if c not in {key, "us", "side", "tid", "amount", "merchant_id", "cell_us"}]
    rows = join_null_safe(rows, seen.drop("cell_us"), [key, "merchant_id", "cell"], "left")
    rows = rows.withColumn("_wide", F.struct(*wide)).drop(*wide)
    counts = F.col("amount").isNotNull() | F.col("merchant_id").isNotNull()
    roles = list(range(len(windows.lengths) + 1))
    rows = rows.withColumn("_role", F.explode(F.when(counts, F.array(*[F.lit(r) for r in roles]))
                                              .otherwise(F.array(F.lit(0)))))
    own = F.col("_role") == 0
    moved = F.lit(0).cast("long")
    for r, w in zip(roles[1:], windows.lengths):
        moved = F.when(F.col("_role") == r, F.lit(w * MICROS)).otherwise(moved)
    rows = rows.withColumns({"_wide": F.when(own, F.col("_wide")), "_vt": F.col("us") + moved, "_own_cell": F.col("cell")})
    rows = rows.withColumn("cell", F.floor(F.col("_vt") / F.col("cell_us")))
    block = [key, "cell"]
    rows = _spread(rows, plan, key, "cell").withColumns({"_x": F.col("amount"), "_rid": F.monotonically_increasing_id()})
    before = Window.partitionBy(*block).orderBy("_vt", "side", "tid").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(own, F.struct(F.col("tid"), F.col("_wide.latitude").alias("lat"), F.col("_wide.longitude").alias("lon"),
                                 F.col("us")))
    rows = rows.withColumn("_prev", F.last(event, ignorenulls=True).over(before))
    openings = _last_before(cells, key)
    if max_events:
        upto = Window.partitionBy(*block).orderBy("_vt", "side", "tid").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_rank", F.sum(F.when(own, 1).otherwise(0)).over(upto))
        openings = join_null_safe(openings, _ranks_before(cells, key), [key, "cell"], "left")
    for r, w in zip(roles[1:], windows.lengths):
        wanted = ALL_STATS if stats == "all" else windows.stats_for(w)
        want_uniq = unique_all or w == windows.long
        need = {"n", "s", "a", "v"} | ({"hi"} if "max" in wanted else set()) | ({"lo"} if "min" in wanted else set())
        whole = (F.lit(w * MICROS) / F.col("cell_us") - 1).cast("long")
        # merchants that also occur in the whole cells between are in the opening balance
        rows = rows.withColumns({
            "_mo": F.when(F.col("_was").isNull() | (F.col("_was") < F.col("_own_cell") - whole), F.col("merchant_id")),
            "_mc": F.when(F.col("_next").isNull() | (F.col("_next") > F.col("_own_cell") + whole), F.col("merchant_id"))})
        rows, (p, q), uniq = running_parts(rows, block, "_vt", own, F.col("_role") == r, need, want_uniq, "_mo", "_mc")
        rows = rows.withColumn(f"_f{r}", F.struct(*[c.alias(k) for k, c in merge_parts(p, q).items()]))
        o = _opening(cells, key, w).withColumn(f"_o{r}", F.struct("n", "s", "a", "v", "hi", "lo")) \
            .select(key, "cell", f"_o{r}")
        openings = join_null_safe(openings, o, [key, "cell"], "left")
        if want_uniq:
            rows = rows.withColumn(f"_u{r}", uniq)
            u = _opening_merchants(seen, cells, key, w).withColumnRenamed("u", f"_ou{r}")
            openings = join_null_safe(openings, u, [key, "cell"], "left")
    rows = join_null_safe(rows.where(own), openings, [key, "cell"], "left")
    rows = rows.withColumn("_prev", F.coalesce(
        F.col("_prev"), F.when(F.col("before").isNotNull(), F.struct(
            F.lit(None).cast("string").alias("tid"), F.col("before.lat").alias("lat"), F.col("before.lon").alias("lon"),
            F.col("before.us").alias("us")))))
    if max_events:
        rows = _capped_frames(rows.withColumn("_rank", F.col("_rank") + F.col("ahead")), key, max_events, plan)
    final: dict[str, Column] = {}
    for r, w in zip(roles[1:], windows.lengths):
        wanted = ALL_STATS if stats == "all" else windows.stats_for(w)
        keys = [k for k in ("n", "s", "a", "v", "hi", "lo") if k in rows.schema[f"_f{r}"].dataType.names]
        f = {k: F.col(f"_f{r}.{k}") for k in keys}
        o = {k: F.col(f"_o{r}.{k}") for k in keys} | {"n": F.coalesce(F.col(f"_o{r}.n"), F.lit(0).cast("long"))}
        uniq = (F.col(f"_u{r}") + F.coalesce(f"_ou{r}", F.lit(0))) if unique_all or w == windows.long else None
        frame = statistics(merge_parts(f, o))
        if max_events:
            over = frame["count"] > F.lit(max_events)
            frame = {k: F.when(over, F.col(f"_c.{k}")).otherwise(v) for k, v in frame.items()}
            uniq = F.when(over, F.col("_c.uniq")).otherwise(uniq) if uniq is not None else None
        final |= feature_columns(frame, uniq, wanted, w)
    rows = rows.withColumns(final)
    return rows.select(*[F.col(f"_wide.{c}").alias(c) if c in wide else F.col(c) for c in base], "_prev", *final), list(final)
