"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Targets: every source has a weight; the targets share the words of the whole
corpus in proportion to the weights, no target above ``cap`` times its
source's size, the excess reshared among the others (a water level).

Copies: a source whose target is f times its size takes each document
floor(f) times for certain. The rest r of its size is filled by a Pareto order
sample: each document draws a uniform u from its id and is ranked by the random
odds u / (1 - u) divided by its inclusion odds r / (1 - r) * preference, so
that documents differ in inclusion probability; the sample is the start of
that order, of the fixed size of r in words. The document that would overstep
is replaced by the one unsampled document that comes nearest to the words
still missing, if it brings the sum nearer. Where that still misses the target
by more than ``NEAR`` of it (a very long document early in the order), the order
is carried on: documents larger than the missing words are set aside, the
others taken in their order, until none fits; then again the nearest one. The
outcome nearer to the target counts. The DuckDB twin does not carry on: it
agrees where its own sums come within ``NEAR`` or carrying on gains nothing.

Order without a sort of a whole source: the rank value, scaled back by the
odds of its source, is cut into 2^10 and then 2^20 slices; sums per slice find
the slice where the words run out, and only that slice's rows are put in order.
Under the default preference a slice holds about 2^-18 of its source's ids, whatever the
target; rows that repeat an id (null is one id) and its size rank equal and share
a slice. The targets are found in one task, from one row per source: they are
meant for up to some million sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velocis.llm.common import WORD, materialise, text_or_empty

SEED = "pareto-1"
BITS = 10  # per level, two levels
#: Share of its target by which a source may miss it before the order is carried on.
NEAR = 0.05


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A uniform number in (0, 1) from 52 bits of an md5, the same on every run."""
    h = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def short_first(size: Column, mean: Column) -> Column:
    """Default preference: documents below the source's mean size have up to
    twice the odds, longer ones down to half (more texts for the same words)."""
    return F.when(size == 0, F.lit(2.0)).otherwise(
        F.least(F.lit(2.0), F.greatest(F.lit(0.5), mean / size)))


def rank_slice(y: Column, odds: Column) -> Column:
    """Slice of a rank value ``y``, rising with it, of a source with inclusion odds ``odds`` before the
    preference. ``y`` crowds at 0 or 1 if the odds are large or small; y / (1 - y) * odds does not.
    All its steps round without changing order, so a larger ``y`` is never in a lower slice."""
    half = 1 << (2 * BITS - 1)
    x = F.try_divide(y, F.lit(1.0) - y) * odds
    return F.when(y >= 1, F.lit(2 * half - 1)).when(x <= 1, F.floor(x * half)) \
        .otherwise(F.lit(2 * half - 1) - F.floor(F.try_divide(F.lit(float(half)), x))).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0, weight=None) -> DataFrame:
    """``sizes(source, size)`` -> one row per source: ``source_size, target, whole, rest, mean``.
    ``weight(index)`` gives the weight of the 0-based source in code-point order (null last);
    default 1, 2, 3, repeating. Its windows hold one row per source, in one task."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("__w", (weight or (lambda i: i % 3 + 1))(F.row_number().over(order) - 1).cast("double"))
    per = per.withColumns({"__cap": F.lit(cap) * F.col("source_size"),
                           "__total": F.sum("source_size").over(everything).cast("double"),
                           "__wsum": F.sum("__w").over(everything)})
    fill = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(fill), F.lit(0.0)))
                         / (F.col("__wsum") - F.coalesce(F.sum("__w").over(fill), F.lit(0.0))))
    # the water level: the first source (by cap / weight) that stays below its cap fixes it
    fits = F.col("__level") * F.col("__w") <= F.col("__cap")
    first = F.min(F.when(fits, F.struct((F.col("__cap") / F.col("__w")).alias("k"), F.col("source").isNull(),
                                        F.col("source"), F.col("__level").alias("level")))).over(everything)
    per = per.withColumn("target", F.least(F.col("__cap"), F.col("__w") * first["level"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("whole", whole.cast("long"))
    return per.select("source", "source_size", "target", "whole",
                      (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"),
                      (F.col("source_size").cast("double") / F.col("__rows")).alias("mean"))


def decide_copies(rows: DataFrame, cap: float = 3.0, weight=None, preference=short_first,
                  seed: str = SEED) -> DataFrame:
    """``rows(__rid, doc_id, source, size)``, a written table -> the same with
    ``source_size, target, copies``."""
    targets = materialise(source_targets(rows.select("source", "size"), cap, weight), "mix-targets")
    r = F.col("rest") / F.col("source_size")
    u = uniform(F.col("doc_id"), seed)
    plain = r / (F.lit(1.0) - r)
    odds = plain * preference(F.col("size"), F.col("mean"))
    # ranked by y = q / (1 + q) of q = random odds / inclusion odds: the same order, in (0, 1)
    q = u / (F.lit(1.0) - u) / odds
    y = F.when((F.col("source_size") > 0) & (F.col("rest") > 0), q / (F.lit(1.0) + q))
    ranked = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"]) \
        .withColumn("__y", y) \
        .withColumn("__k", F.when(F.col("__y").isNotNull(), rank_slice(F.col("__y"), plain)))
    ranked = materialise(ranked, "mix-ranked")

    flagged = materialise(_up_to_rest(ranked).withColumnRenamed("__now", "__picked"), "mix-picked")
    gap = flagged.where("__y IS NOT NULL").groupBy("source", "target").agg(
        (F.first("rest") - F.sum(F.when(F.col("__picked"), F.col("size")).otherwise(0))).alias("__gap"))
    gap = materialise(gap, "mix-gap")
    open_ = flagged.where("__y IS NOT NULL AND NOT __picked AND size > 0")
    fill = materialise(_nearest(open_, gap), "mix-fill")
    extra = fill.select("__rid")
    missed = _by_source(gap, fill.select("source", "__m"), "left").withColumn("__m", F.coalesce("__m", "__gap")) \
        .where(F.col("__m") > F.lit(NEAR) * F.col("target"))
    missed = materialise(missed, "mix-missed")
    if not missed.isEmpty():
        more, left = _carry_on(open_, missed)
        rest = _by_source(open_, missed.select("source")).join(more.select("__rid"), "__rid", "left_anti")
        last = materialise(_nearest(rest, left), "mix-fill")
        nearer = _by_source(left, last.select("source", F.col("__m").alias("__m2")), "left") \
            .where(F.coalesce("__m2", "__gap") < F.col("__m")).select("source")
        nearer = materialise(nearer, "mix-nearer")
        kept = fill.join(nearer, fill["source"].eqNullSafe(nearer["source"]), "left_anti")
        extra = kept.select("__rid").unionByName(_by_source(more, nearer).select("__rid")) \
            .unionByName(_by_source(last, nearer).select("__rid"))
        extra = materialise(extra, "mix-extra")
    out = flagged.join(extra.withColumn("__fill", F.lit(1)), "__rid", "left")
    copies = F.col("whole") + F.col("__picked").cast("long") + F.coalesce("__fill", F.lit(0))
    return out.withColumn("copies", copies)


def _up_to_rest(rows: DataFrame) -> DataFrame:
    """``rows(__rid, doc_id, source, size, rest, __y, __k)`` with ``__now``: whether a row comes before
    the first one, in the order of its source, whose running sum oversteps ``rest``."""
    def boundary(sums: DataFrame, slot: str) -> DataFrame:
        """The first slot of each source whose running sum oversteps ``rest``, and the sum before it."""
        run = Window.partitionBy("source").orderBy(slot)
        s = sums.withColumn("__cum", F.col("__before") + F.sum("__s").over(run))
        over = s.where(F.col("__cum") > F.col("rest"))
        return over.groupBy("source").agg(F.min(slot).alias(slot),
                                          F.min(F.col("__cum") - F.col("__s")).alias("__before"))

    need = rows.where("__y IS NOT NULL")
    hi = F.shiftright("__k", BITS)
    one = materialise(boundary(
        need.withColumn("__hi", hi).groupBy("source", "__hi", "rest").agg(F.sum("size").alias("__s"))
        .withColumn("__before", F.lit(0).cast("long")), "__hi"), "mix-slice1")
    near = _by_source(need.withColumn("__hi", hi), one.withColumnRenamed("__hi", "__cut")).where("__hi = __cut")
    two = materialise(boundary(near.groupBy("source", "__k", "rest", "__before").agg(F.sum("size").alias("__s")),
                               "__k"), "mix-slice2")
    last = _by_source(need, two.withColumnRenamed("__k", "__cut")).where("__k = __cut")
    order = Window.partitionBy("source").orderBy("__y", F.col("doc_id").asc_nulls_last(), "size", "__rid")
    inside = last.withColumn("__cum", F.col("__before") + F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__cum") <= F.col("rest"))
    inside = materialise(inside.select("__rid"), "mix-inside")
    flagged = _by_source(rows, two.select("source", F.col("__k").alias("__cut")), "left") \
        .join(inside.withColumn("__in", F.lit(True)), "__rid", "left")
    now = F.col("__y").isNotNull() & (F.col("__cut").isNull() | (F.col("__k") < F.col("__cut"))
                                      | F.col("__in").isNotNull())
    return flagged.withColumn("__now", now).drop("__cut", "__in")


def _nearest(rows: DataFrame, gap: DataFrame) -> DataFrame:
    """One row per source, the one nearest to the missing words ``__gap``, if nearer than none:
    ``source, __rid, __m``, the words it leaves missing or oversteps by."""
    miss = F.abs(F.col("size") - F.col("__gap"))
    return _by_source(rows, gap.select("source", "__gap")).where(miss < F.col("__gap")) \
        .groupBy("source").agg(F.min(F.struct(miss.alias("m"), F.col("__y"), F.col("doc_id").isNull(), F.col("doc_id"),
                                              F.col("__rid").alias("r"))).alias("__f")) \
        .select("source", F.col("__f")["r"].alias("__rid"), F.col("__f")["m"].alias("__m"))


def _carry_on(rows: DataFrame, missed: DataFrame) -> tuple:
    """The order of ``missed(source, __gap, __m)`` behind the overstepping document: ``(source, __rid)``
    of the further rows and ``missed`` with the words then missing. Every round takes a source's rows up
    to the next one that oversteps; from then on rows larger than the missing words stay aside."""
    rows = _by_source(rows.drop("rest"), missed.select("source", F.col("__gap").alias("rest"))).where("size <= rest")
    rows = materialise(rows, "mix-open")
    taken = rows.select("source", "__rid", "size").where("false")
    while not rows.isEmpty():
        now = materialise(_up_to_rest(rows), "mix-more")
        taken = materialise(taken.unionByName(now.where("__now").select("source", "__rid", "size")), "mix-taken")
        rest = now.groupBy("source").agg(
            (F.first("rest") - F.sum(F.when(F.col("__now"), F.col("size")).otherwise(0))).alias("rest"))
        rows = materialise(_by_source(now.where("NOT __now").drop("rest", "__now"), materialise(rest, "mix-rest"))
                           .where("size <= rest"), "mix-open")
    words = materialise(taken.groupBy("source").agg(F.sum("size").alias("__words")), "mix-words")
    left = _by_source(missed, words, "left").withColumn("__gap", F.col("__gap") - F.coalesce("__words", F.lit(0)))
    return taken, materialise(left.drop("__words"), "mix-left")


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join a per-source table (one row per source, written, so its size is known to the planner)."""
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, left["source"].eqNullSafe(right["__source"]), how).drop("__source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        cap: float = 3.0, weight=None, preference=short_first) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Size counts words; null and empty texts have size 0 and are taken 0 words;
    null sources are one source, last in the order of weights; a null id draws
    one fixed number; repeated rows rank together and count each on its own;
    other columns, whatever their names, are ignored; an empty table gives an
    empty result. No row takes more than ``cap`` times its size.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("__rid"), F.col(id_col).alias("doc_id"),
                       F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    out = decide_copies(materialise(rows, "mix-rows"), cap, weight, preference)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                      (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             cap: float = 3.0, weight=None, preference=short_first) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with its own columns.
    Rows without words hold none of a target and are taken as often as their source's whole copies."""
    cols = docs.columns
    full = materialise(docs.withColumns({"__rid": F.monotonically_increasing_id(),
                                         "__size": word_count(text_or_empty(text_col))}), "mix-docs")
    rows = full.select("__rid", F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.col("__size").alias("size"))
    copies = materialise(decide_copies(rows, cap, weight, preference).where("copies > 0")
                         .select("__rid", F.col("copies").alias("__copies")),
                         "mix-copies")
    # a merge join at any size: the table of copies grows with the documents
    joined = full.join(copies.hint("merge"), "__rid")
    return joined.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*cols)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT)
             AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n,
        CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0::DOUBLE * source_size AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
        sum(w) OVER () AS wsum FROM p),
l AS (SELECT *, (total - coalesce(sum(cap) OVER f, 0)) / (wsum - coalesce(sum(w) OVER f, 0)) AS lv FROM c
      WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT lv AS level FROM l WHERE lv * w <= cap ORDER BY cap / w, source NULLS LAST LIMIT 1),
t0 AS (SELECT *, least(cap, w * (SELECT level FROM m)) AS target FROM l),
t AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
        source_size::DOUBLE / n AS mean FROM t0),
r AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest, mean,
        (CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
          + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, u / (1.0::DOUBLE - u) / ((rest / source_size) / (1.0::DOUBLE - rest / source_size)
        * CASE WHEN size = 0 THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, greatest(0.5::DOUBLE, mean / size)) END) AS q
      FROM r WHERE source_size > 0 AND rest > 0),
y AS (SELECT *, q / (1.0::DOUBLE + q) AS y FROM q),
s AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY y, doc_id NULLS LAST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest AS picked FROM y),
g AS (SELECT *, rest - sum(CASE WHEN picked THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM s),
f AS (SELECT *, CASE WHEN NOT picked AND size > 0 AND abs(size - gap) < gap THEN
        row_number() OVER (PARTITION BY source, NOT picked AND size > 0 AND abs(size - gap) < gap
          ORDER BY abs(size - gap), y, doc_id NULLS LAST) END AS fill FROM g)
SELECT r.doc_id, r.size, r.source_size, r.target,
  CAST(r.size * (r.whole + CASE WHEN f.picked THEN 1 ELSE 0 END + CASE WHEN f.fill = 1 THEN 1 ELSE 0 END) AS BIGINT)
    AS taken
FROM r LEFT JOIN f ON r.doc_id = f.doc_id
"""
