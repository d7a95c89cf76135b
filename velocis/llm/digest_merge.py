"""Exact deduplication by a tree merge of sorted digest runs (DataFrame functions only).

Every input partition is a *run*: its digests, combined per digest. Runs are
then merged in binomial rounds: in each round ``fan_in`` neighbouring runs
become one, every digest keeping its best row and its count. A run is always
dealt over all partitions by digest, so each round exchanges one row per
(run, digest) and no run is ever gathered in one task; the sort-based
aggregation merges the sorted pieces. A group of copies that holds a third of
all rows is combined inside each run before the first exchange.

"Verified": rows merge only if the SHA-256 of the normalised text, its length
in bytes and an independent 64-bit hash of it all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velocis.llm.common import WHITE, materialise, shuffle_partitions, text_or_empty

_KEY = ["__sha", "__bytes", "__check"]


def normalised(text: Column) -> Column:
    """The text without any of the white-space characters ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_replace(text, f"[{WHITE}]+", "")


def _with_digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.withColumns({"__text": text_or_empty(text_col), "__rid": F.monotonically_increasing_id(),
                          "__run": F.spark_partition_id()})
    d = d.withColumn("__norm", normalised(F.col("__text")))
    return d.withColumns({
        "__sha": F.unhex(F.sha2("__norm", 256)),
        "__bytes": F.octet_length("__norm"),
        "__check": F.xxhash64("__norm"),
        # smallest first: most code points, then smallest id (null last), then the row itself
        "__best": F.struct((-F.char_length("__text")).alias("l"), F.col(id_col).isNull().alias("n"),
                           F.col(id_col).alias("i"), F.col("__rid").alias("r")),
    }).drop("__norm", "__text")


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """``rows(__run, key, __best)`` -> one row per key with ``__best`` and ``__n``,
    merged in rounds of ``fan_in`` runs."""
    runs = fan_in
    while runs < shuffle_partitions(rows.sparkSession):
        runs *= fan_in
    merged = (rows.withColumn("__run", F.col("__run") % runs).groupBy("__run", *_KEY)
              .agg(F.min("__best").alias("__best"), F.count(F.lit(1)).alias("__n")))
    while runs > 1:
        runs //= fan_in
        level = [F.floor(F.col("__run") / fan_in).alias("__run")] if runs > 1 else []
        merged = (merged.groupBy(*level, *_KEY)
                  .agg(F.min("__best").alias("__best"), F.sum("__n").alias("__n")))
    return merged


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; the row with the most
    code points stays, then the smallest id. Null text counts as empty and
    empty texts are one group; a null id comes after all others; of repeated
    rows (same id, same text) exactly one is kept; other columns, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    rows = materialise(_with_digests(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")),
                                     "doc_id", "text").drop("text"), "digest-rows")
    groups = materialise(merge_runs(rows, fan_in).where("__n > 1"), "digest-groups")
    out = rows.alias("r").join(groups.alias("g"), _KEY, "left")
    best = F.coalesce(F.col("g.__best"), F.col("r.__best"))
    return out.select(
        F.col("doc_id"), best["i"].alias("keep_id"), F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        (best["r"] == F.col("__rid")).alias("kept"), F.lower(F.hex("__sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          fan_in: int = 8) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns (edge cases as in ``exact_dedup``)."""
    cols = docs.columns
    rows = materialise(_with_digests(docs, id_col, text_col), "digest-docs")
    keep = materialise(merge_runs(rows.select("__run", *_KEY, "__best"), fan_in)
                       .select(F.col("__best")["r"].alias("__rid")), "digest-keep")
    # the same plan at every size: whole rows are shuffled once, by their own number
    return rows.join(keep.hint("merge"), "__rid", "left_semi").select(*cols)


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
b AS (
  SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w AS rn
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM b
"""
