"""Substring deduplication with difference-cover anchors.

A *window* is ``window`` consecutive words of one document. A word goes when a
window that covers it has the same words as a window that starts earlier.

The positions i (counted in the document) with i mod 13 in {0, 1, 3, 9} are a
difference cover: for any two positions there is one shift below 13 that puts
both on it. So two equal windows of 20 words share an equal *anchor* of
20 - 12 = 8 words that starts on the cover in both. Only anchors (4 of 13
positions) are hashed and exchanged; where an anchor occurs anywhere else, the
windows around it are extended to full length and compared by 128-bit hashes
of their words.

Spread: documents are put in order of id and packed into blocks of a few MB;
a block is the unit of work. A block sends each different hash once, as sorted
64-bit numbers cut into buckets by their top bits, and gets one bit back for
each; a phrase that a third of all documents share costs one number per block,
and no pair of occurrences is ever formed. Since blocks are in order, "starts
earlier" needs no positions: the first block that has a window keeps it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.common import materialise, shuffle_partitions, text_or_empty
from velocis.session import ship_code

#: A perfect difference set modulo 13.
PERIOD = 13
COVER = (0, 1, 3, 9)
BLOCK_BYTES = 4 << 20
PARTITION_BYTES = 32 << 20
#: Hashes a bucket should hold.
BUCKET = 1 << 20


# ---- inside a block ---------------------------------------------------------

def pack(texts: list) -> tuple:
    import zstandard
    return (np.array([len(t) for t in texts], np.int64).tobytes(),
            zstandard.ZstdCompressor(level=3).compress(b"".join(texts)))


def unpack(lens: bytes, body: bytes) -> list:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(body)
    ends = np.cumsum(np.frombuffer(lens, np.int64))
    return [raw[e - n:e] for e, n in zip(ends.tolist(), np.frombuffer(lens, np.int64).tolist())]


class Block:
    """The words of a block's documents, one after another."""

    def __init__(self, texts: list):
        from xxhash import xxh3_64_intdigest
        self.words, self.doc_end = [], []
        for t in texts:
            self.words += t.split()
            self.doc_end.append(len(self.words))
        n = len(self.words)
        self.n = n
        self.hash = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, n)
        ends = np.array(self.doc_end, np.int64)
        counts = np.diff(np.r_[0, ends])
        #: words left in the document from here, this one included; place in the document
        self.left = np.repeat(ends, counts) - np.arange(n)
        self.place = np.arange(n) - np.repeat(ends - counts, counts)

    def run_hash(self, at: np.ndarray, length: int, seed: int) -> np.ndarray:
        """A 64-bit hash of the ``length`` words that start at each position."""
        rng = np.random.default_rng(seed)
        mul = rng.integers(1, 1 << 63, size=length, dtype=np.uint64) | np.uint64(1)
        out = np.zeros(len(at), np.uint64)
        for k in range(length):
            x = self.hash[at + k] * mul[k]
            out += (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def anchors(self, window: int) -> tuple:
        """Positions of the anchors, their different hashes (sorted), for each
        anchor the index of its hash, and which hashes the block has twice."""
        length = window - PERIOD + 1
        on = np.isin(self.place % PERIOD, COVER) & (self.left >= length)
        at = np.flatnonzero(on)
        uniq, which, count = np.unique(self.run_hash(at, length, 1), return_inverse=True, return_counts=True)
        return at, uniq, which, count > 1

    def candidates(self, window: int, repeated: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple:
        """Windows that hold a repeated anchor: their starts, the different
        128-bit hashes (sorted by the first half), the index of each window's
        hash and the first window with it."""
        hit = at[repeated[which]]
        cover = np.zeros(self.n + 1, np.int64)
        # the windows around an anchor start at most PERIOD - 1 words before it, in the same document
        np.add.at(cover, hit - np.minimum(self.place[hit], PERIOD - 1), 1)
        np.add.at(cover, hit + 1, -1)
        start = np.flatnonzero((np.cumsum(cover)[:-1] > 0) & (self.left >= window))
        h = np.empty(len(start), dtype=[("a", np.uint64), ("b", np.uint64)])
        h["a"], h["b"] = self.run_hash(start, window, 2), self.run_hash(start, window, 3)
        order = np.lexsort((start, h["b"], h["a"]))
        s = h[order]
        new = np.r_[True, (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])][:len(s)]
        which_w = np.empty(len(start), np.int64)
        which_w[order] = np.cumsum(new) - 1
        first = np.zeros(len(start), bool)
        first[order[new]] = True
        return start, s[new], which_w, first


def send(block: int, uniq: np.ndarray, top: np.ndarray, bits: int):
    """Cut sorted hashes into buckets by the top bits: ``(bucket, block, blob)``."""
    bucket = (top >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(uniq)] if len(edge) else []):
        yield int(bucket[lo]), block, uniq[lo:hi].tobytes()


def received(parts: list, n: int) -> np.ndarray:
    """The bits of a block's buckets, in bucket order -> one flag per hash it sent."""
    out = [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]).astype(bool) for p in parts or ()]
    flags = np.concatenate(out) if out else np.zeros(0, bool)
    if len(flags) != n:
        raise ValueError("a block's flags do not match its hashes")
    return flags


def meet(blocks: np.ndarray, blobs: list, width: int, earlier: bool) -> list:
    """One bucket: for each hash of each blob, whether another (``earlier``: a
    smaller) block sent it too."""
    kind = np.dtype(np.uint64) if width == 8 else np.dtype([("a", np.uint64), ("b", np.uint64)])
    arrays = [np.frombuffer(b, kind) for b in blobs]
    sizes = np.array([len(a) for a in arrays])
    all_h = np.concatenate(arrays)
    owner = np.repeat(np.asarray(blocks), sizes)
    keys = (owner, all_h) if width == 8 else (owner, all_h["b"], all_h["a"])
    order = np.lexsort(keys)
    s = all_h[order]
    same = np.r_[False, s[1:] == s[:-1]]
    hit = same if earlier else same | np.r_[same[1:], False]
    flags = np.zeros(len(all_h), bool)
    flags[order] = hit
    ends = np.cumsum(sizes)
    return [(int(n), np.packbits(flags[e - n:e]).tobytes()) for n, e in zip(sizes, ends)]


# ---- over the cluster -------------------------------------------------------

def ordered_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` in order of id, packed: ``block, ids, lens, body``, blocks numbered in order."""
    spark = docs.sparkSession
    ship_code(spark)
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    total = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), -(-total // PARTITION_BYTES))
    keys = [F.col("doc_id").asc_nulls_last(), F.col("h"), F.col("r")]
    d = d.withColumns({"h": F.xxhash64("text"), "r": F.monotonically_increasing_id()}) \
        .repartitionByRange(parts, *keys).sortWithinPartitions(*keys) \
        .select(F.spark_partition_id().cast("long").alias("p"), "doc_id", "text")
    id_type = d.schema["doc_id"].dataType.simpleString()

    def blocks(batches):
        import pyarrow as pa
        from velocis.llm.cover_substring import pack
        kind, part, no, ids, texts, size = None, 0, 0, [], [], 0

        def flush():
            lens, body = pack(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + no], pa.int64()), pa.array([ids], pa.list_(kind)),
                 pa.array([lens], pa.binary()), pa.array([body], pa.binary())], names=["block", "ids", "lens", "body"])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for p, i, t in zip(b.column("p").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                part = p
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= block_bytes:
                    yield flush()
                    no, ids, texts, size = no + 1, [], [], 0
        if ids:
            yield flush()

    return materialise(d.mapInArrow(blocks, f"block long, ids array<{id_type}>, lens binary, body binary"),
                       "cover-blocks")


def _flags(sent: DataFrame, bits: int, width: int, earlier: bool, name: str) -> DataFrame:
    """``sent(bucket, block, blob)`` -> ``block`` and the flags of its buckets in order."""
    def bucket_flags(pdf):
        import pandas as pd
        from velocis.llm.cover_substring import meet
        out = meet(pdf["block"].to_numpy(), list(pdf["blob"]), width, earlier)
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "n": [n for n, _ in out],
                             "bits": [b for _, b in out]})

    flags = sent.groupBy("bucket").applyInPandas(bucket_flags, "block long, bucket long, n int, bits binary")
    per = flags.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias(name))
    return materialise(per, f"cover-{name}")


def repeated_words(blocks: DataFrame, window: int = 20) -> DataFrame:
    """``ordered_blocks`` -> one row per document: ``doc_id, n_words, n_removed, kept`` (the words
    kept, joined by one space, as binary)."""
    spark = blocks.sparkSession
    ship_code(spark)
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    id_type = blocks.schema["ids"].dataType.elementType
    raw = blocks.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    # compressed bytes over 2.5 are about words; 8 byte anchors, BUCKET of them a bucket
    bits = max(int(np.ceil(np.log2(max(shuffle_partitions(spark), raw / 2.5 * len(COVER) / PERIOD / BUCKET, 2)))), 1)
    sent_schema = "bucket long, block long, blob binary"

    def emit(rows, names):
        import pyarrow as pa
        rows = list(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.binary())], names=names)

    def send_anchors(batches):
        from velocis.llm.cover_substring import Block, send, unpack
        for b in batches:
            for r in b.to_pylist():
                _, uniq, _, _ = Block(unpack(r["lens"], r["body"])).anchors(window)
                yield emit(send(r["block"], uniq, uniq, bits), ["bucket", "block", "blob"])

    def windows_of(r):
        from velocis.llm.cover_substring import Block, received, unpack
        k = Block(unpack(r["lens"], r["body"]))
        at, uniq, which, twice = k.anchors(window)
        return k, k.candidates(window, twice | received(r["anchors"], len(uniq)), at, which)

    def send_windows(batches):
        from velocis.llm.cover_substring import send
        for b in batches:
            for r in b.to_pylist():
                _, (_, uniq, _, _) = windows_of(r)
                yield emit(send(r["block"], uniq, uniq["a"], bits), ["bucket", "block", "blob"])

    def remove(batches):
        import pyarrow as pa
        from velocis.llm.cover_substring import received
        for b in batches:
            for r in b.to_pylist():
                k, (start, uniq, which, first) = windows_of(r)
                gone = start[~first | received(r["windows"], len(uniq))[which]]
                cover = np.zeros(k.n + 1, np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, gone + window, -1)
                keep = np.cumsum(cover)[:-1] == 0
                n, removed, kept, lo = [], [], [], 0
                for hi in k.doc_end:
                    mask = keep[lo:hi]
                    left = int(mask.sum())
                    words = k.words[lo:hi] if left == hi - lo else [k.words[i] for i in lo + np.flatnonzero(mask)]
                    n.append(hi - lo)
                    removed.append(hi - lo - left)
                    kept.append(b" ".join(words))
                    lo = hi
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], b.schema.field("ids").type.value_type), pa.array(n, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    anchors = _flags(blocks.select("block", "lens", "body").mapInArrow(send_anchors, sent_schema), bits, 8, False,
                     "anchors")
    with_anchors = blocks.join(anchors, "block", "left")
    windows = _flags(with_anchors.select("block", "lens", "body", "anchors").mapInArrow(send_windows, sent_schema),
                     bits, 16, True, "windows")
    return with_anchors.join(windows, "block", "left").select("ids", "lens", "body", "anchors", "windows").mapInArrow(
        remove, f"doc_id {id_type.simpleString()}, n_words long, n_removed long, kept binary")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_removed, kept``.

    Null and empty texts have no words; a document shorter than ``window``
    loses none; a null id comes after all others, rows with equal ids are
    ordered by their text; of repeated rows the first keeps its words; other
    columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    return repeated_words(ordered_blocks(docs, id_col, text_col, block_bytes), window)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + 19], ' ') ORDER BY doc_id, i) AS rn
      FROM p),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM s, generate_series(0, 19) t(k) WHERE rn > 1),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS pos FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS txt, count(*) AS n
         FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(txt, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
