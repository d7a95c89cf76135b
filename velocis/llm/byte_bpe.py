"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is split into
pre-tokens on its own, in parallel, from a start that may lie inside a
pre-token. The pattern looks at nothing to the left of a match, so from the
first boundary that a chunk and its successor share inside the overlap, both
agree: that is where they are stitched. The pieces between stitches are then
encoded independently and their ids joined; decoding concatenates the raw
bytes of the ids. Chunks without a shared boundary in the overlap (long runs
of one kind) are joined into one piece, so the result never depends on it.

Inside a piece the text is further cut at each single space between two
non-space characters, always a boundary of the pattern; what lies between
(a *unit*, mostly one word) is encoded once and remembered per worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.common import materialise, text_or_empty
from velocis.session import ship_code

CHUNK = 1 << 15
OVERLAP = 1 << 10
#: Boundaries so near a chunk's end may be an effect of the cut (longest contraction: 3 characters).
MARGIN = 4
#: Units, and pieces, a worker remembers before it starts anew; a bound on memory only.
REMEMBER = 150_000
#: The same for this encoder: as many as a task's text has different ones (about 200 bytes each),
#: or frequent ones are merged anew each time.
REMEMBER_IDS = 400_000
#: The space comes first: ``re`` then searches for it, instead of looking back at every character.
_SAFE_CUT = re.compile(r" (?<=\S )(?=\S)")


_NONE = 1 << 60


def merge(ids: list, pair, made) -> list:
    """Byte-pair merges: always the pair of lowest rank, leftmost first.
    ``pair`` maps ``left << 32 | right`` to the rank of the merge, ``made`` a
    rank to the id it makes."""
    if len(ids) > 64:
        return _merge_long(ids, pair, made)
    get = pair.get
    ranks = [get(a << 32 | b, _NONE) for a, b in zip(ids, ids[1:])]
    while ranks:
        low = min(ranks)
        if low == _NONE:
            break
        at = ranks.index(low)
        ids[at] = new = made[low]
        del ids[at + 1], ranks[at]
        if at < len(ranks):
            ranks[at] = get(new << 32 | ids[at + 1], _NONE)
        if at:
            ranks[at - 1] = get(ids[at - 1] << 32 | new, _NONE)
    return ids


def _merge_long(ids: list, pair, made) -> list:
    """The same with a heap of pairs, for pieces of any length."""
    n = len(ids)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = nxt[i]
        if j < n:
            r = pair.get(ids[i] << 32 | ids[j])
            if r is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

    for i in range(n):
        offer(i)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = nxt[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made[r], -1
        nxt[i] = nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return [x for x in ids if x >= 0]


class Encoder:
    """A rank file (base64 token, rank per line) and its pre-token pattern."""

    def __init__(self, raw: bytes, pattern: str):
        import regex
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.packed = {t: r.to_bytes(4, "little") for t, r in rank.items()}
        self.tokens = [b""] * (max(rank.values()) + 1)
        for t, r in rank.items():
            self.tokens[r] = t
        # every way to make a token of two; its rank is its id
        self.pair = {rank[t[:i]] << 32 | rank[t[i:]]: r for t, r in rank.items()
                     for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank}
        self.byte = [rank[bytes([b])] for b in range(256)]
        self.ids = range(len(self.tokens))
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the memory back: the worker process stays when its task is done."""
        self.known.clear()
        self.pieces.clear()

    def boundaries(self, text: str) -> list:
        """Ends of the pre-tokens."""
        return [m.end() for m in self.pattern.finditer(text)]

    def _piece(self, piece: str) -> bytes:
        b = piece.encode()
        ids = self.packed.get(b)
        if ids is None:
            ids = array("I", merge([self.byte[x] for x in b], self.pair, self.ids)).tobytes()
        if len(piece) <= 64:
            if len(self.pieces) >= REMEMBER_IDS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _unit(self, unit: str) -> bytes:
        get = self.pieces.get
        ids = b"".join([get(p) or self._piece(p) for p in self.pattern.findall(unit)])
        if len(unit) <= 64:
            if len(self.known) >= REMEMBER_IDS:
                self.known.clear()
            self.known[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *rest = _SAFE_CUT.split(text)
        known, out = self.known, [self._unit(first)]
        for u in rest:
            u = " " + u
            ids = known.get(u)
            out.append(self._unit(u) if ids is None else ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(raw: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and rank file."""
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw, pattern)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids`` (little-endian unsigned
    32-bit integers, binary) ``, decoded_sha256`` (of the ids decoded again).

    ``rank_file`` is read by the driver and broadcast (a vocabulary, a few MB).
    Null and empty texts have no ids; null ids and repeated rows are encoded
    like any others; other columns are ignored, whatever their names; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with open(rank_file, "rb") as f:
        raw = spark.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def finish(ids, enc):
        return len(ids) // 4, hashlib.sha256(enc.decode(ids)).hexdigest()

    def whole(batches):
        import pyarrow as pa
        from velocis.llm.byte_bpe import encoder
        enc = encoder(raw.value, pattern)
        for b in batches:
            ids = [enc.encode(t) for t in b.column("text").to_pylist()]
            n, sha = zip(*(finish(x, enc) for x in ids)) if ids else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256"])
        enc.forget()

    schema = f"doc_id {id_type}, n_tokens long, ids binary, decoded_sha256 string"
    short = d.where(F.char_length("text") <= chunk).mapInArrow(whole, schema)

    # 1. chunks [c * chunk, (c + 1) * chunk + overlap) of the long texts
    length = F.char_length("text")
    cut = d.where(length > chunk).withColumns({"rid": F.monotonically_increasing_id(), "len": length}) \
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.floor((F.col("len") - 1) / chunk).cast("int")))) \
        .select("rid", "doc_id", "len", "c",
                F.substring("text", F.col("c") * chunk + 1, F.lit(chunk + overlap)).alias("part"))

    def split_chunks(batches):
        import pyarrow as pa
        from velocis.llm.byte_bpe import encoder
        enc = encoder(raw.value, pattern)
        for b in batches:
            head, tail = [], []
            for c, n, part in zip(b.column("c").to_pylist(), b.column("len").to_pylist(),
                                  b.column("part").to_pylist()):
                at, last = c * chunk, c * chunk + len(part) >= n
                ends = [e for e in enc.boundaries(part) if last or e <= len(part) - MARGIN]
                head.append([at + e for e in ends if e < overlap])
                tail.append([at + e for e in ends if e >= chunk])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))],
                names=[*b.schema.names, "head", "tail"])

    # chunks are dealt out evenly first: the text of one document goes to many tasks
    parts = cut.repartition("rid", "c").mapInArrow(
        split_chunks, cut.schema.simpleString()[7:-1] + ",head:array<bigint>,tail:array<bigint>")
    parts = materialise(parts, "bpe-chunks")

    # 2. stitch each chunk to the next at the first boundary both have
    from pyspark.sql import Window
    order = Window.partitionBy("rid").orderBy("c")
    marks = parts.select("rid", "c", F.array_min(F.array_intersect("tail", F.lead("head").over(order))).alias("to"))
    marks = marks.withColumn("from", F.coalesce(F.lag("to").over(order), F.lit(0).cast("long")))
    # a chunk that does not meet its successor is joined with it into one piece
    opens = F.when((F.col("c") == 0) | F.lag("to").over(order).isNotNull(), 1).otherwise(0)
    marks = marks.withColumn("piece", F.sum(opens).over(order))
    pieces = parts.drop("head", "tail").join(marks, ["rid", "c"]).groupBy("rid", "piece").agg(
        F.first("doc_id").alias("doc_id"), F.max("from").alias("from"), F.min("c").alias("c0"),
        F.max(F.struct("c", F.coalesce("to", "len").alias("to")))["to"].alias("to"),
        F.transform(F.sort_array(F.collect_list(F.struct("c", "part"))), lambda x: x["part"]).alias("parts"))

    # 3. encode the pieces, 4. join the ids of a document and decode them
    def encode_pieces(batches):
        import pyarrow as pa
        from velocis.llm.byte_bpe import encoder
        enc = encoder(raw.value, pattern)
        for b in batches:
            ids = []
            for r in b.to_pylist():
                text = "".join([*(p[:chunk] for p in r["parts"][:-1]), r["parts"][-1]])
                at = r["c0"] * chunk
                ids.append(enc.encode(text[r["from"] - at:r["to"] - at]))
            yield pa.RecordBatch.from_arrays(
                [b.column("rid"), b.column("piece"), b.column("doc_id"), pa.array(ids, pa.binary())],
                names=["rid", "piece", "doc_id", "ids"])
        enc.forget()

    encoded = pieces.mapInArrow(encode_pieces, f"rid long, piece long, doc_id {id_type}, ids binary")
    joined = encoded.groupBy("rid").agg(F.first("doc_id").alias("doc_id"),
                                        F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))

    def join_ids(batches):
        import pyarrow as pa
        from velocis.llm.byte_bpe import encoder
        enc = encoder(raw.value, pattern)
        for b in batches:
            ids = [b"".join(x["ids"] for x in p) for p in b.column("p").to_pylist()]
            n, sha = zip(*(finish(x, enc) for x in ids)) if ids else ((), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return short.unionByName(joined.mapInArrow(join_ids, schema))
