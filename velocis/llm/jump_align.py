"""Alignment of two tokenizers by pointer jumping.

Both tokenizers cut the same bytes, each token into a range. In order of their
first byte, every token points to the token that reaches farthest among those
overlapping it; doubling the successors (``next = next[next]``) brings every
token, in as many rounds as the logarithm of the longest chain, to the last
token of its component. Tokens with one terminal are one group, which ends where
tokens of both sides end. The arrays hold all texts of a batch at once: ranges
of different texts do not overlap, so a single pass groups them all.

How often a pair of ids is linked in the whole corpus is counted over blocks of
documents: a block keeps the table of its different pairs and each document the
numbers of its pairs in that table. Only the tables are exchanged by pair; their
totals return to the block, once per different pair, and meet its documents
there. No table of all pairs is collected or broadcast.

Texts are encoded in units cut at single spaces between other characters, where
both tokenizers have a boundary (checked on the vocabulary), and the ids of a
unit are remembered per worker.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.byte_bpe import REMEMBER, _SAFE_CUT
from velocis.llm.common import materialise, text_or_empty
from velocis.llm.token_counts import byte_letters
from velocis.session import ship_code

#: Code points, rows and different pairs that a block of documents holds (one more text may exceed the first).
BLOCK_CHARS, BLOCK_ROWS = 8_000_000, 20_000
#: Code points whose tokens are grouped in one pass.
BATCH_CHARS = 1_000_000
#: Fixed value: the sign that stands for a space in sentencepiece.
SPACE_SIGN = "▁"
#: Units of letters and signs below U+0250, without white space or controls behind the first sign.
PLAIN = re.compile(" [!-~¡-ɏ]+")


class Sides:
    """Both tokenizers, the bytes of their tokens, and the ids of units seen.

    A unit begins with a space; side A encodes it as it is, side B without that
    space, which it adds itself.
    """

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        spec = json.loads(a_json)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or \
                spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"]["use_regex"]:
            raise ValueError("side A is byte-level BPE with the usual pre-tokens, without normaliser or prefix space")
        letter = byte_letters()
        entries = {i: t for t, i in spec["model"]["vocab"].items()}
        special = {t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b"" if i in special or i not in entries else bytes(letter[c] for c in entries[i])
                        for i in range(max(entries) + 1)]
        if len({t for t in self.a_bytes if len(t) == 1}) < 256:
            raise ValueError("side A spells every byte")
        self.merges, self.letters = self.a.model, {b: c for c, b in letter.items()}
        # the usual pre-tokens of a unit without white space behind its first sign
        group = {c: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == c)
                 for c in "LN"}
        self.pre_tokens = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{group['L']}]+| ?[{group['N']}]+"
                                     f"| ?[^\\s{group['L']}{group['N']}]+")
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in pieces):
            raise ValueError("a piece of side B goes over a space")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_SIGN, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(t) for t in self.a_bytes])
        self.b_len = np.array([len(t) for t in self.b_bytes])
        n = max(len(self.a_bytes), len(self.b_bytes))
        #: decimal ids with what may follow them
        self.decimals = [f"{i}{s}".encode() for s in ",|;" for i in range(n)]
        self.n = n
        self.known: dict[str, tuple] = {}
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            spelt = word.encode().decode("latin-1").translate(self.letters)
            ids = self.words[word] = array("I", [t.id for t in self.merges.tokenize(spelt)]).tobytes()
        return ids

    def learn(self, units) -> None:
        """Encode units not seen yet; one whose bytes side B changes has no ids."""
        known, bb, word = self.known, self.b_bytes, self._word
        new = [u for u in units if u not in known]
        odd = [u for u in new if not PLAIN.fullmatch(u)]
        a = dict(zip(odd, (e.ids for e in self.a.encode_batch(odd, add_special_tokens=False))))
        for u, y in zip(new, self.b.encode([u[1:] for u in new], num_threads=1)):
            if b"".join([bb[i] for i in y]) != u.encode():
                known[u] = None
            elif u in a:
                known[u] = array("I", a[u]).tobytes(), array("I", y).tobytes()
            else:
                known[u] = b"".join([word(w) for w in self.pre_tokens.findall(u)]), array("I", y).tobytes()

    def encode(self, texts: list[str]) -> list:
        """``(ids of A, ids of B)`` as bytes of each text, None if there are none.

        Sides that change no unit change no text. The only change of B is that
        the sign for a space becomes one, which never makes a text longer, so
        changes in two units cannot make up for each other.
        """
        cut = []
        for t in texts:
            first, *rest = _SAFE_CUT.split(" " + t) if t else [""]
            cut.append([first, *[" " + u for u in rest]] if t else None)
        if len(self.known) >= 2 * REMEMBER:
            self.forget()
        self.learn({u for units in cut if units for u in units})
        out, get = [], self.known.__getitem__
        for units in cut:
            got = list(map(get, units)) if units else [None]
            out.append(None if None in got else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got])))
        return out

    def forget(self) -> None:
        """Give the memory back: the worker process stays when its task is done."""
        self.known.clear()
        self.words.clear()


def terminals(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For ranges sorted by start, none empty: the number of the last
    range of each one's component, components being ranges joined by overlap.

    Every range points to the overlapping one that reaches farthest right (the
    last of them among equals); successors are doubled until they stand."""
    n = len(start)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # the farthest reach up to each range, and the last range that has it
    reach = np.maximum.accumulate(end)
    holder = np.maximum.accumulate(np.where(end == reach, np.arange(n), 0))
    # ranges that begin before this one's end overlap it or lie before it
    succ = holder[np.searchsorted(start, end, side="left") - 1]
    while True:
        then = succ[succ]
        if np.array_equal(then, succ):
            return succ
        succ = then


def align(sides: Sides, ids: list[tuple[bytes, bytes]]) -> list[dict]:
    """Groups and links of texts given as ids of both sides."""
    n_a = np.array([len(a) // 4 for a, _ in ids])
    n_b = np.array([len(b) // 4 for _, b in ids])
    a = np.frombuffer(b"".join([a for a, _ in ids]), dtype="<u4").astype(np.int64)
    b = np.frombuffer(b"".join([b for _, b in ids]), dtype="<u4").astype(np.int64)
    # both sides spell the same bytes, so offsets go on from text to text
    a_end, b_end = np.cumsum(sides.a_len[a]), np.cumsum(sides.b_len[b])
    tok, end = np.concatenate([a, b]), np.concatenate([a_end, b_end])
    start = np.concatenate([a_end - sides.a_len[a], b_end - sides.b_len[b]])
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(a), len(b)])
    order = np.argsort(start, kind="stable")  # a merge of two sorted runs
    last = np.empty(len(tok), dtype=np.int64)
    last[order] = terminals(start[order], end[order])
    # tokens by group, side and place
    place = np.argsort(last * 2 + side, kind="stable")
    group, side, tok = last[place], side[place], tok[place]
    new_group = np.ones(len(tok), dtype=bool)
    new_group[:-1] = group[1:] != group[:-1]
    new_side = new_group.copy()
    new_side[:-1] |= side[1:] != side[:-1]
    after = np.where(new_group, 2, np.where(new_side, 1, 0))
    words = list(map(sides.decimals.__getitem__, (after * sides.n + tok).tolist()))
    # links: tokens of both sides that end together
    at_b = np.searchsorted(b_end, a_end)
    at_a = np.flatnonzero(b_end[at_b] == a_end)
    at_b = at_b[at_a]
    pair = a[at_a] << 32 | b[at_b]
    tokens_upto = np.r_[0, np.cumsum(n_a + n_b)]
    links_upto = np.searchsorted(at_a, np.r_[0, np.cumsum(n_a)])
    groups_upto = np.r_[0, np.cumsum(new_group)][tokens_upto]
    out = []
    for i in range(len(ids)):
        text = b"".join(words[tokens_upto[i]:tokens_upto[i + 1]])[:-1]
        out.append({"n_a": int(n_a[i]), "n_b": int(n_b[i]), "n_groups": int(groups_upto[i + 1] - groups_upto[i]),
                    "groups": text, "pairs": pair[links_upto[i]:links_upto[i + 1]]})
    return out


_SIDES: dict[str, Sides] = {}


def sides(a_json: str, b_model: bytes) -> Sides:
    """Both tokenizers once per worker process."""
    key = hashlib.sha256(a_json.encode() + b_model).hexdigest()
    if key not in _SIDES:
        _SIDES[key] = Sides(a_json, b_model)
    return _SIDES[key]


class Block:
    """Documents of one block: their results, and the different pairs they link."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.chars = 0

    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.rows) >= BLOCK_ROWS

    def table(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Different pairs, how often each is linked, and every document's
        links as numbers into them (sorted, as differences, compressed)."""
        press = zstandard.ZstdCompressor(level=1)
        every = np.concatenate(self.pairs) if self.pairs else np.zeros(0, np.int64)
        pair, at, n = np.unique(every, return_inverse=True, return_counts=True)
        blobs, s = [], 0
        for p in self.pairs:
            number = np.sort(at[s:s + len(p)])
            s += len(p)
            blobs.append(press.compress(np.diff(number, prepend=0).astype("<u4").tobytes()))
        return pair, n, blobs


def aligned_blocks(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                   keep_groups: bool = False) -> DataFrame:
    """One row per document: ``block, doc_id, n_a, n_b, n_groups, n_links,
    groups_sha256, groups, links`` (``groups`` only if kept), and one row per
    block with its ``pairs`` and their ``counts``."""
    spark = docs.sparkSession
    ship_code(spark)
    with open(a_file, encoding="utf-8") as f:
        a_json = f.read()
    with open(b_file, "rb") as f:
        files = spark.sparkContext.broadcast((a_json, f.read()))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        from velocis.llm import jump_align
        two = jump_align.sides(*files.value)
        base, number = TaskContext.get().partitionId() << 33, 0
        block, kind = jump_align.Block(), pa.null()
        none = np.zeros(0, np.int64)

        def add(keys, texts):
            got = two.encode(texts)
            there = [i for i, g in enumerate(got) if g is not None]
            done = dict(zip(there, jump_align.align(two, [got[i] for i in there]) if there else []))
            for i, (k, t) in enumerate(zip(keys, texts)):
                d = done.get(i)
                if d is None:
                    block.rows.append((k, 0, 0, 0, 0, "", b""))
                    block.pairs.append(none)
                else:
                    block.rows.append((k, d["n_a"], d["n_b"], d["n_groups"], len(d["pairs"]),
                                       hashlib.sha256(d["groups"]).hexdigest(), d["groups"] if keep_groups else b""))
                    block.pairs.append(d["pairs"])
                block.chars += len(t)

        def out():
            pair, n, blobs = block.table()
            cols = list(zip(*block.rows)) + [blobs]
            m = len(blobs)
            nothing = pa.nulls(m, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + number] * m, pa.int64()), pa.array(cols[0], kind),
                 *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array(cols[5], pa.string()),
                 pa.array(cols[6], pa.binary()), pa.array(cols[7], pa.binary()), nothing, nothing], names=names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + number], pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4,
                 pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                 pa.array([pair.tolist()], pa.list_(pa.int64())), pa.array([n.tolist()], pa.list_(pa.int64()))],
                names=names)

        for b in batches:
            kind = b.column("doc_id").type
            keys, texts, chars = [], [], 0
            for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                keys.append(k)
                texts.append(t)
                chars += len(t)
                if chars >= BATCH_CHARS:
                    add(keys, texts)
                    keys, texts, chars = [], [], 0
                    if block.full():
                        yield from out()
                        block, number = jump_align.Block(), number + 1
            add(keys, texts)
            if block.full():
                yield from out()
                block, number = jump_align.Block(), number + 1
        if block.rows:
            yield from out()
        two.forget()

    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "links", "pairs",
             "counts"]
    schema = (f"block long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "groups binary, links binary, pairs array<long>, counts array<long>")
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return d.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, total, best``: how often each pair of ids is linked in all
    blocks, and whether no pair with the same B id is linked more often."""
    per = blocks.where("pairs IS NOT NULL") \
        .select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")) \
        .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total"))
    per = per.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = per.groupBy("b").agg(F.max("total").alias("top"))
    return per.join(top.hint("merge"), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text",
                     keep_groups: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256`` (and ``groups`` with ``keep_groups``).

    Null and empty texts, and texts that a side does not spell byte for byte,
    have zeros and no groups. Null ids and repeated rows are documents like
    others; very long texts are read whole, in one task; other columns are
    ignored; an empty table gives an empty result.
    """
    blocks = materialise(aligned_blocks(docs, a_file, b_file, id_col, text_col, keep_groups), "aligned")
    totals = materialise(pair_counts(blocks), "pairs")
    asked = blocks.where("pairs IS NOT NULL").select("block", F.posexplode("pairs").alias("at", "pair"))
    # a merge join at any size: the totals are never broadcast
    told = asked.join(totals.hint("merge"), "pair").select(F.col("block").alias("of"), "at", "total", "best")
    id_type = docs.schema[id_col].dataType.simpleString()

    def finish(documents, table):
        import pyarrow as pa
        at = table.column("at").to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        total[at], best[at] = table.column("total").to_numpy(), table.column("best").to_numpy()
        n_best, count_sum = [], []
        read = zstandard.ZstdDecompressor()
        for blob in documents.column("links").to_pylist():
            number = np.cumsum(np.frombuffer(read.decompress(blob) if blob else b"", dtype="<u4").astype(np.int64))
            n_best.append(int(best[number].sum()))
            count_sum.append(int(total[number].sum()))
        return pa.table([documents.column(c) for c in kept]
                        + [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())],
                        names=[*kept, "n_best", "count_sum"])

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if keep_groups else [])]
    rows = blocks.where("pairs IS NULL").select("block", "links", *kept)
    schema = (f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              + ("groups binary, " if keep_groups else "") + "n_best long, count_sum long")
    out = rows.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(finish, schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
                      *(["groups"] if keep_groups else []))
