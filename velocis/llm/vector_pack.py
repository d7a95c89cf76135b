"""Packing examples into sequences: vector bin packing by dot products.

An example asks for a vector of tokens, one segment and loss-bearing tokens; a
sequence has a limit on each. One sequence is filled at a time: of the examples
that fit, the one whose weighted demand has the largest dot product with what is
left of the sequence goes in (weights: the mean demand of the waiting examples,
so the scarce limit counts most). When none fits whole, the best one is cut to
what is left and its rest waits on. A sequence that cannot be filled up (no
segment or loss tokens left, or no more examples) ends at a power of two, where
no padding is due.

Every task packs the rows of its own partition as they stream through a waiting
pool of bounded size: token ids are never shuffled, no example leaves its task,
and a lost task packs the same rows again. The last rows of a partition end in
sequences of powers of two.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.byte_bpe import REMEMBER
from velocis.llm.common import text_or_empty
from velocis.llm.token_counts import byte_letters
from velocis.session import ship_code


@dataclass(frozen=True)
class Limits:
    """Of one sequence. ``tokens`` is a power of two."""
    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens) < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("limits are at least 1, and the token limit is a power of two")


#: Examples and tokens that wait in a task for a place.
POOL_ROWS, POOL_TOKENS = 2048, 4_000_000


class Packer:
    """The waiting pool of one task and the sequences made of it."""

    def __init__(self, limits: Limits, rows: int = POOL_ROWS, tokens: int = POOL_TOKENS):
        self.limits, self.max_rows, self.max_tokens = limits, rows, tokens
        self.limit = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
        self.items: list[tuple] = []  # what each row stands for: (example, start)
        self.length = np.zeros(0, dtype=np.int64)
        self.lead = np.zeros(0, dtype=np.int64)  # tokens before the first that bears loss
        self.new: list[tuple] = []
        self.sequence = 0

    def add(self, example, length: int, lead: int, start: int = 0) -> None:
        """``example`` waits from token ``start`` on: ``length`` tokens, the first ``lead`` without loss."""
        # parts that fill a sequence by themselves are cut off first, so that any that waits fits an empty one
        while length > (part := min(length, self.limits.tokens, lead + self.limits.loss_tokens)):
            self.new.append((example, start, part, min(lead, part)))
            start, length, lead = start + part, length - part, max(lead - part, 0)
        if length:
            self.new.append((example, start, length, lead))

    def _take_in(self) -> None:
        alive = np.flatnonzero(self.length)
        self.items = [self.items[i] for i in alive.tolist()] + [(x[0], x[1]) for x in self.new]
        self.length = np.concatenate([self.length[alive], np.array([x[2] for x in self.new], dtype=np.int64)])
        self.lead = np.concatenate([self.lead[alive], np.array([x[3] for x in self.new], dtype=np.int64)])
        self.new = []

    def full(self) -> bool:
        if len(self.new) + len(self.items) >= self.max_rows:
            return True
        return len(self.new) and sum(x[2] for x in self.new) + int(self.length.sum()) >= self.max_tokens

    def fill(self, everything: bool = False) -> Iterator[tuple]:
        """Sequences until half of the pool (or ``everything``) is placed:
        ``(sequence, [(example, start, length), ...])``."""
        self._take_in()
        rows, tokens = self.max_rows // 2, self.max_tokens // 2
        while (waiting := np.count_nonzero(self.length)) and \
                (everything or waiting >= rows or self.length.sum() >= tokens):
            yield self._one()
            if self.new:
                self._take_in()

    def _one(self) -> tuple:
        size, lead = self.length, self.lead
        loss = np.maximum(size - lead, 0)
        alive = size > 0
        demand = np.stack([size, alive, loss], axis=1) / self.limit
        weight = demand.sum(axis=0) / max(np.count_nonzero(alive), 1)
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens])
        pieces: list[tuple] = []
        while left[0] and left[1]:
            toward = weight * left / self.limit
            fits = alive & (size <= left[0]) & (loss <= left[2])
            if fits.any():
                i = int(np.where(fits, demand @ toward, -1.0).argmax())
                part = int(size[i])
            else:
                part_of = np.where(alive, np.minimum(np.minimum(size, left[0]), lead + left[2]), 0)
                if not part_of.any():
                    break
                part_loss = np.maximum(part_of - lead, 0)
                score = np.stack([part_of, alive, part_loss], axis=1) / self.limit @ toward
                i = int(np.where(part_of > 0, score, -1.0).argmax())
                part = int(part_of[i])
            pieces.append((i, part, int(lead[i])))
            left -= (part, 1, max(part - int(lead[i]), 0))
            alive[i] = False
            if part < size[i]:  # the rest waits for a later sequence
                break
        total = self.limits.tokens - int(left[0])
        surplus = 0 if total & (total - 1) == 0 else total - (1 << (total.bit_length() - 1))
        out = []
        for i, part, _ in pieces:
            out.append([i, part])
        while surplus:  # the last pieces go back
            i, part = out.pop()
            if part > surplus:
                out.append([i, part - surplus])
            surplus -= min(part, surplus)
        placed = []
        for i, part in out:
            example, start = self.items[i]
            placed.append((example, start, part))
            if part < self.length[i]:
                self.items[i] = (example, start + part)
                self.lead[i] = max(self.lead[i] - part, 0)
            self.length[i] -= part
        self.sequence += 1
        return self.sequence - 1, placed


PIECES = "start long, length long, prompt_tokens long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(examples: DataFrame, limits: Limits = Limits(), pool_rows: int = POOL_ROWS,
         pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Examples ``(doc_id, ids binary, prompt_tokens)`` -> one row per piece:
    ``doc_id, start, length, prompt_tokens, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are little-endian unsigned 32-bit integers; the first
    ``prompt_tokens`` of an example (of a piece, in the result) bear no loss.
    Each id lies in exactly one piece; the pieces of a sequence keep all limits
    and lie gapless from offset 0. Null and empty ``ids`` have no piece, null
    prompts are zero; repeated rows and ids are examples of their own, examples
    of any length are cut; an empty table gives no sequence. Sequence ids hold
    the number of the partition above bit 33.
    """
    ship_code(examples.sparkSession)
    id_type = examples.schema["doc_id"].dataType.simpleString()
    e = examples.select("doc_id", "ids", F.col("prompt_tokens").cast("long").alias("prompt_tokens"))
    return e.mapInArrow(packing(limits, pool_rows, pool_tokens), f"doc_id {id_type}, {PIECES}")


def packing(limits: Limits, pool_rows: int = POOL_ROWS, pool_tokens: int = POOL_TOKENS):
    """The work of one task of :func:`pack`: batches of examples to batches of pieces."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from velocis.llm.vector_pack import Packer
        base = TaskContext.get().partitionId() << 33
        packer = Packer(limits, pool_rows, pool_tokens)
        kind = None

        def rows(sequences):
            doc, col, ids = [], [[] for _ in range(6)], []
            for s, placed in sequences:
                offset = 0
                for (key, data, n, prompt), start, length in placed:
                    doc.append(key)
                    for c, v in zip(col, (start, length, min(max(prompt - start, 0), length), n, base + s, offset)):
                        c.append(v)
                    ids.append(data[4 * start:4 * (start + length)])
                    offset += length
                if len(doc) >= 4096:
                    yield batch(doc, col, ids)
                    doc, col, ids = [], [[] for _ in range(6)], []
            yield batch(doc, col, ids)

        def batch(doc, col, ids):
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, kind), *[pa.array(c, pa.int64()) for c in col], pa.array(ids, pa.binary())],
                names=["doc_id", "start", "length", "prompt_tokens", "doc_tokens", "sequence_id", "offset", "ids"])

        for b in batches:
            kind = b.column("doc_id").type
            prompts = b.column("prompt_tokens").to_pylist()
            for key, data, prompt in zip(b.column("doc_id").to_pylist(), b.column("ids"), prompts):
                data = memoryview(data.as_buffer() or b"")
                n = len(data) // 4
                prompt = min(max(prompt or 0, 0), n)
                packer.add((key, bytes(data), n, prompt), n, prompt)
                if packer.full():
                    yield from rows(packer.fill())
        if kind is not None:
            yield from rows(packer.fill(everything=True))

    return run


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: ``sequence_id, n_tokens, n_segments, n_loss_tokens,
    ids`` (the ids of all its pieces, in order). A group has at most the
    limits' segments and tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_segments"),
        F.sum(F.col("length") - F.col("prompt_tokens")).alias("n_loss_tokens"), parts.alias("parts")) \
        .withColumn("ids", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))).drop("parts")


class WordBpe:
    """Ids of a word-end BPE ``tokenizer.json`` (white space dropped, lower case).

    A text of letters and signs below U+0250, none of which composes, is
    lower-cased and split into words here; the library's merges encode each
    word, and its ids are remembered. White space is never part of a token, no
    letter composes with it and added tokens hold none, so other texts are cut
    at spaces into units, and a unit that is not plain goes to the library whole.
    """

    #: No controls but white space, nothing that composes; added tokens start with "<|".
    PLAIN = re.compile("[\t-\r -~\u00a0-\u024f]*")

    def __init__(self, spec_json: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(spec_json)
        spec = json.loads(spec_json)
        model, pre, norm = spec["model"], spec["pre_tokenizer"]["pretokenizers"], spec["normalizer"]["normalizers"]
        split = pre[0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or model["ignore_merges"] or \
                [n["type"] for n in norm] != ["NFC", "Replace", "Lowercase"] or len(pre) != 2 or \
                split["behavior"] != "Removed" or not split["invert"] or pre[1]["use_regex"]:
            raise ValueError("only word-end BPE over lower-cased NFC text")
        if any(t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("added tokens start with <| and take no white space")
        self.merges = self.library.model
        # printable ASCII letters stand for themselves
        self.letters = {b: c for c, b in byte_letters().items()}
        classes = {c: "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == c)
                   for c in "LN"}
        pattern = split["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        for c, chars in classes.items():
            outside, inside = pattern.split("[^")[0], pattern[len(pattern.split("[^")[0]):]
            pattern = outside.replace(rf"\p{{{c}}}", f"[{chars}]") + inside.replace(rf"\p{{{c}}}", chars)
        if r"\p" in pattern:
            raise ValueError("only classes of letters and numbers")
        self.pattern = re.compile(pattern)
        self.words = _Memo(self._word)
        self.units = _Memo(self._unit)

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        if self._plain(unit):
            return self._words(unit)
        return np.array(self.library.encode(unit, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _plain(self, text: str) -> bool:
        return "<|" not in text and self.PLAIN.fullmatch(text) is not None

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text.lower())))

    def encode(self, text: str) -> bytes:
        if self._plain(text):
            return self._words(text)
        return b"".join(map(self.units.__getitem__, text.replace("\n", " ").split(" ")))

    def forget(self) -> None:
        """Give the memory back: the worker process stays when its task is done."""
        self.words.clear()
        self.units.clear()


class _Memo(dict):
    """Remembers what ``make`` gives for short keys, a bounded number of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= 2 * REMEMBER:
                self.clear()
            self[key] = value
        return value


_ENCODERS: dict[str, WordBpe] = {}


def word_bpe(spec_json: str) -> WordBpe:
    """One encoder per worker process and vocabulary."""
    key = hashlib.sha256(spec_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = WordBpe(spec_json)
    return _ENCODERS[key]


def encode_examples(rows: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                    prompt_col: str | None = None, end_id: int = 2) -> DataFrame:
    """``doc_id, ids, prompt_tokens``: the ids of the prompt (if a column is
    named) and the text by ``tokenizer_file``, then ``end_id``.

    The file is read by the driver and broadcast (a vocabulary, a few MB). Null
    prompts and texts are empty, so every row has at least one id; null ids and
    repeated rows are rows like others; other columns are ignored; an empty
    table gives an empty result.
    """
    id_type = rows.schema[id_col].dataType.simpleString()
    return _texts(rows, id_col, text_col, prompt_col) \
        .mapInArrow(encoding(rows, tokenizer_file, end_id), f"doc_id {id_type}, ids binary, prompt_tokens long")


def _texts(rows: DataFrame, id_col: str, text_col: str, prompt_col: str | None) -> DataFrame:
    prompt = text_or_empty(prompt_col) if prompt_col else F.lit("")
    return rows.select(F.col(id_col).alias("doc_id"), prompt.alias("prompt"), text_or_empty(text_col).alias("text"))


def encoding(rows: DataFrame, tokenizer_file: str, end_id: int = 2):
    """The work of one task of :func:`encode_examples`: batches of texts to batches of examples."""
    spark = rows.sparkSession
    ship_code(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def encode(batches):
        import pyarrow as pa
        from velocis.llm.vector_pack import word_bpe
        bpe = word_bpe(spec.value)
        for b in batches:
            prompts = [bpe.encode(p) if p else b"" for p in b.column("prompt").to_pylist()]
            ids = [p + bpe.encode(t) + end for p, t in zip(prompts, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(p) // 4 for p in prompts], pa.int64())],
                names=["doc_id", "ids", "prompt_tokens"])
        bpe.forget()

    return encode


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per answer:
    ``doc_id`` (struct of conversation and turn), ``prompt`` (the turn before,
    if it is a user's, else null) and ``text``. Joined by (conversation, turn),
    so a long conversation is spread by its turns."""
    asked = conversations.where("role = 'user'").groupBy("conv_id", (F.col("turn") + 1).alias("turn")) \
        .agg(F.min("text").alias("prompt"))
    said = conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    return said.join(asked, ["conv_id", "turn"], "left") \
        .select(F.struct("conv_id", "turn").alias("doc_id"), "prompt", "text")


def pack_documents(docs: DataFrame, tokenizer_file: str, limits: Limits = Limits()) -> DataFrame:
    """Every document, all of whose tokens bear loss, packed; see :func:`pack`.
    One task encodes and packs, so that ids do not leave Python in between."""
    encode, run = encoding(docs, tokenizer_file), packing(limits)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs, "doc_id", "text", None).mapInArrow(lambda b: run(encode(b)), f"doc_id {id_type}, {PIECES}")
