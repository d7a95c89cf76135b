"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges once: those that
come out as one token are *proved whole*. A pre-token that is proved whole is
counted as one without merging; only the rest is merged. As in ``byte_bpe`` the
text is cut at single spaces between non-space characters (always pre-token
boundaries) and the count of each such unit is remembered per worker.
"""

from __future__ import annotations

import hashlib
import json
import pickle

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.byte_bpe import REMEMBER, _SAFE_CUT, merge
from velocis.llm.common import text_or_empty
from velocis.session import ship_code


def byte_letters() -> dict:
    """The printable letter that byte-level vocabularies write for each byte:
    printable Latin-1 stands for itself, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole(tokenizer_json: str) -> dict:
    """A byte-level BPE ``tokenizer.json`` -> merges by rank, the vocabulary
    strings that encode alone as one token, and the added tokens."""
    spec = json.loads(tokenizer_json)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError("only byte-level BPE without normaliser or prefix space")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens must be plain strings")
    letter = byte_letters()

    def raw(s):
        return bytes(letter[c] for c in s)

    vocab = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    pair = {vocab[a] << 32 | vocab[b]: i for i, (a, b) in enumerate(merges)}
    made = [vocab[a + b] for a, b in merges]
    byte = [0] * 256
    for c, b in letter.items():
        byte[b] = vocab[c]
    added = [t["content"] for t in spec["added_tokens"]]
    whole = {t for t in (raw(s) for s in vocab if s not in added)
             if len(merge([byte[b] for b in t], pair, made)) == 1}
    return {"pair": pair, "made": made, "byte": byte, "whole": whole, "added": added}


class Counter:
    def __init__(self, proved: dict, pattern: str):
        import regex
        self.pair, self.made, self.byte = proved["pair"], proved["made"], proved["byte"]
        self.whole = proved["whole"]
        self.pattern = regex.compile(pattern)
        # leftmost, longest first, as the library finds added tokens
        added = sorted(proved["added"], key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def _piece(self, piece: str) -> int:
        b = piece.encode()
        n = 1 if b in self.whole else len(merge([self.byte[x] for x in b], self.pair, self.made))
        if len(piece) <= 64:
            if len(self.pieces) >= REMEMBER:
                self.pieces.clear()
            self.pieces[piece] = n
        return n

    def _unit(self, unit: str) -> int:
        get = self.pieces.get
        n = sum([get(p) or self._piece(p) for p in self.pattern.findall(unit)])
        if len(unit) <= 64:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[unit] = n
        return n

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = _SAFE_CUT.split(text)
        n, known = self._unit(first), self.known
        for u in rest:
            u = " " + u
            k = known.get(u)
            n += self._unit(u) if k is None else k
        return n

    def forget(self) -> None:
        """Give the memory back: the worker process stays when its task is done."""
        self.known.clear()
        self.pieces.clear()

    def count(self, text: str) -> int:
        if self.added is None:
            return self._plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


_COUNTERS: dict[str, Counter] = {}


def counter(raw: bytes, pattern: str) -> Counter:
    """One counter per worker process and vocabulary."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(pickle.loads(raw), pattern)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer_file`` is read by the driver, proved once and broadcast (a
    vocabulary, a few MB). Added tokens found in a text count as one token
    each. Null and empty texts have 0 bytes and tokens; null ids and repeated
    rows are counted like any others; other columns are ignored, whatever
    their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship_code(spark)
    with open(tokenizer_file, encoding="utf-8") as f:
        proved = spark.sparkContext.broadcast(pickle.dumps(prove_whole(f.read())))
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        import pyarrow as pa
        from velocis.llm.token_counts import counter
        c = counter(proved.value, pattern)
        for b in batches:
            n = [c.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
        c.forget()

    text = text_or_empty(text_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                    text.alias("text"))
    return d.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long") \
        .withColumn("over_limit", F.col("n_tokens") > limit)
