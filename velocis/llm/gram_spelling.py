"""Spelling variants by blocked Gram matrices.

One edit changes the letter counts of a word by a squared distance of at most
two: an inserted or deleted letter by one, a replaced one by two. Words meet in
blocks, a block is sorted by length, and for each tile of its rows one NumPy
product of letter counts gives the squared distances to the rows of the same
and the next length. Pairs at most two apart are then verified letter by letter.

So that no block holds the whole vocabulary, the letters are dealt into four
classes of equal use. An edit touches two letters, hence at most two classes:
two words one edit apart agree in all counts of at least two classes. Each
word therefore stands in six blocks, one for every two classes, keyed by its
letters of these classes; a pair is reported in the first block that holds it.
A block of more than ``block_rows`` words is dealt into tiles by hash and one
task takes two tiles, so every pair of the block still meets once.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.common import groups_of, materialise, text_or_empty
from velocis.session import ship_code

CLASSES, KEPT = 4, 2
COMBOS = list(itertools.combinations(range(CLASSES), KEPT))
#: Distinct words a counting task holds before it hands them on.
HELD_WORDS = 400_000
TILE = 256


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                drop_one_in: int = 97) -> DataFrame:
    """``word, n`` of every word of at least ``min_length`` code points.

    Runs are `[A-Za-z\\u00C0-\\u00FF]+`, A-Z lower-cased; a run whose crc32 with
    the document's id is a multiple of ``drop_one_in`` loses one letter (a null
    id is written as nothing). Null texts have no words. Counts are summed per
    task before they are exchanged.
    """
    ship_code(docs.sparkSession)
    run = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def count(batches):
        import pyarrow as pa

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                              names=["word", "n"])

        held: Counter = Counter()
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                start = zlib.crc32(f"{i}:".encode() if i is not None else b":")
                # bytes.lower() changes A-Z alone
                for w, n in Counter(run.findall(text.encode().lower().decode())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % drop_one_in == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_length:
                            continue
                    held[w] += n
                if len(held) >= HELD_WORDS:
                    yield out(held)
                    held.clear()
        yield out(held)

    d = docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text"))
    return d.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_classes(words: DataFrame) -> list[str]:
    """The letters of ``words`` in classes of about equal use: the commonest
    letter first, each into the class used least. One row per letter (of at
    most 90) reaches the driver."""
    used = words.select(F.explode(F.split("word", "")).alias("c")).where("c != ''").groupBy("c").count().collect()
    load, classes = [0] * CLASSES, [""] * CLASSES
    for c, n in sorted(((r["c"], r["count"]) for r in used), key=lambda t: (-t[1], t[0])):
        i = load.index(min(load))
        load[i] += n
        classes[i] += c
    return classes


def blocks(words: DataFrame, classes: list[str], block_rows: int) -> DataFrame:
    """``combo, key, lo, hi, tile, size, word, n``: each word once per two
    classes, in blocks of equal letters of these classes; large blocks as pairs
    of tiles."""
    keys = []
    for i, combo in enumerate(COMBOS):
        other = "".join(c for k, c in enumerate(classes) if k not in combo)
        own = F.array_join(F.array_sort(F.split(F.translate("word", other, "") if other else F.col("word"), "")), "")
        keys.append(F.struct(F.lit(i).alias("combo"), F.xxhash64(F.lit(i), own).alias("key")))
    rows = words.select("word", "n", F.inline(F.array(*keys)))
    hot = rows.groupBy("combo", "key").count().where(F.col("count") > block_rows) \
        .select("combo", "key", F.ceil(F.col("count") / block_rows).cast("int").alias("tiles"))
    tiles = F.coalesce("tiles", F.lit(1))
    r = rows.join(hot, ["combo", "key"], "left") \
        .withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "word"), tiles).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return r.select("combo", "key", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
                    "tile", F.char_length("word").alias("size"), "word", "n")


def one_edit(a: str, b: str) -> bool:
    """Whether ``b`` (not shorter than ``a``) is ``a`` with one letter inserted or replaced."""
    if a == b:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if n == len(b) else a[i:] == b[i + 1:]


def letter_counts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letter counts, and the letters of the columns; in float32 where
    products are exact in it, else in float64."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    letters, col = np.unique(points, return_inverse=True)
    row = np.repeat(np.arange(len(words)), [len(w) for w in words])
    m = len(letters)
    out = np.bincount(row * m + col, minlength=len(words) * m).reshape(len(words), m)
    return out.astype(np.float32 if out.max(initial=0) < 100 else np.float64), letters


class Edits:
    """Verifies pairs: words up to ``WIDE`` letters as arrays, longer ones one by one."""

    WIDE = 48

    def __init__(self, words: list[str], size: np.ndarray):
        self.words, self.size = words, size
        width = min(int(size.max(initial=1)), self.WIDE)
        short = [w if len(w) <= width else "" for w in words]
        # different padding on either side of a pair is not needed: the lengths are compared as well
        self.left = self._matrix([w.ljust(width, "\0") for w in short], width)
        self.right = self._matrix([w[::-1].ljust(width, "\0") for w in short], width)

    @staticmethod
    def _matrix(padded: list[str], width: int) -> np.ndarray:
        # letters are below U+0100
        return np.frombuffer("".join(padded).encode("latin-1"), dtype=np.uint8).reshape(len(padded), width)

    def check(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs (``j`` not shorter, at most one longer) are one edit apart."""
        same = self.left[i] == self.left[j]
        replaced = self.size[i] == self.size[j]
        width = same.shape[1]
        ok = np.zeros(len(i), dtype=bool)
        ok[replaced] = (width - np.count_nonzero(same[replaced], axis=1)) == 1
        k = np.flatnonzero(~replaced)
        prefix = np.where(same[k].all(axis=1), width, same[k].argmin(axis=1))
        back = self.right[i[k]] == self.right[j[k]]
        suffix = np.where(back.all(axis=1), width, back.argmin(axis=1))
        ok[k] = prefix + suffix >= self.size[i[k]]
        for x in np.flatnonzero(self.size[j] > self.WIDE).tolist():
            ok[x] = one_edit(self.words[i[x]], self.words[j[x]])
        return ok


def near_pairs(words: list[str], block: np.ndarray, size: np.ndarray, tile: np.ndarray, split: np.ndarray,
               class_of: dict[int, int], combo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers one edit apart, of rows sorted by (``block``,
    ``size``). ``split`` tells whether a block is two different tiles, in which
    only rows of different ``tile`` meet."""
    counts, letters = letter_counts(words)
    square = np.einsum("ij,ij->i", counts, counts)
    edits = Edits(words, size)
    n = len(words)
    # the last row that a row may meet: same block, at most one longer
    key = block.astype(np.int64) * (int(size.max()) + 3) + size
    last = np.searchsorted(key, key + 1, side="right")
    cls = np.array([class_of[int(c)] for c in letters])
    found = [(np.zeros(0, np.int64),) * 2]
    for s in range(0, n, TILE):
        e = min(s + TILE, n)
        for cs in range(s, int(last[e - 1]), 8 * TILE):
            ce = min(cs + 8 * TILE, int(last[e - 1]))
            # half the squared distance, less what depends on the row alone
            gram = counts[s:e] @ counts[cs:ce].T
            gram -= square[None, cs:ce] / 2
            near = np.flatnonzero(gram >= (square[s:e, None] / 2 - 1))
            i, j = np.divmod(near, ce - cs)
            i, j = i + s, j + cs
            ok = (i < j) & (j < last[i]) & (~split[i] | (tile[i] != tile[j]))
            i, j = i[ok], j[ok]
            ok = edits.check(i, j)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            # the first block that holds the pair reports it
            differ = counts[i] != counts[j]
            changed = np.stack([differ[:, cls == k].any(axis=1) for k in range(CLASSES)], axis=1)
            first = np.argmin(np.stack([changed[:, c].any(axis=1) for c in COMBOS], axis=1), axis=1)
            ok = first == combo[i]
            found.append((i[ok], j[ok]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(words: DataFrame, block_rows: int = 8192) -> DataFrame:
    """``word, near, near_n``: every two words one edit apart, both ways.
    ``words`` is a written table of distinct ``word, n``."""
    spark = words.sparkSession
    ship_code(spark)
    classes = letter_classes(words)
    class_of = {ord(c): k for k, cs in enumerate(classes) for c in cs}

    def pairs(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from velocis.llm.gram_spelling import near_pairs
        for t in groups_of(batches, "block", 4096):
            col = {c: t.column(c).to_numpy() for c in ("block", "size", "tile", "combo", "lo", "hi", "n")}
            w = t.column("word").to_pylist()
            block = np.unique(col["block"], return_inverse=True)[1]
            a, b = near_pairs(w, block, col["size"], col["tile"], col["lo"] != col["hi"], class_of, col["combo"])
            if len(a):
                word = pa.array(w, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [word.take(pa.array(np.r_[a, b])), word.take(pa.array(np.r_[b, a])), pa.array(col["n"][np.r_[b, a]])],
                    names=["word", "near", "near_n"])

    block = F.xxhash64("combo", "key", "lo", "hi")
    rows = blocks(words, classes, block_rows).withColumn("block", block).repartition("block") \
        .sortWithinPartitions("block", "size", "word").select("block", "combo", "lo", "hi", "tile", "size", "word", "n")
    return rows.mapInArrow(pairs, "word string, near string, near_n long")


def follow(forms: DataFrame, longest: int) -> DataFrame:
    """``word, form`` -> ``word, root``: pointers are doubled until chains of
    ``longest`` steps are followed to their end."""
    p = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    steps = 1
    while steps < longest:
        q = p.select(F.col("word").alias("at"), F.col("root").alias("then"))
        p = materialise(p.join(q, F.col("root") == F.col("at"), "left")
                        .select("word", F.coalesce("then", "root").alias("root")), "roots")
        steps *= 2
    return p


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                      min_count: int = 3, drop_one_in: int = 97, times: int = 2, block_rows: int = 8192) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word (one edit away) of largest count, ties to the
    smaller word, if it is at least ``times`` as frequent, else null; ``root``
    follows the forms to the last. Null and empty texts have no words, an empty
    table gives an empty result, repeated rows and ids count as often as they
    come, null ids stand for nothing in the crc32, very long texts and runs are
    read whole, other columns are ignored.
    """
    if times < 2:
        raise ValueError("a form must be at least twice as frequent, or chains would not end")
    words = materialise(count_words(docs, id_col, text_col, min_length, drop_one_in).where(F.col("n") >= min_count),
                        "words")
    top = words.agg(F.max("n")).first()[0] or 1
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = materialise(near_words(words, block_rows).groupBy("word")
                       .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    enough = -F.col("best.less") >= times * F.col("n")
    out = materialise(words.join(near, "word", "left").select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    # counts at least double with every step
    roots = follow(out.where("form IS NOT NULL"), max(1, int(top).bit_length()))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                                                  "n_near", "form_n")
