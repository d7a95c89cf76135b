"""Quality classifier from weak labels.

Heuristic labellers that overlap vote on every document (1 low quality, 0
fine, abstain). Expectation maximisation over the counts of vote patterns - all
documents, at most 3^labellers rows - estimates the share of low quality and
each labeller's accuracy per class. The posterior labels of a bounded sample
train a linear scorer on hashed word-shape features, and the scorer decides on
every document: it also covers documents on which the labellers abstain.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.common import about, text_or_empty
from velocis.session import ship_code

#: About so many documents (by hash) train the scorer; the votes count over all documents.
TRAIN_ROWS = 4000
BUCKETS = 1 << 12
ABSTAIN = 2
_TAIL = re.compile(r"[^\w\s.,;:?'\")\]]{2,}[.,]?$")
_KINDS = re.compile(r"[^\W\d_]+|\d+|_+|\s+")
#: Shapes a worker remembers; a bound on memory only.
REMEMBER = 100_000


class Shapes(dict):
    """What each different word looks like, found once per worker: word -> row of ``table``."""

    def __init__(self):
        super().__init__()
        self.flat = array("q")

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.flat.extend(word_row(word))
        return at

    def forget(self) -> None:
        """Give the memory back: the worker process stays when its task is done."""
        self.clear()
        self.flat = array("q")

    def rows(self, words: list) -> np.ndarray:
        if len(self) > REMEMBER:
            self.forget()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.frombuffer(self.flat, np.int64).reshape(-1, len(COLUMNS))[at]


#: ``shape``: hash of the word's shape; ``lower``: hash of the word in lower case; the rest are counts.
COLUMNS = ("shape", "lower", "symbols", "signs", "tail", "lone", "letters", "capitals", "shout", "closed")


def _letters(s: str) -> str:
    return "a" if s.islower() else "A" if s.isupper() and len(s) > 1 else "x"


def word_row(word: str) -> tuple:
    """Runs of small, capital or mixed letters and of digits are one sign of the shape each, other signs stay."""
    core = word[:-1] if word[-1] in ".," else word
    if core.isalpha():  # most words
        letters = _letters(core)
        capitals = 0 if letters == "a" else len(core) if letters == "A" else sum(map(str.isupper, core))
        return (zlib.crc32((letters + word[len(core):]).encode()), zlib.crc32(word.lower().encode()), 0, len(word), 0,
                0, len(core), capitals, 0, 1)

    def kind(m):
        s = m.group()
        return _letters(s) if s[0].isalpha() else "0" if s[0].isdigit() else "_"

    return (zlib.crc32(_KINDS.sub(kind, word)[:16].encode()), zlib.crc32(word.lower().encode()),
            sum(not (c.isalnum() or c in "_.,") for c in word), len(word), int(_TAIL.search(word) is not None),
            int(not any(map(str.isalnum, word))), sum(map(str.isalpha, word)), sum(map(str.isupper, word)),
            int("!" in word[-3:]), int(word[-1].isalnum() or word[-1] in ".,;:?'\")]"))


_SHAPES = Shapes()


def forget() -> None:
    _SHAPES.forget()


def look(text: str) -> np.ndarray:
    """A row per word of the text, see COLUMNS."""
    return _SHAPES.rows(text.split())


LABELLERS = ("symbols", "tails", "lone signs", "capitals", "repeats", "few different words", "one word", "shouting",
             "open words")


def repeats(t: np.ndarray) -> int:
    """Words that repeat the word before them."""
    return int((t[1:, 1] == t[:-1, 1]).sum())


def votes(t: np.ndarray) -> list:
    """The labellers' votes, in the order of LABELLERS."""
    n = len(t)
    if n < 4:
        return [ABSTAIN] * len(LABELLERS)
    s = dict(zip(COLUMNS, t.sum(axis=0).tolist()))
    same = np.unique(t[:, 1], return_counts=True)[1]

    def vote(low_quality, enough=True):
        return int(low_quality) if enough else ABSTAIN

    return [
        vote(s["symbols"] > 0.10 * (s["signs"] + n), n >= 12),
        vote(s["tail"] > 0.2 * n),
        vote(s["lone"] > 0.15 * n),
        vote(s["capitals"] > 0.5 * s["letters"], s["letters"] >= 20),
        vote(repeats(t) > 0.25 * n, n >= 8),
        vote(len(same) < 0.3 * n, n >= 40),
        vote(same.max() > 0.3 * n, n >= 20),
        vote(s["shout"] > 0.25 * n, n >= 8),
        vote(s["closed"] < 0.6 * n, n >= 8),
    ]


def features(t: np.ndarray) -> np.ndarray:
    """Hashed features, one bucket per word, pair of neighbours and repetition; the
    scorer adds their weights and divides by the number of words."""
    h = t[:, 0].astype(np.uint64)
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) >> np.uint64(20)
    return np.concatenate([h % np.uint64(BUCKETS - 1), pair % np.uint64(BUCKETS - 1),
                           np.full(repeats(t), BUCKETS - 1, np.uint64)]).astype(np.int64)


def pattern_of(v: list) -> int:
    out = 0
    for x in v:
        out = out * 3 + x
    return out


def estimate(counts: dict, labellers: int = len(LABELLERS), rounds: int = 200) -> tuple:
    """EM over ``{pattern: documents}``: the share of low quality, and per labeller
    and class (0 fine, 1 low) the probability of each vote. Smoothing by ten
    pseudo-documents that lean to "labellers are rarely wrong" keeps the classes apart."""
    keys = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in keys.tolist()], float)
    v = np.stack([keys // 3 ** (labellers - 1 - i) % 3 for i in range(labellers)], 1) if len(keys) else \
        np.zeros((0, labellers), int)
    prior = np.zeros((labellers, 2, 3))
    prior[:, 0] = (9.5, 0.1, 0.4)
    prior[:, 1] = (5.0, 4.6, 0.4)
    one = np.eye(3)[v]
    low = (v == 1).any(1) * 0.9 + 0.02
    share, table = 0.1, prior / prior.sum(2, keepdims=True)
    for _ in range(rounds):
        both = np.stack([n * (1 - low), n * low])
        share = (both[1].sum() + 1) / (n.sum() + 10)
        table = np.einsum("cp,plv->lcv", both, one) + prior
        table /= table.sum(2, keepdims=True)
        new = posterior(v, share, table)
        if len(low) == 0 or np.abs(new - low).max() < 1e-9:
            break
        low = new
    return share, table


def posterior(v: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability of low quality for rows of votes."""
    logs = np.log(table)
    at = np.arange(table.shape[0])
    lo = np.log([1 - share, share])[None, :] + sum(logs[i][:, v[:, i]].T for i in at)
    return 1 / (1 + np.exp(np.clip(lo[:, 0] - lo[:, 1], -60, 60)))


def train_scorer(rows: list, epochs: int = 10, seed: int = 5) -> np.ndarray:
    """Logistic regression (Adagrad, sparse) on ``(buckets, shares, target, weight)``;
    returns BUCKETS weights and the bias. Classes weigh the same."""
    w, g2 = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    rng = np.random.default_rng(seed)
    target = np.array([r[2] for r in rows])
    heavy = max(target.sum(), 1e-9), max((1 - target).sum(), 1e-9)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, share, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[idx] @ share + w[-1], -60, 60)))
            g = (1 - y) * p * len(rows) / (2 * heavy[1]) - y * (1 - p) * len(rows) / (2 * heavy[0])
            grad = g * share + 1e-6 * w[idx]
            g2[idx] += grad * grad
            w[idx] -= 0.5 * grad / np.sqrt(g2[idx])
            g2[-1] += g * g
            w[-1] -= 0.5 * g / np.sqrt(g2[-1])
    return w


def score(w: np.ndarray, buckets: np.ndarray, words: int) -> float:
    z = w[buckets].sum() / max(words, 1) + w[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> dict:
    """Votes of all documents, EM on their pattern counts, scorer on about ``train_rows`` documents."""
    spark = docs.sparkSession
    ship_code(spark)
    d = docs.select(text_or_empty(text_col).alias("text"))

    def patterns(batches):
        from collections import Counter

        import pyarrow as pa
        from velocis.llm.weak_quality import forget, look, pattern_of, votes
        c = Counter()
        for b in batches:
            c.update(pattern_of(votes(look(t))) for t in b.column("text").to_pylist())
        forget()
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())],
                                         names=["pattern", "n"])

    counts = {r[0]: r[1] for r in d.mapInArrow(patterns, "pattern long, n long").groupBy("pattern")
              .agg(F.sum("n")).collect()}  # at most 3^9 rows
    share, table = estimate(counts)
    total = sum(counts.values())

    def sample(batches):
        import pyarrow as pa
        from velocis.llm.weak_quality import features, look, posterior, votes
        for b in batches:
            idx, val, y = [], [], []
            for t in b.column("text").to_pylist():
                seen = look(t)
                if len(seen):
                    u, c = np.unique(features(seen), return_counts=True)
                    idx.append(u)
                    val.append(c / len(seen))
                    y.append(float(posterior(np.array([votes(seen)]), share, table)[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(idx, pa.list_(pa.int64())), pa.array(val, pa.list_(pa.float64())),
                 pa.array(y, pa.float64())], names=["idx", "val", "y"])

    picked = about(d, train_rows, "text").mapInArrow(
        sample, "idx array<long>, val array<double>, y double").collect()
    # a fixed order, so that reruns agree
    rows = sorted(((np.array(r["idx"], np.int64), np.array(r["val"]), r["y"]) for r in picked),
                  key=lambda r: (r[0].tobytes(), r[1].tobytes()))
    return {"share": share, "table": table, "weights": train_scorer(rows), "rows": len(rows), "documents": total}


def classify(docs: DataFrame, model: dict | None = None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``__words, __weak, __score, __kept``: number of words, posterior of the
    votes, the scorer's probability of low quality, and whether the document stays."""
    model = model or fit(docs, text_col)
    ship_code(docs.sparkSession)
    fields = docs.schema.simpleString()[7:-1]
    weights, share, table = model["weights"], model["share"], model["table"]
    d = docs.withColumn("__t", text_or_empty(text_col))

    def run(batches):
        import pyarrow as pa
        from velocis.llm.weak_quality import features, forget, look, posterior, score, votes
        for b in batches:
            n, weak, sc = [], [], []
            for t in b.column("__t").to_pylist():
                seen = look(t)
                k = len(seen)
                n.append(k)
                weak.append(float(posterior(np.array([votes(seen)]), share, table)[0]))
                sc.append(score(weights, features(seen), k) if k else 1.0)
            yield pa.RecordBatch.from_arrays(
                [*[c for c, f in zip(b.columns, b.schema.names) if f != "__t"], pa.array(n, pa.int64()),
                 pa.array(weak, pa.float64()), pa.array(sc, pa.float64()),
                 pa.array([s < threshold for s in sc], pa.bool_())],
                names=[*[f for f in b.schema.names if f != "__t"], "__words", "__weak", "__score", "__kept"])
        forget()

    return d.mapInArrow(run, f"{fields},__words:bigint,__weak:double,__score:double,__kept:boolean")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, weak_label, score, kept``.

    ``weak_label`` and ``score`` are probabilities of low quality. Null, empty
    and white texts have no words, score 1 and are rejected; texts under four
    words get no votes and are judged by the scorer; null ids and repeated
    rows are judged like any others; other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = classify(d, text_col="text")
    return out.select("doc_id", F.col("__words").alias("n_words"), F.col("__weak").alias("weak_label"),
                      F.col("__score").alias("score"), F.col("__kept").alias("kept"))


def keep_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return classify(docs, text_col=text_col).where("__kept").select(*docs.columns)
