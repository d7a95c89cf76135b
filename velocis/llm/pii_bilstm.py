"""Personal data: exact base rules plus a character BiLSTM with a CRF.

The base rules (e-mail, IP address, card, phone) run over every whole text.
A bidirectional LSTM over characters with CRF transitions is trained in numpy,
on the driver, from labelled spans in a bounded sample of windows, partly
rewritten into forms the rules do not know. It reads the whole text in
overlapping windows; a window without a digit or ``@`` cannot hold any of the
four kinds and is all "outside" without being run. Each window is decoded by
Viterbi and the windows are reconciled over the text: a span counts from the
window in which it lies farthest from the edges, and one cut by the edges of all
its windows is joined from them. Spans the rules have stay as they are; the model only adds spans that do not touch them and have the digits
of their kind.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velocis.llm.common import about, text_or_empty
from velocis.session import ship_code

#: The kinds, in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")
_DIGITS = re.compile(r"[0-9]+")

WINDOW, STRIDE = 64, 32
#: The model is trained on about so many documents (with a digit or @, by hash) and windows.
TRAIN_DOCS, TRAIN_WINDOWS = 1500, 3000


# ---- base rules -------------------------------------------------------------

def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str):
    # the leftmost match before an @ starts where its run of local characters starts; linear in the text
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list:
    """``(start, kind number, end)`` by start, then kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text)
                    if 10 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15]
    return sorted(out)


def join_spans(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# ---- windows ----------------------------------------------------------------

def char_ids(text: str) -> np.ndarray:
    """1..95 printable ASCII, 96 white space, 97 other letters, 98 the rest; 0 is padding."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((c >= 32) & (c < 127), c - 31, np.where(c < 32, 96, np.where(c >= 0xC0, 97, 98)))
    return out.astype(np.int64)


def windows(text: str) -> list:
    """Starts of the windows (a grid over the whole text) that hold a digit or ``@``."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    out = set()
    for m in _TRIGGER.finditer(text):
        lo = max(0, -(-(m.start() - WINDOW + 1) // STRIDE))
        out.update(range(lo, min(last, (m.end() - 1) // STRIDE) + 1))
    return [w * STRIDE for w in sorted(out)]


def cut(ids: np.ndarray, starts: list) -> np.ndarray:
    out = np.zeros((len(starts), WINDOW), np.int64)
    for row, s in zip(out, starts):
        part = ids[s:s + WINDOW]
        row[:len(part)] = part
    return out


def tags_of(spans: list, start: int, n: int = WINDOW) -> np.ndarray:
    """B and I tags (1 + 2 kind, 2 + 2 kind) of the spans that lie in a window whole or in part."""
    out = np.zeros(n, np.int64)
    for s, k, e in spans:
        lo, hi = max(s, start), min(e, start + n)
        if lo < hi:
            out[lo - start:hi - start] = 2 + 2 * k
            if s >= start:
                out[s - start] = 1 + 2 * k
    return out


# ---- the model --------------------------------------------------------------

CHARS, EMBED, HIDDEN, TAGS = 99, 12, 20, 1 + 2 * len(KINDS)


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number: I only continues its own kind."""
    a = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = -1e4
        a[1 + 2 * k, 2 + 2 * k] = a[2 + 2 * k, 2 + 2 * k] = 0
    return a


def init(seed: int = 11) -> dict:
    rng = np.random.default_rng(seed)
    m = {"emb": rng.standard_normal((CHARS, EMBED)) * 0.3, "trans": np.zeros((TAGS, TAGS)),
         "out": rng.standard_normal((2 * HIDDEN, TAGS)) * 0.2, "bias": np.zeros(TAGS)}
    for d in "fb":
        m["w" + d] = rng.standard_normal((EMBED + HIDDEN, 4 * HIDDEN)) / np.sqrt(EMBED + HIDDEN)
        m["b" + d] = np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]
    return m


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _lstm(x, w, b, keep=None):
    """x: (time, rows, EMBED) -> hidden states; ``keep`` collects what the backward pass needs."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    xw = x @ w[:EMBED] + b
    out = np.empty((t, n, HIDDEN))
    for i in range(t):
        z = xw[i] + h @ w[EMBED:]
        gates = _sigmoid(z[:, :3 * HIDDEN])
        g = np.tanh(z[:, 3 * HIDDEN:])
        last, before = c, h
        c = gates[:, HIDDEN:2 * HIDDEN] * c + gates[:, :HIDDEN] * g
        tc = np.tanh(c)
        h = gates[:, 2 * HIDDEN:] * tc
        out[i] = h
        if keep is not None:
            keep.append((gates, g, last, tc, before))
    return out


def _lstm_back(dh_all, x, w, kept):
    t, n, _ = x.shape
    dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.empty_like(x)
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    for i in range(t - 1, -1, -1):
        gates, g, last, tc, before = kept[i]
        gi, gf, go = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        dh = dh + dh_all[i]
        dc = dc + dh * go * (1 - tc * tc)
        dz = np.concatenate([dc * g * gi * (1 - gi), dc * last * gf * (1 - gf), dh * tc * go * (1 - go),
                             dc * gi * (1 - g * g)], axis=1)
        dw[:EMBED] += x[i].T @ dz
        dw[EMBED:] += before.T @ dz
        db += dz.sum(0)
        dx[i] = dz @ w[:EMBED].T
        dh, dc = dz @ w[EMBED:].T, dc * gf
    return dw, db, dx


def emissions(m: dict, chars: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """(rows, WINDOW) character numbers -> (time, rows, TAGS) scores."""
    x = m["emb"][chars.T]
    kf, kb = ([], []) if kept is not None else (None, None)
    hf = _lstm(x, m["wf"], m["bf"], kf)
    hb = _lstm(x[::-1], m["wb"], m["bb"], kb)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    if kept is not None:
        kept.update(x=x, h=h, kf=kf, kb=kb)
    return h @ m["out"] + m["bias"]


def _logsum(a, axis):
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradients(m: dict, chars: np.ndarray, tags: np.ndarray) -> tuple:
    """Negative log likelihood of the tag paths under the CRF, and its gradients."""
    kept: dict = {}
    e = emissions(m, chars, kept)
    t, n, _ = e.shape
    a = m["trans"] + _allowed()
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]  # a window may start inside a span
    for i in range(1, t):
        alpha[i] = _logsum(alpha[i - 1][:, :, None] + a[None], 1) + e[i]
    for i in range(t - 2, -1, -1):
        beta[i] = _logsum(a[None] + (e[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    y = tags.T
    rows = np.arange(n)
    gold = e[np.arange(t)[:, None], rows[None], y].sum(0) + a[y[:-1], y[1:]].sum(0)
    de = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1][:, :, :, None] + a + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    da = pair.sum((0, 1))
    np.add.at(da, (y[:-1].ravel(), y[1:].ravel()), -1.0)
    de[np.arange(t)[:, None], rows[None], y] -= 1
    de /= n
    h = kept["h"]
    dh = de @ m["out"].T
    g = {"trans": da / n, "out": np.einsum("tnh,tnk->hk", h, de), "bias": de.sum((0, 1))}
    g["wf"], g["bf"], dxf = _lstm_back(dh[:, :, :HIDDEN], kept["x"], m["wf"], kept["kf"])
    g["wb"], g["bb"], dxb = _lstm_back(dh[::-1, :, HIDDEN:], kept["x"][::-1], m["wb"], kept["kb"])
    g["emb"] = np.zeros_like(m["emb"])
    np.add.at(g["emb"], chars.T, dxf + dxb[::-1])
    return float((z - gold).mean()), g


def train(chars: np.ndarray, tags: np.ndarray, steps: int = 240, rows: int = 64, seed: int = 11) -> dict:
    """Adam on the CRF likelihood."""
    m, rng = init(seed), np.random.default_rng(seed)
    m1, m2 = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(chars), min(rows, len(chars)))
        _, g = gradients(m, chars[pick], tags[pick])
        rate = 0.02 * (1 - 0.9 * step / steps)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        for k in m:
            gk = g[k] * min(1.0, 5.0 / (norm + 1e-12))
            m1[k] += 0.1 * (gk - m1[k])
            m2[k] += 0.01 * (gk * gk - m2[k])
            m[k] -= rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
    return m


def viterbi(m: dict, chars: np.ndarray) -> np.ndarray:
    """Best tag path of each row."""
    e = emissions(m, chars)
    t, n, _ = e.shape
    a = m["trans"] + _allowed()
    back = np.zeros((t, n, TAGS), np.int64)
    s = e[0]
    for i in range(1, t):
        all_s = s[:, :, None] + a[None]
        back[i] = all_s.argmax(1)
        s = all_s.max(1) + e[i]
    path = np.empty((n, t), np.int64)
    path[:, -1] = s.argmax(1)
    for i in range(t - 1, 0, -1):
        path[:, i - 1] = back[i][np.arange(n), path[:, i]]
    return path


# ---- labelled spans ---------------------------------------------------------

def rewrite(text: str, spans: list, rng) -> tuple:
    """The text with some spans in a form the base rules miss (no country code, other separators,
    spaces around @ and dots, a host that is not ASCII)."""
    out, at, new = [], 0, []
    size = 0

    def put(s):
        nonlocal size
        out.append(s)
        size += len(s)

    for s, k, e in sorted(spans):
        if s < at:
            continue
        put(text[at:s])
        v = text[s:e]
        d = "".join(_DIGITS.findall(v))
        if k == 3 and len(d) > 10 and rng.random() < 0.6:
            area, mid, last = d[-10:-7], d[-7:-4], d[-4:]
            v = (f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"00{d[:-10]} {area} "
                 f"{mid} {last}")[rng.integers(0, 4)]
        elif k == 2 and rng.random() < 0.5:
            v = ("." if rng.random() < 0.6 else "/").join(d[i:i + 4] for i in range(0, len(d), 4))
        elif k == 0 and rng.random() < 0.5:
            user, _, host = v.partition("@")
            apart = host.replace(".", " . ")
            v = (f"{user} @ {host}", f"{user}@{apart}", f"{user} @ {apart}",
                 f"{user}@{'éüøñж'[rng.integers(0, 5)]}{host[1:]}")[rng.integers(0, 4)]
        elif k == 1 and rng.random() < 0.5:
            v = (" . ", "-", ", ", " ")[rng.integers(0, 4)].join(_DIGITS.findall(v))
        new.append((size, k, size + len(v)))
        put(v)
        at = e
    put(text[at:])
    return "".join(out), new


def sample_windows(text: str, most: int = 64) -> list:
    """Training windows of a text: ``(characters, tags)`` as lists, plain and rewritten. Of a text with
    more than ``most``, so many are drawn over all of them by the text's hash: only a training sample."""
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()[:8],
                                               "little"))
    spans = base_spans(text)
    forms = [(char_ids(t), s, t) for t, s in ((text, spans), rewrite(text, spans, rng) if spans else ("", []))]
    at = [(i, w) for i, (_, _, t) in enumerate(forms) for w in windows(t)]
    if len(at) > most:
        at = [at[j] for j in sorted(rng.permutation(len(at))[:most])]
    return [(cut(forms[i][0], [w])[0].tolist(), tags_of(forms[i][1], w).tolist()) for i, w in at]


# ---- decoding a text --------------------------------------------------------

def plausible(kind: int, v: str) -> bool:
    """What every span of a kind has, whatever its form."""
    d = "".join(_DIGITS.findall(v))
    if kind == 0:
        user, at, host = v.partition("@")
        return bool(at) and user.rstrip()[-1:].isalnum() and "." in host and host[-1:].isalnum() and "@" not in host
    if kind == 1:
        parts = _DIGITS.findall(v)
        return len(parts) == 4 and all(map(_small, parts)) and not re.search(r"[^\W\d_]", v)
    if re.search(r"[^\W\d_]|@", v):
        return False
    return 13 <= len(d) <= 19 and luhn(d) if kind == 2 else 10 <= len(d) <= 15 and len(re.findall(r"[0-9]+", v)) >= 3


def reconcile(text: str, base: list, found: list) -> list:
    """``found``: ``(start, kind, end, distance to the window's nearest edge)``, several windows. The
    span seen farthest from an edge wins; none touches a base span or a winner."""
    starts, ends, reach = [], [], 0  # what is taken, as disjoint intervals in order
    for s, _, e in sorted(base):
        if starts and s < reach:
            reach = ends[-1] = max(reach, e)
        else:
            starts.append(s)
            ends.append(e)
            reach = e
    out = []
    for s, k, e, _ in sorted(set(found), key=lambda x: (-x[3], x[0], x[1], x[2])):
        i = bisect.bisect_right(ends, s)
        if (i == len(starts) or starts[i] >= e) and plausible(k, text[s:e]):
            starts.insert(i, s)
            ends.insert(i, e)
            out.append((s, k, e))
    return out


def spans_of(path: np.ndarray, start: int, length: int) -> list:
    """Spans of a window's tags, with their distance from the edges; one cut by an edge is left
    to the neighbouring window."""
    out, i, n = [], 0, len(path)
    while i < n:
        tag = path[i]
        if tag % 2 == 1:
            j = i + 1
            while j < n and path[j] == tag + 1:
                j += 1
            room = min(i if start else n, n - j if start + n < length else n)
            if room > 0 and start + j <= length:
                out.append((start + i, int(tag) // 2, start + j, room))
            i = j
        else:
            i += 1
    return out


def joined(paths: dict, length: int) -> list:
    """Spans too long to lie inside one window for certain, from the tags of all windows of a text
    (``{start: path}``): each character has the tag of the window in whose middle half it lies. They
    count behind the spans seen in one window."""
    out, starts, side = [], sorted(paths), (WINDOW - STRIDE) // 2
    i = 0
    while i < len(starts):
        j = i + 1
        while j < len(starts) and starts[j] == starts[j - 1] + STRIDE:
            j += 1
        if j - i > 1 and any(paths[s].any() for s in starts[i:j]):
            tags = np.concatenate([paths[starts[i]][:WINDOW - side],
                                   *[paths[s][side:WINDOW - side] for s in starts[i + 1:j - 1]],
                                   paths[starts[j - 1]][side:]])
            for s, k, e, _ in spans_of(tags, starts[i], length):
                # at a seam the window before must see the end there too
                before = e - side - STRIDE
                cut_off = before in paths and before + STRIDE in paths and paths[before][e - before] == 2 + 2 * k
                if e - s >= STRIDE - 1 and not cut_off:
                    out.append((s, k, e, 0))
        i = j
    return out


def find_in(texts: list, model: dict | None) -> list:
    """``(base spans, added spans)`` of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, []) for b in base]
    paths: list = [{} for _ in texts]
    todo = [(i, s) for i, t in enumerate(texts) for s in windows(t)]
    while todo:
        more = set()
        at, ids = -1, None
        for n in range(0, len(todo), 512):
            held = []
            for i, s in todo[n:n + 512]:
                if i != at:
                    at, ids = i, char_ids(texts[i])
                held.append(cut(ids, [s])[0])
            for (i, s), path in zip(todo[n:n + 512], viterbi(model, np.stack(held))):
                paths[i][s] = path.astype(np.int8)
                # a span cut by an edge goes on in the next window, even one without a digit or @
                if path[-1] and s + WINDOW < len(texts[i]):
                    more.add((i, s + STRIDE))
                if path[0] and path[0] % 2 == 0 and s:
                    more.add((i, s - STRIDE))
        todo = sorted((i, s) for i, s in more if s not in paths[i])
    out = []
    for t, b, p in zip(texts, base, paths):
        found = [x for s, path in p.items() if path.any() for x in spans_of(path, s, len(t))]
        out.append((b, reconcile(t, b, found + joined(p, len(t)))))
    return out


# ---- over the cluster -------------------------------------------------------

def fit(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS,
        train_windows: int = TRAIN_WINDOWS) -> dict | None:
    """Train on at most ``train_windows`` windows of about ``train_docs`` documents; None without any."""
    ship_code(docs.sparkSession)
    d = docs.select(text_or_empty(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    d = about(d, train_docs, "text").withColumn("h", F.xxhash64("text"))

    def emit(batches):
        import pyarrow as pa
        from velocis.llm.pii_bilstm import sample_windows
        for b in batches:
            for h, t in zip(b.column("h").to_pylist(), b.column("text").to_pylist()):
                rows = sample_windows(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["h", "chars", "tags"])

    rows = d.mapInArrow(emit, "h long, chars array<long>, tags array<long>") \
        .orderBy("h", "chars").limit(train_windows).collect()
    if not rows:
        return None
    return train(np.array([r["chars"] for r in rows]), np.array([r["tags"] for r in rows]))


def find_pii(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, base, added``, arrays of ``kind, start,
    end`` (code points, end exclusive) in order of start, then kind.

    Null and empty texts have no spans; null ids and repeated rows are searched
    like any others; other columns are ignored, whatever their names; an empty
    table gives an empty result. ``model`` None: base rules only.
    """
    ship_code(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    span = "array<struct<kind:string,start:bigint,end:bigint>>"

    def run(batches):
        import pyarrow as pa
        from velocis.llm.pii_bilstm import KINDS, find_in
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

        def column(lists):
            return pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(x)] for x in lists], kind)

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                found = find_in(part.column("text").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), column([x[0] for x in found]), column([x[1] for x in found])],
                    names=["doc_id", "base", "added"])

    return d.mapInArrow(run, f"doc_id {id_type}, base {span}, added {span}")


def digest(spans: DataFrame) -> DataFrame:
    """``find_pii`` -> counts of the base spans by kind, a digest of the base spans and the list of all."""
    def joined(col):
        rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
        order = F.array_sort(F.transform(col, lambda s: F.struct(
            s["start"].alias("s"), rank[s["kind"]].alias("r"), s["end"].alias("e"), s["kind"].alias("k"))))
        return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "added")).alias("spans"))
