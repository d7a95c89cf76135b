"""Operators 11, 12 and 13."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.conftest import SF001, SF01
from tests.llm.helpers import SCHEMA, edge_docs, edge_rows, empty_docs, row, tuples
from velocis.llm import gram_spelling, jump_align, queries, vector_pack
from velocis.llm.vector_pack import Limits
from velocis.sources.tables import read_table

WORD, A, B = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sorted_rows(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, x) for x in t))


def random_texts(n, seed):
    r = random.Random(seed)
    signs = " \n\t\r\x0b\x1c\x85\xa0 abcdeftsrvmlxyz'\"!?.,0123456789éüßñçÉÀİΣσς½ž中文²Ⅷ́😀<|>endoftext\x00\x7f"
    out = ["".join(r.choice(signs) for _ in range(r.choice([0, 1, 3, 20, 90]))) for _ in range(n)]
    return out + [t[:9] + "<|endoftext|>" + t[9:] for t in out[::7]]


# ---- operator 11 ------------------------------------------------------------

def test_word_bpe_matches_the_library():
    with open(WORD, encoding="utf-8") as f:
        bpe = vector_pack.WordBpe(f.read())
    lib = Tokenizer.from_file(WORD)
    for t in random_texts(3000, 3) + ["a" * 5000, "Å̈ Å", "don't WE'LL x's ªº²½"]:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def check_pieces(pieces, examples, limits):
    """Every id in one piece, sequences gapless and within limits; -> (tokens, padding)."""
    by_seq, rebuilt = {}, Counter()
    for p in pieces:
        by_seq.setdefault(p["sequence_id"], []).append(p)
        assert p["length"] >= 1 and p["length"] * 4 == len(p["ids"])
    tokens = padding = 0
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        n = 0
        for p in ps:
            assert p["offset"] == n
            n += p["length"]
        assert n <= limits.tokens and len(ps) <= limits.segments
        assert sum(p["length"] - p["prompt_tokens"] for p in ps) <= limits.loss_tokens
        tokens += n
        padding += 0 if n & (n - 1) == 0 else limits.tokens - n
    # pieces of equal documents cannot be told apart: compare the multiset of all (doc, place, id)
    for p in pieces:
        for k, i in enumerate(np.frombuffer(p["ids"], "<u4").tolist()):
            rebuilt[p["doc_id"], p["start"] + k, i, p["doc_tokens"]] += 1
    want = Counter((d, k, i, len(ids)) for d, ids in examples for k, i in enumerate(ids))
    assert rebuilt == want
    return tokens, padding


@pytest.mark.parametrize("limits,rows", [(Limits(), 2048), (Limits(64, 3, 64), 4), (Limits(256, 128, 40), 2),
                                         (Limits(1, 1, 1), 2048), (Limits(4096, 1, 4096), 2)])
def test_pack_documents_edges(spark, limits, rows):
    lib = Tokenizer.from_file(WORD)
    docs = edge_docs(spark) if limits.tokens > 64 else edge_docs(spark).where("text IS NULL OR length(text) < 3000")
    want = [(r[0], lib.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in edge_rows()
            if limits.tokens > 64 or len(r[1] or "") < 3000]
    pieces = vector_pack.pack(vector_pack.encode_examples(docs, WORD), limits, pool_rows=rows).collect()
    _, padding = check_pieces(pieces, want, limits)
    assert padding == 0
    assert vector_pack.pack_documents(empty_docs(spark), WORD).count() == 0


def test_pack_whole_table_pads_nothing_and_cuts_little(spark):
    docs = read_table(spark, SF01, "documents")
    lib = Tokenizer.from_file(WORD)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = [(d, e.ids + [2]) for (d, _), e in zip(rows, lib.encode_batch([t or "" for _, t in rows],
                                                                         add_special_tokens=False))]
    pieces = vector_pack.pack_documents(docs.repartition(3), WORD).collect()
    tokens, padding = check_pieces(pieces, want, Limits())
    assert padding == 0
    # at most one cut a sequence
    assert len({p["sequence_id"] for p in pieces}) <= tokens / 4096 + 3 * 13
    assert len(pieces) - len(want) <= len({p["sequence_id"] for p in pieces})
    q = queries.op11_vector_pack(spark, SF001)
    assert q.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for r in vector_pack.pack_documents(read_table(spark, SF001, "documents"), WORD).limit(50).collect():
        assert q.where(f"doc_id = {r['doc_id']} AND start = {r['start']}").first()["ids_crc32"] == zlib.crc32(r["ids"])
        break


def test_pack_instruction_data_keeps_all_limits(spark):
    limits = Limits(512, 6, 200)
    examples = vector_pack.encode_examples(
        vector_pack.instruction_examples(read_table(spark, SF01, "conversations")), WORD, prompt_col="prompt")
    rows = examples.collect()
    assert len(rows) > 100 and any(r["prompt_tokens"] for r in rows)
    packed = vector_pack.pack(examples, limits)
    pieces = packed.collect()
    want = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    check_pieces(pieces, want, limits)
    whole = {r["sequence_id"]: r for r in vector_pack.sequences(packed).collect()}
    assert sum(r["n_tokens"] for r in whole.values()) == sum(len(ids) for _, ids in want)
    p = pieces[-1]
    s = whole[p["sequence_id"]]
    assert bytes(s["ids"])[4 * p["offset"]:4 * (p["offset"] + p["length"])] == bytes(p["ids"])
    assert all(r["n_loss_tokens"] <= 200 and r["n_segments"] <= 6 for r in whole.values())


def test_dot_product_prefers_what_fits_the_rest():
    p = vector_pack.Packer(Limits(16, 4, 4))
    for name, n, lead in (("long prompt", 8, 8), ("loss", 4, 0), ("small", 2, 0)):
        p.add(name, n, lead)
    (_, placed), *_ = p.fill(everything=True)
    # the loss limit is the scarce one: "loss" uses it up, then only the prompt fits
    assert {x[0] for x in placed} >= {"long prompt"} and sum(x[2] for x in placed) in (8, 16)


# ---- operator 12 ------------------------------------------------------------

def brute_spelling(rows, min_length=5, min_count=3):
    n = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_length:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    near = {w: set() for w in n}
    letters = {c for w in n for c in w}
    for w in n:
        made = {w[:i] + w[i + 1:] for i in range(len(w))}
        made |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
        for x in made:
            if x in n and x != w:
                near[w].add(x)
                near[x].add(w)
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return [(w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items()]


COLS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("block_rows", [8192, 3])
def test_spelling_of_random_words(spark, block_rows):
    r = random.Random(5)
    rows = []
    for d in range(60):
        ws = []
        for _ in range(120):
            w = "".join(r.choice("abcé") for _ in range(r.choice([4, 5, 6, 7])))
            ws.append(w.upper() if r.random() < .1 else w)
        ws += ["Grammar"] * 8 + ["gramar"] * 2 + ["grammer"] + ["x" * 900] * 2 + ["x" * 901 + "é"]
        ws += ["planet"] + ["planets"] * (d < 24) + ["planetss"] * (d < 8)  # a chain of forms
        rows.append((d, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = tuples(gram_spelling.spelling_variants(docs, block_rows=block_rows), *COLS)
    want = sorted_rows(brute_spelling(rows))
    assert got == want and sum(w[4] for w in want) > 500 and any(w[2] != w[1] for w in want if w[1])


def test_spelling_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert tuples(gram_spelling.spelling_variants(edge_docs(spark)), *COLS) == sorted_rows(brute_spelling(rows))
    assert gram_spelling.spelling_variants(empty_docs(spark)).count() == 0


def test_spelling_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF01, "documents").select("doc_id", "text").collect()]
    assert tuples(queries.op12_gram_spelling(spark, SF01), *COLS) == sorted_rows(brute_spelling(rows))


# ---- operator 13 ------------------------------------------------------------

class Brute:
    def __init__(self):
        self.two = jump_align.sides(open(A, encoding="utf-8").read(), open(B, "rb").read())
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def one(self, t):
        """``(a ids, b ids, groups, linked pairs)``, or None without tokens."""
        if not t:
            return None
        a, b = self.a.encode(" " + t, add_special_tokens=False).ids, self.b.encode(t)
        ab, bb = [self.two.a_bytes[i] for i in a], [self.two.b_bytes[i] for i in b]
        if not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            return None
        a_end, b_end = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        b_at = {e: i for i, e in enumerate(b_end)}
        groups, pairs, i, j = [], [], 0, 0
        for k, e in enumerate(a_end):
            if e in b_at:
                groups.append(",".join(map(str, a[i:k + 1])) + "|" + ",".join(map(str, b[j:b_at[e] + 1])))
                pairs.append((a[k], b[b_at[e]]))
                i, j = k + 1, b_at[e] + 1
        return a, b, ";".join(groups), pairs

    def table(self, rows):
        done = [(d, self.one(t)) for d, t in rows]
        n = Counter(p for _, x in done if x for p in x[3])
        top = {}
        for (_, b), c in n.items():
            top[b] = max(top.get(b, 0), c)
        out = []
        for d, x in done:
            if x is None:
                out.append((d, 0, 0, 0, 0, 0, 0, ""))
            else:
                a, b, g, p = x
                out.append((d, len(a), len(b), g.count(";") + 1, len(p), sum(n[q] == top[q[1]] for q in p),
                            sum(n[q] for q in p), hashlib.sha256(g.encode()).hexdigest()))
        return sorted_rows(out)


@pytest.fixture(scope="module")
def brute():
    return Brute()


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_align_random_texts(spark, brute, monkeypatch):
    texts = random_texts(1500, 8) + ["  a  b ", "a▁b", "▁ x", "<s> </s> <unk> <0x41>", " " * 50 + "x", "a" * 999]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.table(rows)
    assert any(w[1] == 0 for w in want)
    assert tuples(jump_align.align_tokenizers(docs, A, B), *ALIGNED) == want


def test_align_edges(spark, brute):
    rows = [(r[0], r[1]) for r in edge_rows()]
    out = jump_align.align_tokenizers(edge_docs(spark), A, B, keep_groups=True)
    assert tuples(out, *ALIGNED) == brute.table(rows)
    assert all(hashlib.sha256(r["groups"]).hexdigest() == r["groups_sha256"] for r in out.collect() if r["n_a"])
    assert jump_align.align_tokenizers(empty_docs(spark), A, B).count() == 0
    nothing = spark.createDataFrame([row(1, None), row(2, "")], SCHEMA)
    assert [tuple(r)[1:] for r in jump_align.align_tokenizers(nothing, A, B).collect()] == [(0,) * 6 + ("",)] * 2


def test_align_whole_table(spark, brute):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF01, "documents").select("doc_id", "text").collect()]
    assert tuples(queries.op13_jump_align(spark, SF01), *ALIGNED) == brute.table(rows)


def test_blocks_do_not_change_counts(brute):
    two = brute.two
    texts = [t for t in random_texts(400, 9) if brute.one(t)]
    done = jump_align.align(two, two.encode(texts))
    block = jump_align.Block()
    block.pairs = [d["pairs"] for d in done]
    pair, n, blobs = block.table()
    assert Counter({(int(p) >> 32, int(p) & 0xffffffff): int(c) for p, c in zip(pair, n)}) == \
        Counter(q for t in texts for q in brute.one(t)[3]) and len(blobs) == len(texts)


def test_terminals_of_overlapping_ranges():
    r = random.Random(2)
    for _ in range(200):
        cuts = [sorted(set(r.sample(range(1, 60), r.randrange(0, 20))) | {60}) for _ in range(2)]
        ranges = sorted((s, e) for c in cuts for s, e in zip([0, *c], c))
        last = jump_align.terminals(*map(np.array, zip(*ranges)))
        both = sorted(set(cuts[0]) & set(cuts[1]))
        component = [next(i for i, c in enumerate(both) if e <= c) for _, e in ranges]
        assert [component[i] for i in last] == component and len(set(last.tolist())) == len(both)
