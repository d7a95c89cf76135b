"""Operators 3, 6 and 9, the pipeline and the registered names."""

import glob
import hashlib
import math
import random
import re
import uuid
from collections import Counter

import duckdb
import numpy as np
import zstandard
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from tests.llm.helpers import SCHEMA, edge_docs, empty_docs, row, tuples, words
from velocis.llm import learned_ann, pareto_mix, warc_zst
from velocis.session import scratch_path


# ---- operator 9 -------------------------------------------------------------

def test_mix_matches_sql(spark):
    r = random.Random(3)
    rows = [row(i, words(r.randrange(0, 300), i), r.choice(["a", "a", "a", "b", "Z", "é", None])) for i in range(400)]
    rows += [row(1000 + i, words(20, 1000 + i), "tiny") for i in range(2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "source").toPandas())
    con.execute("CREATE TABLE documents AS SELECT doc_id, text, source FROM d")
    out = pareto_mix.mix(docs)
    want = con.execute(pareto_mix.ORACLE).fetchall()
    assert tuples(out, *[c[0] for c in con.description]) == sorted(want)
    by = {}
    for x in out.join(docs.select("doc_id", "source"), "doc_id").collect():
        t = by.setdefault(x["source"], [x["target"], 0])
        t[1] += x["taken"]
        assert x["taken"] <= 3 * x["size"] and x["target"] <= 3 * x["source_size"] + 1e-6
    assert all(abs(a - b) <= max(2, 0.01 * a) for a, b in by.values() if a > 500)


def brute_force_mix(rows, cap=3.0):
    """``rows(doc_id, size, source)`` -> copies per row: targets, whole copies and order in plain Python."""
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in rows if x == s) for s in names}
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    left, rest = dict(weight), float(sum(size.values()))
    target = {}
    while left:  # the water level: full sources leave, the others share what they leave over
        level = rest / sum(left.values())
        full = [s for s in left if cap * size[s] < level * left[s]]
        target.update({s: cap * size[s] for s in full} or {s: level * w for s, w in left.items()})
        left = {s: w for s, w in left.items() if s not in target}
        rest -= sum(target[s] for s in full)
    copies = [0] * len(rows)
    for s in names:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        if not size[s]:
            continue
        whole = math.floor(target[s] / size[s])
        gap = target[s] - whole * size[s]
        for i in mine:
            copies[i] = whole
        if gap <= 0:
            continue
        mean, y = size[s] / len(mine), {}
        for i in mine:
            doc, n, _ = rows[i]
            h = hashlib.md5(f"pareto-1|{'null' if doc is None else doc}".encode()).hexdigest()
            u = (int(h[:13], 16) + 0.5) / (1 << 52)
            r = gap / size[s]
            q = u / (1 - u) / (r / (1 - r) * (min(2.0, max(0.5, mean / n)) if n else 2.0))
            y[i] = q / (1 + q)
        order = sorted(mine, key=lambda i: (y[i], rows[i][0] is None, rows[i][0] or 0, rows[i][1]))

        def nearest(gap, among):
            fits = [i for i in among if rows[i][1] and abs(rows[i][1] - gap) < gap]
            best = min(fits, key=lambda i: (abs(rows[i][1] - gap), y[i], rows[i][0] is None, rows[i][0] or 0),
                       default=None)
            return ([best], abs(rows[best][1] - gap)) if best is not None else ([], gap)

        n = 0
        while n < len(order) and rows[order[n]][1] <= gap:
            gap -= rows[order[n]][1]
            n += 1
        extra, miss = nearest(gap, order[n:])
        if miss > 0.05 * target[s]:
            more = []
            for i in order[n:]:
                if 0 < rows[i][1] <= gap:
                    gap -= rows[i][1]
                    more.append(i)
            last, again = nearest(gap, [i for i in order[n:] if i not in more])
            if again < miss:
                extra = more + last
        for i in order[:n] + extra:
            copies[i] += 1
    return copies


def test_mix_goes_on_behind_a_long_document(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(5, 60), r.choice("abcde")) for i in range(1500)]
    held = {s: sum(n for _, n, x in rows if x == s) for s in "abcde"}
    # ids that come first, in the middle and last in the order; two long documents in one source
    far = 0
    for first in range(5000, 5006):
        mixed = rows + [(first, held["a"] // 2, "a"), (first + 50, held["d"] // 4, "d"), (first + 90, held["d"] // 5, "d")]
        docs = spark.createDataFrame([row(i, "w " * n, s) for i, n, s in mixed], SCHEMA)
        got = {x["doc_id"]: (x["size"], x["target"], x["taken"]) for x in pareto_mix.mix(docs).collect()}
        want = brute_force_mix(mixed)
        assert [got[i][2] for i, _, _ in mixed] == [n * c for (_, n, _), c in zip(mixed, want)]
        for s in "abcde":
            target = next(got[i][1] for i, _, x in mixed if x == s)
            far += abs(sum(got[i][2] for i, _, x in mixed if x == s) - target) > 0.05 * target
    assert far == 0


def test_no_slice_holds_much_of_a_source(spark):
    for r in (1e-9, 1e-7, 0.3, 1 - 1e-7, 1 - 1e-9):
        odds = F.lit(r) / (F.lit(1.0) - F.lit(r))
        u = pareto_mix.uniform(F.col("id"))
        q = u / (F.lit(1.0) - u) / (odds * F.when(F.col("id") % 2 == 0, 2.0).otherwise(0.5))
        rows = spark.range(50_000).withColumn("y", q / (F.lit(1.0) + q)) \
            .withColumn("k", pareto_mix.rank_slice(F.col("y"), odds)).select("y", "k").collect()
        assert max(Counter(x["k"] for x in rows).values()) <= 8
        in_order = [x["k"] for x in sorted(rows)]
        assert in_order == sorted(in_order) and 0 <= in_order[0] and in_order[-1] < 1 << 20
    one = spark.range(1).select(pareto_mix.rank_slice(F.lit(1.0), F.lit(1e-17)).alias("k")).first()
    assert one["k"] == (1 << 20) - 1


def test_targets_reshare_the_excess(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 980)], "source string, size long")
    got = {r["source"]: r["target"] for r in pareto_mix.source_targets(sizes).collect()}
    # weights 1 2 3 1; b and c stop at 30, the rest is shared 1 : 1
    assert got["b"] == 30 and got["c"] == 30 and abs(got["a"] - 970) < 1e-9 and abs(got["d"] - 970) < 1e-9


def test_mix_edges_and_copies(spark):
    docs = edge_docs(spark)
    out = pareto_mix.mix(docs)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    taken = pareto_mix.take_mix(docs)
    assert taken.columns == docs.columns
    assert taken.selectExpr("sum(regexp_count(coalesce(text, ''), '[^ \\\\t-\\\\r]+'))").first()[0] == \
        sum(r["taken"] for r in rows)
    assert pareto_mix.mix(empty_docs(spark)).count() == 0
    plan = pareto_mix.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- operator 3 -------------------------------------------------------------

def pages(spark):
    long_page = "<p>" + words(400, 7) + "</p>"
    rows = [(1, "http://a/é b", long_page, "x"), (5, "http://b", long_page, "x"), (3, None, long_page, "x"),
            (1, "http://a", long_page, "x"), (None, "u", long_page, "x"), (4, "u", "short", "x"), (6, "u", "short", "x"),
            (7, "u", None, "x"), (None, None, None, None), (8, "u", "", "x"), (9, "u\r\nX: y", "é" * 60, "x"),
            (10, "u", "é" * 60, "x"), (11, "u", "z" * 300_000, "x"), (12, "u", "a\r\n\r\nb" * 30, "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)


def test_warc_round_trip_edges(spark):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    first = {}
    for i, p in rows:
        if len(p) >= 100 and i is not None:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, p in rows:
        ref = first.get(p)
        again = ref is not None and ref != i
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response",
                     ref if again else None))
    key = lambda t: tuple((x is not None, x) for x in t)
    assert tuples(warc_zst.round_trip(pages(spark))) == sorted(want, key=key)
    assert warc_zst.round_trip(pages(spark).where("false")).count() == 0


def test_archives_are_plain_warc_files(spark, tmp_path):
    many = spark.range(600).selectExpr("id AS page_id", "concat('http://h/', id) AS url",
                                       "repeat(concat('<p>text ', id % 500, '</p> and more '), 60) AS html")
    path = warc_zst.write_archives(many, scratch_path(spark, f"llm/warc-files-test-{uuid.uuid4().hex}"))
    files = glob.glob(path.removeprefix("file:") + "/part-*")
    data = [open(f, "rb").read() for f in files]
    data = [d for d in data if d]
    assert data and all(d[:4] == (0x184D2A5D).to_bytes(4, "little") for d in data)
    assert sum(r is not None and r["type"] != "warcinfo" for d in data for r, _ in warc_zst.read_archive(d)) == 600
    got = warc_zst.read_archives(spark, path)
    assert got.where("record_type = 'revisit'").count() == 100 and got.where("payload IS NULL").count() == 100
    # damage: a flipped byte, a cut file, a record whose length is wrong
    d = bytearray(data[0])
    d[len(d) // 2] ^= 0xFF
    assert any(e for _, e in warc_zst.read_archive(bytes(d)))
    assert any(e for _, e in warc_zst.read_archive(data[0][:-20]))
    bad = warc_zst.page_record(1, "u", b"hello", hashlib.sha256(b"hello").hexdigest(), None, "d")
    for x in (bad.replace(b"Content-Length: 5", b"Content-Length: 6"), bad + b"x", b"WARC/9" + bad[8:],
              bad.replace(b"hello", b"hellO"), bad.replace(b"WARC-Date", b"WARC Date\x00"[:9])):
        got = list(warc_zst.read_archive(zstandard.ZstdCompressor().compress(x)))
        assert len(got) == 1 and got[0][0] is None and got[0][1]
    assert list(warc_zst.read_archive(zstandard.ZstdCompressor().compress(bad)))[0][1] is None


# ---- operator 6 -------------------------------------------------------------

def test_nearest_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((120, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(200 + i, x[40].tolist(), 0) for i in range(45)]  # ties, and a query among them
    rows += [(0, x[0].tolist(), 9), (500, None, 0), (520, [0.0] * 8, 0), (540, [float("nan")] + [1.0] * 7, 0),
             (560, [None] + [1.0] * 7, 0), (580, [float("inf")] * 8, 0), (None, x[3].tolist(), 0), (600, [1.0, 2.0], 0),
             (620, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    ok = {i: np.array(v) for i, v, _ in rows if i is not None and v and len(v) == 8 and None not in v
          and np.isfinite(v).all() and np.any(v)}
    got = {}
    for r in learned_ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {i for i in ok if i % 20 == 0}
    for q, found in got.items():
        want = sorted(((-float(ok[q] @ v), i) for i, v in ok.items() if i != q))[:20]
        assert [found[r][0] for r in range(1, 21)] == [i for _, i in want]
        assert max(abs(found[r + 1][1] + want[r][0]) for r in range(20)) < 1e-12
    few = learned_ann.nearest(df.where("vec_id IN (20, 21, 22)")).collect()
    assert [(r["query_id"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(20, 1), (20, 2)]
    assert learned_ann.nearest(df.where("false")).count() == 0


def test_recall_with_many_partitions(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 24)) * 2
    x = centres[rng.integers(0, 40, 8000)] + rng.standard_normal((8000, 24)) * 0.7
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in learned_ann.nearest(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 8000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (400 * 20) >= 0.9


def test_a_query_in_a_small_part_finds_all_its_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.c_[rng.random(150), rng.standard_normal(150)]
    x[[0, 7, 20, 33]] += [10, 0]  # a part of four rows, two of them queries
    model = (1.0, np.array([[1.0], [0.0]]), np.array([-5.0]), np.array([[0.0, 10.0]]), np.array([1.0, 0.0]))
    monkeypatch.setattr(learned_ann, "fit", lambda *a: (model, 2, 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in learned_ann.nearest(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in (0, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert [got[q][i] for i in range(1, 21)] == np.argsort(-s)[:20].tolist()
    assert set(got) == set(range(0, 150, 20)) and all(len(v) == 20 for v in got.values())


def test_parts_are_balanced():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 6))
    _, src, dst = learned_ann.neighbour_graph(x)
    label = learned_ann.balanced_parts(600, src, dst, 8)
    assert set(np.bincount(label, minlength=8).tolist()) == {75}
    shuffled = rng.permutation(label)
    assert (label[src] != label[dst]).mean() < 0.8 * (shuffled[src] != shuffled[dst]).mean()


# ---- registration and pipeline ----------------------------------------------

def test_registered():
    q, o = E.queries(), E.oracle_sql()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert "pipeline" in q and {k for k in o if re.match(r"op\d+_", k)} == {
        "op3_warc_zst", "op8_digest_merge", "op9_pareto_mix", "op10_cover_substring"}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from velocis.sources.tables import read_table
    docs = read_table(spark, SF001, "documents")
    columns, before = docs.columns, docs.count()
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialise(stage(spark, docs, SF001), f"test-{name}")
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    assert before > counts[0] > counts[1] >= counts[2] and counts[3] == counts[4]
    good = read_table(spark, SF001, "labels").where("quality = 1").count()
    assert counts[0] >= 0.85 * before * good / read_table(spark, SF001, "labels").count()


def test_pipeline_on_edges(spark):
    import corpus_pipeline
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.materialise(stage(spark, docs, SF001), f"edges-{name}")
        assert docs.columns[:2] == ["doc_id", "n_tokens"]
