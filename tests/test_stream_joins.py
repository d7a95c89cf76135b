"""Serving on two streams, outer join with ground truth, exact distinct without sets."""

import random
import uuid

from pyspark.sql import functions as F

from fixtures import T0, txn_df
from velocis.operators.serving import serve_tiered
from velocis.schemas import DEFAULT
from velocis.session import scratch_path
from velocis.streaming.serving import REQUEST_COLS, ServingStream, tagged
from velocis.streaming.streams import detected_vs_actual_stream, parquet_source, run_to_table, sliding_aggregates

US = 1_000_000


def requests(spark, rows):
    """rows: (request_id, transaction_id, entity, seconds)."""
    df = spark.createDataFrame([(i, t, e, 5.0, 1.5, 2.5, "online", int(s * US)) for i, t, e, s in rows],
                               "request_id string, transaction_id string, entity_id string, amount double, "
                               "latitude double, longitude double, merchant_category string, us long")
    return df.withColumn("request_ts", F.timestamp_micros("us")).select(*REQUEST_COLS)


def norm(df):
    cols = sorted(c for c in df.columns if c not in ("batch_id", "request_ts"))
    return sorted(map(str, df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                                       for c, t in df.select(*cols).dtypes]).collect()))


def serving(spark, **kw):
    return ServingStream(scratch_path(spark, f"tests/serve-{uuid.uuid4().hex[:8]}"), DEFAULT, **kw)


def test_serving_stream_equals_batch_whatever_the_interleaving(spark):
    r = random.Random(8)
    events = [(r.choice(["a", "a", None, "b"]), f"t{i:03d}", T0 + r.randrange(0, 400), float(r.randrange(9)),
               f"m{i % 5}", r.uniform(1, 9), r.uniform(1, 9)) for i in range(80)]
    asked = [(f"r{i:03d}", f"t{i:03d}" if i % 3 else None, r.choice(["a", None, "b", "cold"]), T0 + r.randrange(0, 420))
             for i in range(70)]
    for hot_rows in (None, 15):
        s = serving(spark, max_age_s=20, delay_s=60, lateness_s=2000, hot_rows=hot_rows)
        # events come up to 60 s out of order, requests long before their time
        by_arrival = sorted(events, key=lambda e: e[2] + r.choice([0, 30, 59]))
        for k in range(4):
            s(tagged(txn_df(spark, by_arrival[20 * k:20 * k + 20]), requests(spark, asked[k::4])), k)
        served = spark.read.parquet(s.output_path).count()
        assert 0 < served < 70 and s.waiting(spark, 3).count() == 70 - served
        end = txn_df(spark, [("-", "end", T0 + 1000, 1.0)])
        for _ in range(2):  # replayed
            s(tagged(end, requests(spark, asked[:0] or [("x", None, "a", T0 + 9000)])), 4)
        want = serve_tiered(txn_df(spark, events), None, requests(spark, asked), DEFAULT, max_age_s=20, hot_rows=None)
        assert norm(spark.read.parquet(s.output_path)) == norm(want)
        assert [x["request_id"] for x in s.waiting(spark, 4).collect()] == ["x"]


def test_serving_stream_sets_apart_with_reasons(spark):
    s = serving(spark, lateness_s=10, max_age_s=10, bucket_s=1)
    s(tagged(txn_df(spark, [("e", "a", T0, 1.0)]), requests(spark, [("r0", None, "e", T0)])), 0)
    far = T0 + 40 * 365 * 86400
    s(tagged(txn_df(spark, [("e", "old", T0 - 500, 1.0), ("e", "f", far, 1.0)]),
             requests(spark, [("r1", None, "e", T0 - 400), ("r2", None, "e", T0 - 1)])), 1)
    apart = {(r["reason"], (r["event"] or r["request"])["transaction_id"]) for r in spark.read.parquet(s.apart_path).collect()}
    assert apart == {("late", "old"), ("future", "f"), ("late_request", None)}
    got = {r["request_id"]: r for r in spark.read.parquet(s.output_path).collect()}
    assert set(got) == {"r0", "r2"} and got["r0"]["txn_count_60s"] == 1 and got["r2"]["txn_count_60s"] == 0


def test_outer_join_gives_out_unmatched_rows_when_evicted(spark):
    base = scratch_path(spark, f"tests/outer-{uuid.uuid4().hex[:8]}")

    def scored(rows):
        return spark.createDataFrame([(t, "APPROVE", False, s) for t, s in rows],
                                     "transaction_id string, decision string, is_fraud boolean, s long") \
            .withColumn("scored_ts", F.timestamp_seconds("s")).drop("s")

    def truth(rows):
        return spark.createDataFrame([(t, True, s) for t, s in rows], "transaction_id string, actual_fraud boolean, s long") \
            .withColumn("truth_ts", F.timestamp_seconds("s")).drop("s")

    steps = [([(f"t{i}", T0 + i) for i in range(10)], [(f"t{i}", T0 + i + 60) for i in range(0, 10, 2)]),
             ([("end", T0 + 9000)], [("far", T0 + 9000), ("t1", T0 + 9000)]),   # t1's truth is out of bounds
             ([("end2", T0 + 9001)], [("far2", T0 + 9001)])]
    for sc, tr in steps:
        scored(sc).write.mode("append").parquet(base + "/s")
        truth(tr).write.mode("append").parquet(base + "/t")
        j = detected_vs_actual_stream(parquet_source(spark, base + "/s", scored([]).schema),
                                      parquet_source(spark, base + "/t", truth([]).schema), "10 minutes", "leftOuter")
        run_to_table(j, "outer", checkpoint=base + "/c", path=base + "/o")
    got = {r["transaction_id"]: r["actual_fraud"] for r in spark.read.parquet(base + "/o").collect()}
    assert {k: v for k, v in got.items() if k.startswith("t")} == {f"t{i}": (True if i % 2 == 0 else None) for i in range(10)}


def test_sliding_distinct_is_exact_and_keeps_no_set(spark, capsys):
    base = scratch_path(spark, f"tests/slide-{uuid.uuid4().hex[:8]}")
    r = random.Random(1)
    rows = [(f"e{i % 2}", f"t{i}", T0 + i * 3, None if i % 9 == 0 else 1e6 + r.random(),
             None if i % 7 == 0 else f"m{r.randrange(5)}") for i in range(120)]
    txn = txn_df(spark, rows + rows[:10])
    txn.write.parquet(base + "/src")
    agg = sliding_aggregates(parquet_source(spark, base + "/src", txn.schema), "60 seconds", "30 seconds")
    agg.explain()
    assert "collect_set" not in capsys.readouterr().out
    run_to_table(agg, "slide", checkpoint=base + "/c", path=base + "/out")
    txn_df(spark, [("-", "end", T0 + 9000, 1.0)]).write.mode("append").parquet(base + "/src")
    run_to_table(sliding_aggregates(parquet_source(spark, base + "/src", txn.schema), "60 seconds", "30 seconds"),
                 "slide", checkpoint=base + "/c", path=base + "/out")
    got = spark.read.parquet(base + "/out").where("entity_id != '-'")
    w = F.window("event_ts", "60 seconds", "30 seconds")
    want = txn.groupBy("entity_id", w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.stddev_pop("amount"), F.lit(0.0)), 6).alias("std"),
        F.countDistinct("merchant_id").alias("u")).select("entity_id", F.unix_micros("w.start"), "n", "std", "u")
    got = got.select("entity_id", "window_start_us", "txn_count", F.round("amount_std", 6), "unique_merchants")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
