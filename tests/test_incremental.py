"""The incremental stream: every arrival scored, append-only tail, revisions."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from fixtures import T0, txn_df
from velocis.operators.rolling import rolling_features
from velocis.schemas import DEFAULT
from velocis.session import scratch_path
from velocis.streaming.incremental import IncrementalRolling, current_rows, with_affected

US = 1_000_000


def new(spark, **kw):
    return IncrementalRolling(scratch_path(spark, f"tests/inc-{uuid.uuid4().hex[:8]}"), DEFAULT, **kw)


def norm(df):
    cols = [c for c in sorted(df.columns) if c not in ("batch_id", "computed_at")]
    df = df.select(*cols)
    df = df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return sorted(map(str, df.collect()))


def features(inc, spark):
    return {r["transaction_id"]: r for r in spark.read.parquet(inc.output_path).collect()}


def random_rows(n, seed, disorder):
    """Rows in order of arrival; times up to ``disorder`` seconds behind."""
    r = random.Random(seed)
    rows, t = [], T0
    for i in range(n):
        t += r.choice([0, 0, 0.5, 3, 40])
        e = r.choice(["hot", "hot", "a", None])
        at = t - r.choice([0, 0, 0, 1, disorder / 3, disorder])
        rows.append((e, f"t{i:03d}", at, None if r.random() < .1 else float(r.randrange(50)),
                     None if r.random() < .1 else f"m{r.randrange(6)}", r.uniform(1, 9), r.uniform(1, 9)))
    return rows + rows[5:8] + rows[-2:]


def test_a_future_stamp_does_not_make_the_rest_late(spark):
    inc = new(spark)
    far = T0 + 40 * 365 * 86400
    inc(txn_df(spark, [("e", "a", T0, 1.0), ("x", "f", far, 1.0)]), 0)
    inc(txn_df(spark, [("e", "b", T0 + 1, 2.0), ("g", "c", T0 + 2, 3.0)]), 1)
    got = features(inc, spark)
    assert set(got) == {"a", "b", "c"} and got["b"]["txn_count_60s"] == 2
    assert [(r["transaction_id"], r["reason"]) for r in spark.read.parquet(inc.late_path).collect()] == [("f", "future")]


def test_a_row_slightly_older_than_the_last_batch_is_scored(spark):
    inc = new(spark)
    inc(txn_df(spark, [("e", "a", T0, 1.0)]), 0)
    inc(txn_df(spark, [("f", "b", T0 - 0.1, 2.0), ("e", "c", T0 - 50, 3.0), ("e", "d", T0 - 200, 3.0)]), 1)
    got = features(inc, spark)
    assert set(got) == {"a", "b", "c"} and got["c"]["txn_count_60s"] == 1
    assert [r["reason"] for r in spark.read.parquet(inc.late_path).collect()] == ["late"]


def test_arrival_column_bounds_the_clock_and_null_times_are_set_apart(spark):
    inc = new(spark, arrival_col="came", tolerance_s=5)
    df = txn_df(spark, [("e", "a", T0, 1.0), ("e", "b", T0 + 20, 1.0)]).withColumn("came", F.lit(int(T0 * US)))
    inc(df.unionByName(df.limit(1).withColumn("us", F.lit(None).cast("long"))), 0)
    assert sorted(r["reason"] for r in spark.read.parquet(inc.late_path).collect()) == ["future", "no_time"]
    assert set(features(inc, spark)) == {"a"}


def arrived_by_then(spark, rows, batches):
    """Each batch's rows by the batch operator over all rows that had arrived."""
    out, done = [], []
    for b in batches:
        done += b
        f = rolling_features(txn_df(spark, done), DEFAULT, hot_rows=None)
        ids = {r[1] for r in b}
        seen = {r[1] for r in done[:-len(b)]} if len(done) > len(b) else set()
        out += norm(f.where(F.col("transaction_id").isin(*(ids - seen))))
    return sorted(out)


def test_out_of_order_rows_are_scored_as_of_their_own_time(spark):
    rows = random_rows(90, 4, 45)
    batches = [rows[i:i + 32] for i in range(0, len(rows), 32)]
    inc = new(spark)
    for k, b in enumerate(batches):
        inc(txn_df(spark, b), k)
    got = spark.read.parquet(inc.output_path)
    first = got.groupBy("transaction_id").agg(F.min("batch_id").alias("batch_id"))
    assert norm(got.join(first, ["transaction_id", "batch_id"])) == arrived_by_then(spark, rows, batches)
    late = sorted(r["transaction_id"] for r in spark.read.parquet(inc.late_path).collect())
    assert late == ["t005", "t006", "t007"] and got.count() == len(rows) - 3  # delivered again long after


def parts_of(inc):
    root = f"{inc.base}/tail/events"
    return sorted(f"{b}/{p}" for b in os.listdir(root) if b.startswith("bucket") for p in os.listdir(f"{root}/{b}"))


def test_tail_is_append_only_merged_and_dropped(spark):
    inc = new(spark, lateness_s=30, bucket_s=30, merge_parts=2)
    rows = [(f"e{i % 3}", f"t{i:03d}", T0 + i * 4, float(i), f"m{i % 4}", 1.0 + i, 2.0) for i in range(40)]
    written, parts = [], []
    for k in range(10):
        before = set(parts_of(inc)) if k else set()
        inc(txn_df(spark, rows[4 * k:4 * k + 4]), k)
        parts.append(len(parts_of(inc)))
        written.append(set(parts_of(inc)) - before)
    # a batch adds its own parts (and merged ones); what is kept does not grow
    assert all(all(f"part={k}" in p for p in w) for k, w in enumerate(written))
    assert max(parts[6:]) <= max(parts[:6]) and any("merged" in p for w in written for p in w)
    oldest = min(int(p.split("/")[0].split("=")[1]) for p in parts_of(inc))
    assert oldest * 30 >= T0 + 39 * 4 - 60 - 30 - 3 * 30
    assert len(os.listdir(f"{inc.base}/tail/dropped")) <= 3 and len(os.listdir(f"{inc.base}/taken")) <= 2
    want = rolling_features(txn_df(spark, rows), DEFAULT)
    assert norm(spark.read.parquet(inc.output_path)) == norm(want)
    # an entity that comes back finds its previous location in the dropped events
    inc(txn_df(spark, [("e0", "back", T0 + 5000, 1.0, "m", 5.0, 5.0)]), 10)
    inc(txn_df(spark, [("e1", "again", T0 + 5001, 1.0, "m", 5.0, 5.0)]), 11)
    got = features(inc, spark)
    assert (got["back"]["prev_latitude"], got["again"]["prev_latitude"]) == (1.0 + 39, 1.0 + 37)


def test_a_killed_batch_is_replayed(spark, monkeypatch):
    from velocis.streaming import incremental
    rows = random_rows(40, 9, 20)
    inc = new(spark, merge_parts=2)
    inc(txn_df(spark, rows[:20]), 0)
    with monkeypatch.context() as m:
        m.setattr(incremental.Tail, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            inc(txn_df(spark, rows[20:30]), 1)
    for _ in range(2):
        inc(txn_df(spark, rows[20:30]), 1)
    inc(txn_df(spark, rows[30:]), 2)
    inc(txn_df(spark, rows[30:31]).where("false"), 3)
    again = new(spark)
    for k, b in enumerate((rows[:20], rows[20:30], rows[30:])):
        again(txn_df(spark, b), k)
    assert norm(spark.read.parquet(inc.output_path)) == norm(spark.read.parquet(again.output_path))
    with pytest.raises(RuntimeError, match="missing"):
        inc(txn_df(spark, rows[:1]), 9)


def test_empty_first_batch(spark):
    inc = new(spark)
    out, apart = inc.run(txn_df(spark, [("e", "a", T0, 1.0)]).where("false"), 0)
    assert out.count() == 0 and apart.count() == 0
    inc(txn_df(spark, [("e", "a", T0, 1.0)]), 1)
    assert set(features(inc, spark)) == {"a"}


@pytest.mark.parametrize("seed,hot_rows", [(1, None), (2, 6)])
def test_revisions_lead_to_the_batch_result(spark, seed, hot_rows):
    rows = random_rows(60, seed, 300)
    r = random.Random(seed)
    r.shuffle(rows)  # any order at all
    inc = new(spark, lateness_s=10_000, revisions=True, hot_rows=hot_rows)
    cuts = [0, 30, 31, len(rows)]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        inc(txn_df(spark, rows[a:b]), k)
    inc(txn_df(spark, rows[cuts[-2]:]), len(cuts) - 2)  # replay
    log = spark.read.parquet(inc.changelog_path)
    want = norm(rolling_features(txn_df(spark, rows), DEFAULT, hot_rows=None))
    assert norm(current_rows(log)) == want
    # inserts less retracts, row by row, leave the same
    keep = [c for c in log.columns if c not in ("op", "version", "batch_id")]
    rounded = log.select("op", *[F.round(c, 6).alias(c) if t == "double" else F.col(c)
                                 for c, t in log.select(*keep).dtypes])
    left = rounded.where("op = 'insert'").drop("op").exceptAll(rounded.where("op = 'retract'").drop("op"))
    assert norm(left) == want
    assert log.where("op = 'retract'").count() > 20


def test_affected_rows_are_those_in_reach_and_the_next_event(spark):
    r = random.Random(6)
    for _ in range(4):
        rows = [(r.choice(["e", None]), f"t{i:02d}", int((T0 + r.randrange(0, 600)) * US), r.random() < .2)
                for i in range(50)]
        df = spark.createDataFrame(rows, "entity_id string, transaction_id string, us long, _new boolean")
        got = {x["transaction_id"] for x in with_affected(df, 60 * US).where("_affected").collect()}
        want = set()
        for e, _, us, is_new in rows:
            if not is_new:
                continue
            mine = [x for x in rows if x[0] == e]
            want |= {x[1] for x in mine if not x[3] and us <= x[2] <= us + 60 * US}
        for e in ("e", None):
            mine = sorted((x for x in rows if x[0] == e), key=lambda x: (x[2], x[1]))
            want |= {y[1] for x, y in zip(mine, mine[1:]) if x[3] and not y[3]}
        assert got == want


def test_revisions_of_capped_frames_are_refused():
    with pytest.raises(ValueError):
        IncrementalRolling("/x", max_events=5, revisions=True)
