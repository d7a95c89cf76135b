"""Property test: the rolling operator equals a plain-Python reference on
random event sets with ties, gaps and several entities."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fixtures import T0, brute_features, txn_df
from velocis.operators.rolling import rolling_features
from velocis.schemas import WindowSet

WS = WindowSet(1, 5, 60)

events = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 200), st.integers(1, 9999),
              st.sampled_from(["m0", "m1", "m2"])),
    min_size=1, max_size=40)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(events, st.sampled_from([None, 2, 5]))
def test_rolling_matches_reference(spark, evs, cap):
    rows = [(e, f"{e}{i:03d}", T0 + dt * 0.5, c / 100.0, m) for i, (e, dt, c, m) in enumerate(evs)]
    got = {r["transaction_id"]: r for r in rolling_features(txn_df(spark, rows), WS, max_events=cap,
                                                             stats="all").collect()}
    by_e = {}
    for r in rows:
        by_e.setdefault(r[0], []).append({"us": int(round(r[2] * 1e6)), "tid": r[1], "amount": r[3],
                                          "merchant": r[4]})
    for e, lst in by_e.items():
        for ev in lst:
            exp = brute_features(lst, ev["us"], ev["tid"], WS, cap)
            for k in ("txn_count_60s", "amount_sum_60s", "amount_std_60s", "amount_min_60s", "amount_max_60s",
                      "txn_count_1s", "amount_mean_5s", "unique_merchants_60s"):
                assert got[ev["tid"]][k] == pytest.approx(exp[k], abs=1e-9), (ev["tid"], k)
