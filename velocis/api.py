"""Public facade: every operator takes and returns DataFrames.

    from velocis import api
    flog = api.rolling_features(txn, api.HOURLY)
"""

from velocis.functions.scalar import (  # noqa: F401
    category_code, confidence, decision, explanation_map, haversine_km, is_fraud, merchant_key, snapshot_key,
    velocity_ratio, zscore,
)
from velocis.functions.sql import register_sql_functions  # noqa: F401
from velocis.operators.monitoring import (  # noqa: F401
    batch_summary, class_balance, cumulative_histogram, decision_counts, detected_vs_actual, engine_totals, fraud_rate,
    histogram_quantile, latency_report, rate_per_window, serving_coverage, throughput_report,
)
from velocis.operators.ordering import nearest_rank_report, ranked  # noqa: F401
from velocis.operators.rolling import latest_per_entity, rolling_features, snapshot_view  # noqa: F401
from velocis.operators.newton import NewtonModel, lr_gradient, train_lr_newton  # noqa: F401
from velocis.operators.scoring import (  # noqa: F401
    LinearScorer, batch_score, decide, model_vector, optional_outputs, request_defaults, score, score_with,
    with_vector,
)
from velocis.operators.serving import (  # noqa: F401
    asof_join, cold_entities, point_in_time_features, project_features, serve_from_snapshot, serve_tiered,
)
from velocis.operators.training import (  # noqa: F401
    average_precision, class_weights, classification_report, feature_importances, fit_scaler, apply_scaler,
    latest_bundle, load_bundle, predict, roc_auc, save_bundle, stratified_split, top_features, train_gbt,
    train_lr, training_set, union_shuffle,
)
from velocis.schemas import DEFAULT, HOURLY, WindowSet  # noqa: F401
from velocis.sources.decode import decode_transactions, ingest_defaults, stamp_event_time, validate  # noqa: F401
from velocis.sources.sinks import (  # noqa: F401
    SnapshotTable, keyed_json, read_snapshots, snapshot_json, snapshot_records,
)
from velocis.sources.tables import (  # noqa: F401
    read_table, requests_from_transactions, transactions, transactions_from_events,
)
from velocis.streaming.incremental import IncrementalRolling, ScoringStream, current_rows  # noqa: F401
from velocis.streaming.serving import ServingStream, tagged  # noqa: F401
from velocis.streaming.stateful import RollingFeatureProcessor, rolling_features_stateful  # noqa: F401
from velocis.streaming.streams import (  # noqa: F401
    CounterListener, decode_stream, dedup, detected_vs_actual_stream, kafka_source, observe_counters,
    parquet_source, replay, replay_together, run_to_table, score_stream_sinks, sliding_aggregates, snapshot_sink,
    text_source, with_event_time,
)
