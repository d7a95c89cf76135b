from velocis.functions.scalar import (  # noqa: F401
    haversine_km, decision, confidence, is_fraud, category_code, snapshot_key,
    merchant_key, epoch_micros, ntz_epoch_micros, epoch_millis, from_epoch_millis, explanation_map,
    zscore, velocity_ratio,
)
