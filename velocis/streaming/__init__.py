from velocis.streaming.stateful import RollingFeatureProcessor, rolling_features_stateful  # noqa: F401
