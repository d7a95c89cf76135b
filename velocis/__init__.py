"""velocis: per-entity rolling transaction features, point-in-time serving,
scoring, training and monitoring, expressed as Spark DataFrame plans."""

from velocis.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
