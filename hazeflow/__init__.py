"""Air-quality features, audits, labels, models and forecasts as Spark jobs."""

from hazeflow.session import build_session, configure

__all__ = ["build_session", "configure"]
