"""Record normalisation, matching and reporting for form data, on Spark."""

from recordflow.session import build_session, configure

__all__ = ["build_session", "configure"]
