"""Spark-native selection and packaging of observability data.

Log lines, pods, Kubernetes events, metric-scrape outcomes, service
registries and principals are DataFrames; every operator is a
DataFrame -> DataFrame transformation built from Spark's own
expressions so Catalyst can push filters to the scan and keep the work
inside whole-stage codegen.
"""

from obsspark.session import ensure_session_defaults, get_session, scale_settings, shared_dir

__version__ = "0.1.0"
__all__ = ["ensure_session_defaults", "get_session", "scale_settings", "shared_dir", "__version__"]
