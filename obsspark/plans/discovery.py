"""Discovery listings (reference lifecycle 3.3): pods and services a
principal may see, redacted by role."""

from __future__ import annotations

from pyspark.sql import DataFrame


from obsspark.operators import access as A
from obsspark.operators import inventory as INV


def discover_pods(pods: DataFrame, admin: bool, namespace: str = "*", selector: str | None = None,
                  needle: str | None = None) -> DataFrame:
    """S4 -> P13 -> P12 -> P11 -> P15: all pages, namespace scope, label
    selector, name substring, then the role's projection."""
    p = INV.filter_namespace(pods, namespace)
    if selector:
        p = p.filter(INV.label_selector(selector))
    return INV.describe_pods(INV.pods_by_name(p, needle), admin)


def discover_services(principals: DataFrame, services: DataFrame) -> DataFrame:
    """C2 + P16 for many principals at once: each principal's visible
    registry entries (admins: full definition, others: name)."""
    return A.visible_services(principals, services)
