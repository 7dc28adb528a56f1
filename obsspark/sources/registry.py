"""The service registry from JSON (an array of service entries)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from obsspark.functions.text import ws_trim

def _is_text(v):
    return F.schema_of_variant(v) == "STRING"


def _text(v):
    """The trimmed text of a JSON string; a value of another type reads as '', which no rule accepts."""
    absent = v.isNull() | (F.schema_of_variant(v) == "VOID")
    return F.when(absent, F.lit(None).cast("string")).when(_is_text(v), ws_trim(F.try_variant_get(v, "$", "string"))).otherwise("")


def read_services(spark: SparkSession, path: str) -> DataFrame:
    """Registry entries in file order (``service_idx``), fields trimmed.

    The document is one JSON array: read as whole text and ``posexplode``d, so
    positions are the array positions.  A document that is not a JSON array raises.
    A value of a wrong type reads as one that breaks the rule of its field (a name or
    log path as null, other fields as ''), so ``inventory.assert_registry_valid``
    rejects it; whole numbers >= 0 in ``journalUser`` read as their text.
    """
    return parse_services(spark.read.text(path, wholetext=True))


def parse_services(docs: DataFrame, *keep: str) -> DataFrame:
    """The entries of the JSON arrays in ``value``, numbered in each; columns ``keep`` of their document are kept."""
    entries = docs.select(*keep, F.posexplode(F.variant_get(F.parse_json("value"), "$", "array<variant>")).alias("service_idx", "s"))

    def at(field: str):
        return F.try_variant_get("s", f"$.{field}", "variant")

    fields = entries.select(*keep, "service_idx", *[at(f).alias(f) for f in ("name", "logs", "journal", "journalScope", "journalUser", "metrics")])
    logs, user = F.col("logs"), F.col("journalUser")
    paths = F.transform(F.try_variant_get(logs, "$", "array<variant>"),
                        lambda x: F.when(_is_text(x), ws_trim(F.try_variant_get(x, "$", "string"))))
    number = F.try_variant_get(user, "$", "decimal(38,6)")
    uid = F.when((number >= 0) & (number == F.floor(number)), F.floor(number).cast("string")).otherwise("")
    is_number = F.schema_of_variant(user).rlike("^(BIGINT|DECIMAL|DOUBLE)")
    return fields.select(
        *keep, F.col("service_idx").cast("int").alias("service_idx"),
        F.when(_is_text(F.col("name")), ws_trim(F.try_variant_get("name", "$", "string"))).alias("name"),
        F.when(logs.isNotNull() & (F.schema_of_variant(logs) != "VOID"),
               F.coalesce(paths, F.array(F.lit(None).cast("string")))).alias("logs"),
        _text(F.col("journal")).alias("journal"),
        _text(F.col("journalScope")).alias("journal_scope"),
        F.when(is_number, uid).otherwise(_text(user)).alias("journal_user"),
        _text(F.col("metrics")).alias("metrics"))
