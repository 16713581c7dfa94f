"""The JSON sidecar of a case page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casework.schemas import SIDECAR

FIELDS = ("name", "decision_date", "docket_number", "first_page", "last_page")


def _citations(doc: Column) -> Column:
    """Cites of both lists: objects give their ``cite``; plain strings count in ``cites_to`` only."""
    none = F.array().cast("array<string>")
    own = F.transform(
        F.coalesce(doc["citations"], none), lambda e: F.get_json_object(e, "$.cite")
    )
    cited = F.transform(
        F.coalesce(doc["cites_to"], none),
        lambda e: F.when(e.startswith("{"), F.get_json_object(e, "$.cite")).otherwise(e),
    )
    return F.filter(F.concat(own, cited), lambda c: c.isNotNull())


def parse_sidecar(df: DataFrame, json: str) -> DataFrame:
    """Replace the *json* column by its fields; missing fields and bad JSON give '' and []."""
    doc = F.from_json(F.col(json), SIDECAR, {"mode": "PERMISSIVE"})
    df = df.withColumn("_doc", doc)
    empty = F.lit("")
    court = F.col("_doc")["court"]
    columns = {name: F.coalesce(F.col("_doc")[name], empty) for name in FIELDS}
    columns["court_name"] = F.coalesce(
        F.when(court.startswith("{"), F.get_json_object(court, "$.name")).otherwise(court), empty
    )
    columns["sidecar_citations"] = _citations(F.col("_doc"))
    return df.withColumns(columns).drop("_doc", json)
