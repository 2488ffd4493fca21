"""Feed files and exports written by Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadq import schema as S
from leadq.operators.ranking import filter_leads
from leadq.operators.store import scoped


def webhook_json(leads: DataFrame) -> DataFrame:
    """Webhook deliveries as JSON text in `value`, from columns leadgen_id, form_id, page_id,
    created_time and `fields ARRAY<STRUCT<name, value>>` (NULL fields: an empty delivery)."""
    field_data = F.transform("fields", lambda f: F.struct(f["name"].alias("name"), F.array(f["value"]).alias("values")))
    value = F.struct("leadgen_id", "page_id", "form_id", "created_time", field_data.alias("field_data"))
    change = F.struct(F.lit("leadgen").alias("field"), value.alias("value"))
    changes = F.when(F.col("fields").isNotNull(), F.array(change)).otherwise(F.array())
    entry = F.struct(F.col("page_id").alias("id"), F.col("created_time").alias("time"), changes.alias("changes"))
    return leads.select(F.to_json(F.struct(F.array(entry).alias("entry"))).alias("value"))


def write_json_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def safe_file_name(name: str | None) -> str:
    """Dataset name as a file name: letters, digits, space, '-' and '_' only."""
    kept = re.sub(r"[^\w \-]", "", name or "dataset").strip()
    return (kept or "dataset") + ".csv"


def export_filtered(leads: DataFrame, path: str, **filters) -> None:
    """The leads that `ranking.filter_leads` keeps as CSV with a header, without a limit on rows."""
    write_csv(filter_leads(leads, **filters).select(*S.VIEW_COLUMNS), path)


def export_dataset(leads: DataFrame, dataset_id: str, path: str) -> None:
    """All leads of a dataset as CSV with a header, without a limit on rows."""
    write_csv(scoped(leads, dataset_id).select(*S.VIEW_COLUMNS), path)
