"""Names as shown to people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadq.functions.strings import blank_to_null, strip


def pretty_source(source: Column) -> Column:
    """'csv_upload' -> 'CSV Upload'."""
    words = F.filter(F.split(source, r"[_\s]+"), lambda w: w != "")
    shown = F.transform(
        words,
        lambda w: F.when(F.lower(w) == "csv", "CSV").otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))
        ),
    )
    return F.array_join(shown, " ")


def lead_name(first: Column, last: Column) -> Column:
    parts = F.concat_ws(" ", F.when(first != "", first), F.when(last != "", last))
    return F.coalesce(blank_to_null(parts), F.lit("(no name)"))


def import_name(given: Column, file_name: Column, source: Column) -> Column:
    """Name of a new dataset: the given one, else the file's, else one made from the source."""
    made = F.concat(F.initcap(F.translate(source, "_", " ")), F.lit(" import"))
    return strip(F.coalesce(F.when(given != "", given), F.when(file_name != "", file_name), made))
