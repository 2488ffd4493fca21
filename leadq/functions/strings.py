"""Small text helpers shared by the rules."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85       　"
SPACE_RUN = r"[\s\p{Z}\x1c-\x1f\x85]+"


def strip(value: Column) -> Column:
    """Text that begins and ends with a visible ASCII character, which is most, is not searched for white space."""
    bare = (value >= "!") & (value < "\x7f") & F.substring(value, -1, 1).between("!", "~")
    return F.when(bare, value).otherwise(F.btrim(value, F.lit(WHITESPACE)))


def blank_to_null(value: Column) -> Column:
    text = strip(value)
    return F.when(text != "", text)


def present(value: Column) -> Column:
    """True for a value that is neither NULL nor ''."""
    return F.coalesce(value != "", F.lit(False))


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def lookup(values: dict[str, str], key: Column) -> Column:
    """Value for `key` in a small fixed dictionary, NULL when absent. A map is searched entry by entry, so most keys are ruled out by a hash."""
    return F.when(key.isin(list(values)), F.try_element_at(literal_map(values), key))


def quote(text: str) -> str:
    """`text` as a literal inside a regular expression."""
    return "".join(f"\\{c}" if not (c.isalnum() or c in " '_") else c for c in text)


def any_of(phrases: list[str]) -> str:
    return "|".join(quote(p) for p in phrases)


def last_entries(entries: Column) -> Column:
    """Key/value entries as a map; a repeated key keeps its last entry, NULL keys are dropped."""
    kept = F.filter(
        entries,
        lambda e, i: e["key"].isNotNull()
        & ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["key"] == e["key"]),
    )
    return F.map_from_entries(kept)
