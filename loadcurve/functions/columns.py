"""Finding, renaming and ordering columns. All of it works on names only; no job is run."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _name_parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-z0-9]+", name.lower()) if p]


def _contains(name: str, candidate: str, whole_parts: bool) -> bool:
    if not whole_parts:
        return candidate.lower() in name.lower()
    have, want = _name_parts(name), _name_parts(candidate)
    return any(have[i : i + len(want)] == want for i in range(len(have) - len(want) + 1))


def resolve_column(
    columns: Sequence[str], candidates: Sequence[str], *, whole_parts: bool = True
) -> str | None:
    """The column meant by an ordered candidate list, or None.

    An exact match (case-blind) goes by candidate order. Failing that, the first column in the
    file's own order that contains any candidate is taken. With `whole_parts` a candidate must
    cover whole parts of the name (`id` is in `customer id`, not in `humidity`).
    """
    by_lower = {c.lower(): c for c in columns}
    for candidate in candidates:
        if candidate.lower() in by_lower:
            return by_lower[candidate.lower()]
    for column in columns:
        if any(_contains(column, c, whole_parts) for c in candidates):
            return column
    return None


def require_column(columns: Sequence[str], candidates: Sequence[str], meaning: str) -> str:
    found = resolve_column(columns, candidates)
    if found is None:
        raise ValueError(f"no {meaning} column in {list(columns)} (looked for {list(candidates)})")
    return found


def resolve_columns_substring(
    columns: Sequence[str], needed: Sequence[str]
) -> dict[str, str] | None:
    """First column containing each needed name, as {column: needed}; None unless all are found."""
    picked: dict[str, str] = {}
    for name in needed:
        match = next((c for c in columns if name in c.lower()), None)
        if match is None:
            return None
        picked[match] = name
    return picked


def select_renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select([F.col(quoted(old)).alias(new) for old, new in mapping.items()])


def quoted(name: str) -> str:
    """A column reference that survives dots, spaces and colons in the name."""
    return "`" + name.replace("`", "``") + "`"


def lowercase_trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def reorder_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first (those present), the rest after in their own order."""
    first = [c for c in preferred if c in df.columns]
    return df.select([F.col(quoted(c)) for c in first + [c for c in df.columns if c not in first]])


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def fill_absent_features(df: DataFrame, features: Sequence[str], value: float = 0.0) -> DataFrame:
    """A constant column for every model feature the frame lacks."""
    missing = {f: F.lit(float(value)) for f in features if f not in df.columns}
    return df.withColumns(missing) if missing else df


def entity_keys(df: DataFrame, region_in_key: bool = True) -> list[str]:
    """A building is identified within its region; `region_in_key=False` merges equal names."""
    return ["region", "building_name"] if region_in_key and "region" in df.columns else ["building_name"]


def shared_entity_keys(left: DataFrame, right: DataFrame) -> list[str]:
    """The key of a building that both frames have."""
    return entity_keys(left) if "region" in right.columns else ["building_name"]
