"""Column roles: key, feature, target or helper, kept in the schema's metadata and so in what is written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("key", "feature", "target", "helper")


def with_roles(df: DataFrame, **roles: list[str]) -> DataFrame:
    """df with roles={names} noted in each column's metadata; other metadata stay."""
    if odd := set(roles) - set(ROLES):
        raise ValueError(f"no such role: {sorted(odd)}")
    known = {f.name: f.metadata for f in df.schema.fields}
    of = {name: role for role, names in roles.items() for name in names}
    if odd := set(of) - set(known):
        raise ValueError(f"no such column: {sorted(odd)}")
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=known[c] | {"role": of[c]}) if c in of else F.col(f"`{c}`") for c in df.columns])


def columns(df: DataFrame, role: str = "feature") -> list[str]:
    """The columns of a role, in order. What has no role is none: a new label can't slip in among the features."""
    return [f.name for f in df.schema.fields if f.metadata.get("role") == role]
