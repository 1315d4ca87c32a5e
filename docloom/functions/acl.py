"""Identities, principals and who may see a row."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.schema import PUBLIC


@dataclass(frozen=True)
class Identity:
    sub: str = "anonymous"
    groups: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()

    def principals(self) -> list[str]:
        """public, the user unless anonymous, groups, roles, in this order."""
        own = [] if self.sub in ("", "anonymous") else [f"user:{self.sub}"]
        return [PUBLIC, *own, *(f"group:{g}" for g in self.groups), *(f"role:{r}" for r in self.roles)]


def principals_of(sub: Column, groups: Column, roles: Column) -> Column:
    """The same for a table of identities."""
    own = F.when(sub.isNull() | sub.isin("", "anonymous"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("user:"), sub)))

    def named(kind: str, names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{kind}:"), x))

    return F.concat(F.array(F.lit(PUBLIC)), own, named("group", groups), named("role", roles))


def acl_or_public(acl: Column) -> Column:
    return F.when(F.coalesce(F.size(acl), F.lit(0)) > 0, acl).otherwise(F.array(F.lit(PUBLIC)))


def visible(rows: DataFrame, principals: Iterable[str], column: str = "acl_principals") -> DataFrame:
    """Rows that share a principal with the caller. Comes before any score or top-k."""
    return rows.where(F.arrays_overlap(column, F.array(*map(F.lit, principals))))


def visible_to_each(rows: DataFrame, callers: DataFrame, key: str, column: str = "acl_principals") -> DataFrame:
    """For a table of callers (caller, principals): (caller, key) pairs of visible rows. Joined by principal, not row by row."""
    granted = rows.select(key, F.explode(F.array_distinct(column)).alias("principal"))
    held = callers.select("caller", F.explode(F.array_distinct("principals")).alias("principal"))
    return granted.join(held, "principal").select("caller", key).distinct()
