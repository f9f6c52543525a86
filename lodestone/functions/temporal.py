"""Validity predicates over memory rows (valid_from, valid_until, status) as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LIVE, TRANSITIONS


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def window_holds(moment: Column) -> Column:
    """Whether the half-open validity window holds the moment; a null end is open."""
    return (F.col("valid_from") <= moment) & (F.col("valid_until").isNull() | (F.col("valid_until") > moment))


def is_current(moment: Column) -> Column:
    return F.col("status").isin(*LIVE) & window_holds(moment)


def is_open_current() -> Column:
    """Current in the strict sense of point reads: live and without any end."""
    return F.col("status").isin(*LIVE) & F.col("valid_until").isNull()


def is_valid_at(moment: Column) -> Column:
    """As of a moment: the window decides, and only disputed rows are left out."""
    return window_holds(moment) & (F.col("status") != "disputed")


def overlaps(start: Column, end: Column) -> Column:
    return (F.col("valid_from") < end) & (F.col("valid_until").isNull() | (F.col("valid_until") > start))


def in_scope(project: str | None, user: str | None = None) -> Column:
    """Rows of the project, and the user's own rows outside any project."""
    mine = F.col("project_id").isNull() & F.col("user_id").eqNullSafe(F.lit(user).cast("string"))
    return F.col("project_id").eqNullSafe(F.lit(project).cast("string")) | mine if user is not None else F.col("project_id").eqNullSafe(F.lit(project).cast("string"))


def may_become(old: Column, new: Column) -> Column:
    """Whether the status machine has this edge."""
    edges = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(edges, old), new), F.lit(False))


def audit_action(old: Column, new: Column) -> Column:
    return (F.when(old.isNull(), "created").when(new.isNull(), "purged").when(new == "archived", "archived")
            .when((new == "active") & (old != "active"), "restored").otherwise("status_changed"))
