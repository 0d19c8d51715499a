"""Tenant scope: every reader goes through it, and a missing scope matches nothing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TenantContext:
    """Who asks: an office, a user, a role and the user's groups."""

    office_id: str | None = None
    user_id: str | None = None
    role: str = "employee"
    groups: frozenset[str] = field(default_factory=frozenset)

    @property
    def sees_all_groups(self) -> bool:
        return self.role in ("admin", "system")

    def require_admin(self) -> None:
        if self.role != "admin":
            raise PermissionError("an administrator is needed")


def system_context(office_id: str) -> TenantContext:
    return TenantContext(office_id=office_id, role="system")


def same_office(ctx: TenantContext, office: str = "office_id") -> Column:
    return F.lit(False) if ctx.office_id is None else F.col(office) == F.lit(ctx.office_id)


def secure(df: DataFrame, ctx: TenantContext, office: str = "office_id") -> DataFrame:
    """Rows of the caller's office; the literal comparison reaches the scan as a pushed filter."""
    return df.where(same_office(ctx, office))


def secure_documents(documents: DataFrame, user_groups: DataFrame, ctx: TenantContext) -> DataFrame:
    """Documents of the office in one of the user's groups. Roles that see all groups plan no join."""
    docs = secure(documents, ctx)
    if ctx.sees_all_groups:
        return docs
    mine = user_groups.where(F.col("user_id") == F.lit(ctx.user_id)).select("group_id")
    return docs.join(mine, "group_id", "left_semi")


def secure_content(content: DataFrame, visible_documents: DataFrame, ctx: TenantContext) -> DataFrame:
    """Rows that belong to a visible document."""
    return secure(content, ctx).join(visible_documents.select("document_id"), "document_id", "left_semi")


def secure_facts(facts: DataFrame, visible_occurrences: DataFrame, ctx: TenantContext) -> DataFrame:
    """Shared facts with at least one visible occurrence."""
    own = secure(facts, ctx)
    if ctx.sees_all_groups:
        return own
    return own.join(visible_occurrences.select("transaction_id"), "transaction_id", "left_semi")


def check_write(df: DataFrame, ctx: TenantContext, office: str = "office_id") -> DataFrame:
    """df unchanged, failing at run time on a row of another office."""
    good = F.coalesce(same_office(ctx, office), F.lit(False))
    message = F.lit("row belongs to another office")
    return df.withColumn(office, F.when(good, F.col(office)).otherwise(F.raise_error(message).cast(df.schema[office].dataType)))


def fully_visible(groups_of: DataFrame, ctx: TenantContext) -> DataFrame:
    """Keys of (key, group_id) whose groups all belong to the caller: those without a foreign group."""
    if ctx.sees_all_groups:
        return groups_of.select("key").distinct()
    foreign = groups_of.where(~F.col("group_id").isin(sorted(ctx.groups)))
    return groups_of.select("key").distinct().join(foreign.select("key").distinct(), "key", "left_anti")


def live_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that haven't expired, with their active user's office and role."""
    live = sessions.where(F.col("expires_at") > now)
    return live.join(users.where("active").select("user_id", "office_id", "role"), "user_id")


def still_authorized(cited: DataFrame, visible_versions: DataFrame) -> DataFrame:
    """Per answer: whether every cited version is still visible."""
    seen = visible_versions.select("version_id").distinct().withColumn("seen", F.lit(1))
    joined = cited.select("answer_id", "version_id").distinct().join(seen, "version_id", "left")
    return joined.groupBy("answer_id").agg((F.count(F.lit(1)) == F.count("seen")).alias("authorized"))
