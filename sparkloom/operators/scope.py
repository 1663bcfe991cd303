"""Scope, ownership and row-level security as column predicates.

Arguments that are None take no part in a predicate, so Catalyst sees only what is asked
and can push it into the scan. An empty list is not None where the docstring says so.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def retrieval_scope(document: str | None = None, documents: list | None = None, folders: list | None = None, folder: str | None = None, owner: str | None = None) -> Column:
    """Rows of finished documents in scope: one document and (listed documents or listed folders) and one folder and one owner.

    An empty list of documents means no restriction, an empty list of folders an empty scope.
    """
    chosen = None
    if documents or folders is not None:
        parts = ([F.col("document_id").isin(documents)] if documents else []) + ([F.col("folder").isin(folders) if folders else F.lit(False)] if folders is not None else [])
        chosen = reduce(lambda a, b: a | b, parts)
    return every(
        F.col("status") == "done",
        None if document is None else F.col("document_id") == document,
        chosen,
        None if folder is None else F.col("folder") == folder,
        None if owner is None else F.col("owner") == owner,
    )


def agent_scope(document: str | None = None, documents: list | None = None, folder: str | None = None, folders: list | None = None) -> Column:
    """By precedence: one document, else one folder, else the union of lists; an empty union is FALSE, no lists at all TRUE."""
    if document is not None:
        return F.col("document_id") == document
    if folder is not None:
        return F.col("folder") == folder
    if documents is None and folders is None:
        return F.lit(True)
    parts = [F.col(c).isin(v) for c, v in (("document_id", documents), ("folder", folders)) if v]
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def memory_scope(tenant: str, user: str, day: int, project: str | None = None, thread: int | None = None) -> Column:
    """Active, unexpired items of a tenant's user that hold for the given context."""
    fits = (F.col("scope") == "user") | (F.col("scope") == "summary")
    if project is not None:
        fits = fits | ((F.col("scope") == "project") & (F.col("project_id") == project))
    if thread is not None:
        fits = fits | ((F.col("scope") == "thread") & (F.col("thread_id") == thread))
    return every(F.col("tenant_id") == tenant, F.col("user_id") == user, F.col("status") == "active", F.col("valid_day").isNull() | (F.col("valid_day") > day), fits)


def translation_scope(folder: str | None, project: str | None) -> Column:
    """Folder and project must match exactly; None matches only null."""
    return F.col("folder").eqNullSafe(F.lit(folder)) & F.col("project").eqNullSafe(F.lit(project))


@dataclass(frozen=True)
class Principal:
    """Who reads. An anonymous principal sees nothing."""

    user: str | None = None
    admin: bool = False

    def sees(self, owner: Column) -> Column:
        if self.admin:
            return F.lit(True)
        return F.lit(False) if self.user is None else owner == F.lit(self.user)


def protected(df: DataFrame, who: Principal, owner: str = "owner") -> DataFrame:
    return df.where(who.sees(F.col(owner)))


def children_protected(children: DataFrame, parents: DataFrame, who: Principal, key: str, owner: str = "owner") -> DataFrame:
    """Rows whose parent the principal sees."""
    return children.join(protected(parents, who, owner).select(key), key, "left_semi")
