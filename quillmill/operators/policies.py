"""Row policies by command: who sees which rows, and which rows may be written."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

#: A rule takes the user, who may be a column as well, and says of each row whether it holds.
Rule = Callable[[Column], Column]
REFUSED = "new row violates row-level security policy"


class Policy(NamedTuple):
    """What one command may do: rows there are must pass ``using``, rows that come ``check``, or ``using`` without it."""

    name: str
    command: str
    using: Rule | None = None
    check: Rule | None = None


def owner(column: str = "user_id") -> Rule:
    return lambda user: F.col(column) == user


def own_folder(bucket: str) -> Rule:
    """Objects of a bucket below a folder named by the user."""
    return lambda user: (F.col("bucket") == bucket) & (store.path_owner("path") == user.cast("string"))


SETTINGS = (
    Policy("read own settings", "select", using=owner()),
    Policy("insert own settings", "insert", check=owner()),
    Policy("update own settings", "update", using=owner()),
)
LOGOS = (
    Policy("upload own logos", "insert", check=own_folder("logos")),
    Policy("update own logos", "update", using=own_folder("logos")),
    Policy("delete own logos", "delete", using=own_folder("logos")),
    Policy("read all logos", "select", using=lambda _: F.col("bucket") == "logos"),
)


def _any(rules: list[Rule], user: Column) -> Column:
    """Whether one of the rules holds; without rules, or where they are NULL, none does."""
    held = F.lit(False)
    for rule in rules:
        held = held | F.coalesce(rule(user), F.lit(False))
    return held


def sees(policies: tuple[Policy, ...], command: str, user: Column) -> Column:
    """Whether a row is there for a command of a user; changes need it to be readable as well."""
    of = lambda c: _any([p.using for p in policies if p.command == c and p.using], user)
    return of(command) if command == "select" else of(command) & of("select")


def accepts(policies: tuple[Policy, ...], command: str, user: Column) -> Column:
    """Whether a command of a user may write a row."""
    return _any([p.check or p.using for p in policies if p.command == command and (p.check or p.using)], user)


def select(rows: DataFrame, policies: tuple[Policy, ...], user: Column) -> DataFrame:
    """The rows that a user can read."""
    return rows.where(sees(policies, "select", user))


def _written(rows: DataFrame, policies: tuple[Policy, ...], command: str, user: Column) -> DataFrame:
    """Rows to be written; one that is refused fails the job."""
    return rows.where(F.when(accepts(policies, command, user), True).otherwise(F.raise_error(F.lit(REFUSED))))


def insert(table: DataFrame, new: DataFrame, policies: tuple[Policy, ...], user: Column) -> DataFrame:
    """table with new rows, all of which the user may write."""
    return table.unionByName(_written(new, policies, "insert", user), allowMissingColumns=True)


def update(table: DataFrame, changes: dict[str, Column], where: Column, policies: tuple[Policy, ...], user: Column) -> DataFrame:
    """table with columns changed in those rows of ``where`` that the user sees; others stay, and nothing is said of it."""
    mine = F.coalesce(where, F.lit(False)) & sees(policies, "update", user)
    marked = table.withColumn("_mine", mine)
    changed = marked.select(*(F.when(F.col("_mine"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns), "_mine")
    allowed = F.when(~F.col("_mine") | accepts(policies, "update", user), True).otherwise(F.raise_error(F.lit(REFUSED)))
    return changed.where(allowed).drop("_mine")


def delete(table: DataFrame, where: Column, policies: tuple[Policy, ...], user: Column) -> DataFrame:
    """table without those rows of ``where`` that the user sees."""
    return table.where(~(F.coalesce(where, F.lit(False)) & sees(policies, "delete", user)))
