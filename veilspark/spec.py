"""What is protected (PiiSpec) and who may see what (Policy)."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

PLAIN_TEXT = "PLAIN_TEXT"
MASKED = "MASKED"
REDACTED = "REDACTED"
MODES = (PLAIN_TEXT, MASKED, REDACTED)

DEFAULT_BATCH_SIZE = 25


def check_mode(mode: str) -> str:
    """Return `mode` if it is known; an unknown mode must never fall back to plain text."""
    if mode not in MODES:
        raise ValueError(f"unknown redaction mode {mode!r}; expected one of {', '.join(MODES)}")
    return mode


@dataclass(frozen=True)
class PiiSpec:
    """The protected columns of a table and the columns that identify a row.

    `key` only spreads rows whose cell needs no vault lookup (see operators.lookup); it is also the
    join and paging key of the staging operators.
    """

    columns: tuple[str, ...]
    key: tuple[str, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", tuple(self.columns))
        object.__setattr__(self, "key", tuple(self.key))
        if not self.columns:
            raise ValueError("a PiiSpec needs at least one column")
        if not self.key:
            raise ValueError("a PiiSpec needs at least one key column")
        overlap = set(self.columns) & set(self.key)
        if overlap:
            raise ValueError(f"key columns cannot be protected: {sorted(overlap)}")

    def check(self, df: DataFrame) -> None:
        missing = [c for c in (*self.key, *self.columns) if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")

    def passthrough(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if c not in self.columns]


@dataclass(frozen=True)
class Policy:
    """Role to redaction mode. A role that is not listed sees the stored token."""

    roles: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for role, mode in self.roles.items():
            check_mode(mode)
            if not re.fullmatch(r"[A-Z0-9_]+", role):
                raise ValueError(f"role names are upper-case words, got {role!r}")

    @classmethod
    def for_prefix(
        cls,
        prefix: str,
        plain: str = "auditor",
        masked: str = "customer_service",
        redacted: str = "marketing",
        admin: str = "SYSADMIN",
    ) -> Policy:
        """The usual four roles; group names are prefixed and upper-cased, the admin role is not."""

        def name(group: str) -> str:
            return f"{prefix}_{group}".upper()

        return cls(
            {
                name(plain): PLAIN_TEXT,
                admin: PLAIN_TEXT,
                name(masked): MASKED,
                name(redacted): REDACTED,
            }
        )

    def mode_of(self, role: str) -> str | None:
        return self.roles.get(role)

    def roles_with(self, mode: str) -> list[str]:
        return sorted(r for r, m in self.roles.items() if m == check_mode(mode))
