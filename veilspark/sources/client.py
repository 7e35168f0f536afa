"""The batch client of a vault that assigns tokens itself. The package holds no client: a caller brings one."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, Protocol


class VaultClient(Protocol):
    """One connection. Built inside a task by a `ClientFactory`, so it need not be picklable.

    `insert` must be idempotent per request id: a retried task sends the same ids again.
    """

    def insert(self, column: str, values: list[str], request_ids: list[str]) -> list[dict[str, Any]]: ...

    def detokenize(self, tokens: list[str], redaction: str) -> list[dict[str, Any]]: ...


ClientFactory = Callable[[], VaultClient]
