"""In-process stand-ins for a remote vault, for the registered queries and the tests. They open no connection."""

from __future__ import annotations

import hashlib
import hmac
import sys
from typing import Any

from pyspark import cloudpickle

from veilspark.functions.tokens import TOKEN_PREFIX

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def masked(value: str) -> str:
    name, at, domain = value.rpartition("@")
    if at and name:
        return f"{value[0]}***@{domain}"
    return "*" * len(value) if len(value) <= 3 else f"{value[0]}***{value[-2:]}"


class HmacClient:
    """Assigns the HMAC token. Knows no values, so it cannot detokenize."""

    def __init__(self, secret: bytes) -> None:
        self._secret = secret

    def insert(self, column: str, values: list[str], request_ids: list[str]) -> list[dict[str, Any]]:
        def token(value: str) -> str:
            digest = hmac.new(self._secret, f"{column}|{value}".encode(), hashlib.sha256)
            return TOKEN_PREFIX + digest.hexdigest()

        return [{"tokens": {column: token(v)}} for v in values]

    def detokenize(self, tokens: list[str], redaction: str) -> list[dict[str, Any]]:
        return [{} for _ in tokens]


class HexClient:
    """Assigns `hex_`, the column and the UTF-8 bytes in hex: reversible, so it can render modes."""

    PREFIX = "hex_"

    def insert(self, column: str, values: list[str], request_ids: list[str]) -> list[dict[str, Any]]:
        return [{"token": self.PREFIX + v.encode().hex()} for v in values]

    def detokenize(self, tokens: list[str], redaction: str) -> list[dict[str, Any]]:
        def record(token: str) -> dict[str, Any]:
            if not token.startswith(self.PREFIX):
                return {}
            value = bytes.fromhex(token[len(self.PREFIX) :]).decode()
            return {"value": {"PLAIN_TEXT": value, "MASKED": masked(value), "REDACTED": "*REDACTED*"}[redaction]}

        return [record(t) for t in tokens]


class PhonelessClient(HexClient):
    """A vault whose phone numbers are out of reach: every call that asks for one fails in transport."""

    def detokenize(self, tokens: list[str], redaction: str) -> list[dict[str, Any]]:
        if any(t.partition("_")[2].startswith("+1-".encode().hex()) for t in tokens):
            raise OSError("connection reset")
        return super().detokenize(tokens, redaction)
