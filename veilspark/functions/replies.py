"""Reading the token out of a vault reply, as a column and as a Python value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAP = "map<string,string>"
_ENTRIES = "array<struct<key:string,value:string>>"


def _entry(keyed: Column, name: str) -> Column:
    """The entry called `name` as a list of one, or an empty list."""
    entries = F.filter(F.map_entries(keyed), lambda e: e["key"] == name)
    return F.coalesce(entries, F.array().cast(_ENTRIES))


def token_in_reply(reply: Column, column: str) -> Column:
    """The token of a JSON reply record.

    Four shapes are understood, the first one present wins: `tokens.<column>`, `fields.<column>`,
    `token`, `<column>`. An empty token counts as none.
    """

    def candidates(top: Column) -> Column:
        return F.concat(
            _entry(F.from_json(top["tokens"], _MAP), column),
            _entry(F.from_json(top["fields"], _MAP), column),
            _entry(top, "token"),
            _entry(top, column),
        )

    # transform over a list of one parses the reply once for all four shapes
    found = F.get(F.transform(F.array(F.from_json(reply, _MAP)), candidates), F.lit(0))
    return F.nullif(F.get(found, F.lit(0))["value"], F.lit(""))


def token_of_record(record: dict[str, Any], column: str) -> str | None:
    """`token_in_reply` for one decoded record inside a client task."""
    bare = {column: record["token"]} if "token" in record else None
    shapes = (record.get("tokens"), record.get("fields"), bare, record)
    for shape in shapes:
        if isinstance(shape, dict) and column in shape:
            return str(shape[column]) if shape[column] else None
    return None
