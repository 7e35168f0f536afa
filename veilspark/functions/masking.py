"""What a reader sees of a cell, given its stored token and its vault value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions.cells import readable
from veilspark.spec import MASKED, MODES, PLAIN_TEXT, REDACTED, check_mode

REDACTED_TEXT = "*REDACTED*"

ON_UNKNOWN = ("redact", "token")


def mask(value: Column) -> Column:
    """Partial hiding: `j***@example.com` for e-mail, `J***an` otherwise, all stars up to length 3."""
    first = F.substring(value, 1, 1)
    return (
        F.when(F.instr(value, "@") > 1, F.concat(first, F.lit("***@"), F.substring_index(value, "@", -1)))
        .when(F.length(value) <= 3, F.repeat(F.lit("*"), F.length(value)))
        .otherwise(F.concat(first, F.lit("***"), F.substring(value, -2, 2)))
    )


def mask_sql(value: str) -> str:
    """`mask` as SQL text, for the body of a SQL function."""
    return (
        f"CASE WHEN instr({value}, '@') > 1 "
        f"THEN concat(substring({value}, 1, 1), '***@', substring_index({value}, '@', -1)) "
        f"WHEN length({value}) <= 3 THEN repeat('*', length({value})) "
        f"ELSE concat(substring({value}, 1, 1), '***', right({value}, 2)) END"
    )


def visible(mode: str | None, token: Column, value: Column, on_unknown: str = "redact") -> Column:
    """The cell under one mode; `None` is a role without access.

    A token the vault does not know is shown as it is. REDACTED may instead hide every non-blank
    cell (`on_unknown="redact"`), which fails closed and needs no lookup at all.
    """
    if on_unknown not in ON_UNKNOWN:
        raise ValueError(f"on_unknown must be one of {ON_UNKNOWN}")
    if mode is None:
        return token
    check_mode(mode)
    if mode == PLAIN_TEXT:
        return F.coalesce(value, token)
    if mode == MASKED:
        return F.coalesce(mask(value), token)
    hidden = readable(token) if on_unknown == "redact" else value.isNotNull()
    return F.when(hidden, F.lit(REDACTED_TEXT)).otherwise(token)


def checked_mode(mode: Column) -> Column:
    """A mode column that fails the query where it holds an unknown mode or NULL."""
    message = F.concat(F.lit("unknown redaction mode: "), F.coalesce(mode, F.lit("NULL")))
    return F.when(mode.isin(*MODES), mode).otherwise(F.raise_error(message).cast("string"))


def visible_by(
    is_plain: Column, is_masked: Column, token: Column, value: Column, on_unknown: str = "token"
) -> Column:
    """The cell where the mode differs by row: PLAIN_TEXT, MASKED, and REDACTED otherwise."""
    known = F.when(is_plain, value).when(is_masked, mask(value)).otherwise(F.lit(REDACTED_TEXT))
    if on_unknown == "redact":
        hidden = ~(is_plain | is_masked)
        return F.when(hidden, visible(REDACTED, token, value)).when(value.isNull(), token).otherwise(known)
    return F.when(value.isNull(), token).otherwise(known)
