"""Replacing protected cells by tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.cells import needs_token, text, tokenizable
from veilspark.functions.tokens import TokenKey, mock_token, value_token
from veilspark.spec import PiiSpec


def cell_token(key: TokenKey, column: str) -> Column:
    """The token of a tokenizable cell, NULL for a null or blank one."""
    cell = text(column)
    return F.when(tokenizable(cell), value_token(key, column, cell))


def merge_tokens(df: DataFrame, spec: PiiSpec, tokens: dict[str, Column]) -> DataFrame:
    """Each protected cell becomes its token, or stays if it has none; column order is kept."""
    spec.check(df)
    return df.select(
        *[F.coalesce(tokens[c], text(c)).alias(c) if c in spec.columns else F.col(c) for c in df.columns]
    )


def tokenize(df: DataFrame, spec: PiiSpec, key: TokenKey) -> DataFrame:
    """Tokenize every non-blank protected cell. A projection: no shuffle, no join, any size."""
    return merge_tokens(df, spec, {c: cell_token(key, c) for c in spec.columns})


def with_tokens(df: DataFrame, spec: PiiSpec, key: TokenKey) -> DataFrame:
    """`df` plus a `<column>_token` next to each protected column."""
    spec.check(df)
    return df.withColumns({f"{c}_token": cell_token(key, c) for c in spec.columns})


def token_staging(numbered: DataFrame, spec: PiiSpec, key: TokenKey, rn: str = "rn") -> DataFrame:
    """`(rn, <column>_token...)` of a numbered snapshot."""
    return numbered.select(rn, *[cell_token(key, c).alias(f"{c}_token") for c in spec.columns])


def merge_staging(df: DataFrame, spec: PiiSpec, staging: DataFrame, on: str) -> DataFrame:
    """Put staged tokens over the original cells. Both sides hold `on` once, so no key is hot."""
    columns = df.columns
    merged = merge_tokens(
        df.join(staging, on, "left"), spec, {c: F.col(f"{c}_token") for c in spec.columns}
    )
    return merged.select(*columns)


def mock_tokens(df: DataFrame, spec: PiiSpec, seed: int = 0, where: Column | None = None) -> DataFrame:
    """Fill `<column>_token` with mock tokens where a value has none yet; the rest is kept.

    `where` limits the rows that are updated, as the WHERE of an UPDATE does.
    """
    spec.check(df)
    row = F.concat_ws("|", *[text(k) for k in spec.key])

    def assign(column: str) -> Column:
        current = F.col(f"{column}_token") if f"{column}_token" in df.columns else F.lit(None).cast("string")
        wanted = needs_token(text(column), current)
        if where is not None:
            wanted = wanted & where
        return F.when(wanted, mock_token(text(column), row, seed)).otherwise(current)

    return df.withColumns({f"{c}_token": assign(c) for c in spec.columns})
