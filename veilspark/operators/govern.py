"""Governed reads: what each role sees of a tokenized table.

The DataFrame forms and the governed view use the skew-safe lookup and suit whole-table reads. The
SQL functions take a single value, so they look a token up by a correlated subquery; they suit
distinct tokens and filtered, ad-hoc reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import READ_BLANKS
from veilspark.functions.masking import REDACTED_TEXT, checked_mode, mask_sql, visible, visible_by
from veilspark.operators.vault import Vault, resolve, shared_tokens
from veilspark.sources.store import RunStore
from veilspark.spec import MASKED, MODES, PLAIN_TEXT, REDACTED, PiiSpec, Policy, check_mode

ROLE_VARIABLE = "access_role"

# Up to here the tokens of a read are broadcast to the vault: at most a few MB.
FEW_ROWS = 10_000


def detokenize(
    df: DataFrame,
    spec: PiiSpec,
    vault: Vault,
    mode: str | Column = PLAIN_TEXT,
    columns: Sequence[str] | None = None,
    on_unknown: str = "token",
    few: bool = False,
) -> DataFrame:
    """Show `columns` (default: all protected ones) under `mode`, a name or a column of names.

    `few` is set by `detokenize_few`, for a stored table of bounded size.
    """
    columns = list(spec.columns if columns is None else columns)
    if isinstance(mode, str):
        check_mode(mode)
        if mode == REDACTED and on_unknown == "redact":
            return df.withColumns({c: visible(mode, F.col(c), F.lit(None), on_unknown) for c in columns})
        shown = df
    else:
        asked = df.withColumn("__mode", checked_mode(mode))
        shown = asked.select(
            *df.columns,
            (F.col("__mode") == PLAIN_TEXT).alias("__plain"),
            (F.col("__mode") == MASKED).alias("__masked"),
        )

    def render(c: str, token: Column, value: Column) -> dict[str, Column]:
        if isinstance(mode, str):
            return {c: visible(mode, token, value, on_unknown)}
        return {c: visible_by(F.col("__plain"), F.col("__masked"), token, value, on_unknown)}

    return resolve(shown, columns, vault, spec.key, render, few=few).select(*df.columns)


def detokenize_few(
    df: DataFrame,
    n: int,
    store: RunStore,
    spec: PiiSpec,
    vault: Vault,
    mode: str | Column = PLAIN_TEXT,
    on_unknown: str = "token",
    name: str = "few",
) -> DataFrame:
    """The first `n` rows of `df` under `mode`, without a shuffle of the vault.

    The rows are written first, still as tokens, so that finding them is not repeated per column and every column is of the same rows.
    More than FEW_ROWS rows are then read the way a whole table is.
    """
    rows = store.write(df.limit(n), name if n <= FEW_ROWS else f"{name}_{n}")
    return detokenize(rows, spec, vault, mode, on_unknown=on_unknown, few=n <= FEW_ROWS)


def govern(
    df: DataFrame, spec: PiiSpec, vault: Vault, policy: Policy, role: str, on_unknown: str = "redact"
) -> DataFrame:
    """The table as `role` sees it. A role without access causes no lookup."""
    mode = policy.mode_of(role)
    return df if mode is None else detokenize(df, spec, vault, mode, on_unknown=on_unknown)


def _declare_role(spark: SparkSession) -> None:
    """A session starts without a role, which sees tokens. A role that is already set is kept."""
    try:
        spark.sql(f"SELECT {ROLE_VARIABLE}")
    except AnalysisException:
        spark.sql(f"DECLARE VARIABLE {ROLE_VARIABLE} STRING DEFAULT ''")


def set_role(spark: SparkSession, role: str) -> None:
    """Switch the session's role; it applies to every governed read analyzed from here on."""
    _declare_role(spark)
    spark.sql(f"SET VAR {ROLE_VARIABLE} = :role", args={"role": role})


def _role_in(policy: Policy, mode: str) -> str | None:
    names = ", ".join(f"'{r}'" for r in policy.roles_with(mode))
    return f"{ROLE_VARIABLE} IN ({names})" if names else None


def create_governed_view(
    name: str,
    df: DataFrame,
    spec: PiiSpec,
    vault: Vault,
    policy: Policy,
    on_unknown: str = "redact",
) -> None:
    """A session view over `df` whose protected cells depend on the role at query time.

    The view text names the role variable, which the analyzer replaces by its value. The CASE then
    folds to one branch, and vault joins that branch or the query does not read are dropped.
    """
    spark = df.sparkSession
    _declare_role(spark)
    hidden = f"{name}__resolved"

    def render(c: str, token: Column, value: Column) -> dict[str, Column]:
        return {f"{c}__{mode}": visible(mode, token, value, on_unknown) for mode in MODES}

    resolve(df, spec.columns, vault, spec.key, render, prunable=True).createOrReplaceTempView(hidden)

    def governed(c: str) -> str:
        if c not in spec.columns:
            return f"`{c}`"
        tests = [(m, _role_in(policy, m)) for m in MODES]
        whens = " ".join(f"WHEN {test} THEN `{c}__{m}`" for m, test in tests if test)
        return f"CASE {whens} ELSE `{c}` END AS `{c}`" if whens else f"`{c}`"

    body = ", ".join(governed(c) for c in df.columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS SELECT {body} FROM `{hidden}`")


def drop_governed_view(spark: SparkSession, name: str) -> None:
    """Take the policy away; the table under the view is not touched."""
    spark.catalog.dropTempView(name)
    spark.catalog.dropTempView(f"{name}__resolved")


def register_functions(spark: SparkSession, vault: Vault, policy: Policy, prefix: str = "") -> None:
    """SQL functions `detokenize(val, mode, user_context)`, `conditional_detokenize(val)` and
    `mask_detokenize(token)`.

    No column is named, so all slices of the vault are searched; namespaced tokens do not collide.
    `user_context` is accepted and has no effect. An unknown mode fails the query. A vault in which a token
    stands for several values is refused.
    """
    if not shared_tokens(vault.frame).isEmpty():
        raise ValueError("the vault has tokens that stand for several values")
    _declare_role(spark)
    source = f"{prefix}vault_lookup"
    vault.frame.select("token", "value").createOrReplaceTempView(source)
    blanks = "".join(f"\\u{ord(ch):04x}" for ch in READ_BLANKS)

    def create(signature: str, body: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS STRING RETURN {body}")

    create("vault_value(val STRING)", f"(SELECT max(v.value) FROM {source} v WHERE v.token = val)")
    create(
        "render(val STRING, found STRING, mode STRING)",
        f"CASE WHEN mode IS NULL OR mode NOT IN ('{PLAIN_TEXT}', '{MASKED}', '{REDACTED}') "
        "THEN CAST(raise_error(concat('unknown redaction mode: ', coalesce(mode, 'NULL'))) AS STRING) "
        f"WHEN found IS NULL OR val IS NULL OR btrim(val, '{blanks}') = '' THEN val "
        f"WHEN mode = '{PLAIN_TEXT}' THEN found "
        f"WHEN mode = '{MASKED}' THEN {mask_sql('found')} "
        f"ELSE '{REDACTED_TEXT}' END",
    )
    create(
        f"detokenize(val STRING, mode STRING DEFAULT '{PLAIN_TEXT}', user_context STRING DEFAULT '')",
        f"{prefix}render(val, {prefix}vault_value(val), mode)",
    )
    whens = " ".join(
        f"WHEN {test} THEN {prefix}detokenize(val, '{m}', current_user())"
        for m in MODES
        if (test := _role_in(policy, m))
    )
    create("conditional_detokenize(val STRING)", f"CASE {whens} ELSE val END" if whens else "val")
    create("mask_detokenize(token STRING)", f"{prefix}conditional_detokenize(token)")
