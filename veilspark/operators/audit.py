"""Counts that say whether a table is protected as intended."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.cells import readable, text, tokenizable
from veilspark.functions.masking import REDACTED_TEXT, visible
from veilspark.operators.govern import set_role
from veilspark.operators.vault import known_tokens, unresolved
from veilspark.spec import DEFAULT_BATCH_SIZE, MASKED, MODES, PiiSpec, Policy

KINDS = ("plain", "masked", "redacted", "token", "blank")
COMPLETE = "Tokenization Complete"
INCOMPLETE = "Tokenization Incomplete"


def _count_if(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def row_count_validation(old: DataFrame, new: DataFrame) -> DataFrame:
    """`(old_rows, new_rows, matches)`."""
    sides = old.sparkSession.range(1).select(
        row_count(old).scalar().alias("old_rows"), row_count(new).scalar().alias("new_rows")
    )
    return sides.withColumn("matches", F.col("old_rows") == F.col("new_rows"))


def token_coverage(df: DataFrame, spec: PiiSpec) -> DataFrame:
    """Per protected column of a table that holds `<column>` and `<column>_token` side by side:
    cells that need a token, have one, or would stay in plain text; and blank and null cells.

    One aggregate of one row, then unpivoted; the table is not expanded.
    """

    def counts(c: str) -> Column:
        cell, token = text(c), F.col(f"{c}_token")
        wanted = tokenizable(cell)
        has = token.isNotNull() & (token != cell)
        return F.struct(
            _count_if(wanted).alias("n_tokenizable"),
            _count_if(wanted & has).alias("n_tokenized"),
            _count_if(wanted & ~F.coalesce(has, F.lit(False))).alias("n_plaintext"),
            _count_if(~wanted).alias("n_blank"),
            _count_if(cell.isNull()).alias("n_null"),
        )

    one = df.agg(*[counts(c).alias(c) for c in spec.columns])
    return one.unpivot([], list(spec.columns), "column_name", "n").select("column_name", "n.*")


def tokenization_summary(df: DataFrame, spec: PiiSpec, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    """`(n_tokens, n_calls, n_rows)` of a tokenize run that sends every cell, per column in batches."""
    counted = df.agg(
        *[_count_if(tokenizable(text(c))).alias(c) for c in spec.columns],
        F.count(F.lit(1)).alias("n_rows"),
    )

    def total(each: list[Column]) -> Column:
        result = each[0]
        for column in each[1:]:
            result = result + column
        return result.cast("bigint")

    return counted.select(
        total([F.col(c) for c in spec.columns]).alias("n_tokens"),
        total([F.ceil(F.col(c) / batch_size) for c in spec.columns]).alias("n_calls"),
        "n_rows",
    )


def tokenization_status(tokenized: DataFrame, spec: PiiSpec, vault: DataFrame) -> DataFrame:
    """`(status, total_records)`: complete if the vault knows every non-blank protected cell."""
    missing = unresolved(tokenized, spec, vault).agg(F.count(F.lit(1)).alias("n"))
    status = F.when(missing.scalar() == 0, F.lit(COMPLETE)).otherwise(F.lit(INCOMPLETE))
    return row_count(tokenized).select(status.alias("status"), F.col("n_rows").alias("total_records"))


def access_matrix(
    tokenized: DataFrame,
    spec: PiiSpec,
    vault: DataFrame,
    policy: Policy,
    unlisted: str = "PUBLIC",
    on_unknown: str = "redact",
) -> DataFrame:
    """`(role, column_name, mode, n_plain, n_masked, n_redacted, n_token, n_blank)`.

    What a role sees of a cell depends on its token alone, so cells are first reduced to distinct
    tokens with counts: a hot token is looked up and rendered once, by the rule the governed view
    uses. Roles are attached to the finished counts, one row per column.
    """
    found = known_tokens(tokenized, spec, vault)
    token, value = F.col("token"), F.col("value")
    modes: list[str | None] = [*MODES, None]

    def kind(mode: str | None) -> Column:
        seen = F.col(f"seen_{mode}")
        return (
            F.when(~F.coalesce(readable(seen), F.lit(False)), "blank")
            .when(seen == value, "plain")
            .when(seen == token, "token")
            .when(seen == REDACTED_TEXT, "redacted")
            .when(seen == F.col(f"seen_{MASKED}"), "masked")
        )

    seen = found.withColumns({f"seen_{m}": visible(m, token, value, on_unknown) for m in modes})
    kinds = seen.select("column_name", "n_cells", *[kind(m).alias(f"kind_{m}") for m in modes])
    # At most 5 kinds per mode, so this is a handful of rows per column.
    sums = kinds.groupBy("column_name", *[f"kind_{m}" for m in modes]).agg(F.sum("n_cells").alias("n"))
    counted = sums.groupBy("column_name").agg(
        *[
            F.coalesce(F.sum(F.when(F.col(f"kind_{m}") == k, F.col("n"))), F.lit(0)).alias(f"{m}_{k}")
            for m in modes
            for k in KINDS
        ]
    )
    roles: list[tuple[str, str | None]] = [*sorted(policy.roles.items()), (unlisted, None)]
    entries = F.array(
        *[
            F.struct(
                F.lit(role).alias("role"),
                F.lit(mode or "TOKEN").alias("mode"),
                *[F.col(f"{mode}_{k}").alias(f"n_{k}") for k in KINDS],
            )
            for role, mode in roles
        ]
    )
    return counted.select("column_name", F.inline(entries)).select(
        "role", "column_name", "mode", *[f"n_{k}" for k in KINDS]
    )


def access_violations(matrix: DataFrame) -> DataFrame:
    """Matrix rows where a role sees a kind of value its mode does not allow.

    A raw token is one where the role should read plain text or a mask: the vault has lost its value. A
    blank cell is never a violation, and neither is a value that equals its own mask.
    """
    return matrix.filter(
        ((F.col("mode") != "PLAIN_TEXT") & (F.col("n_plain") > 0))
        | (F.col("mode").isin("PLAIN_TEXT", "MASKED") & (F.col("n_token") > 0))
        | (F.col("mode").isin("REDACTED", "TOKEN") & (F.col("n_masked") > 0))
        | (F.col("mode").isin("TOKEN") & (F.col("n_redacted") > 0))
    )


def _multiset(cell: Column, times: Column) -> Column:
    """A sum over hashes that is equal for equal multisets of cells, in whatever order they come."""
    known = F.coalesce(F.xxhash64(F.coalesce(cell, F.lit("")), cell.isNull()), F.lit(0))
    return F.sum(known.cast("decimal(38,0)") * times.cast("decimal(20,0)")).cast("decimal(38,0)")


def _expected(mode: str | None, token: Column, value: Column, on_unknown: str) -> Column:
    """What a role of this mode is to see, written down apart from the view's own rule, from the vault's value alone."""
    if mode == "PLAIN_TEXT":
        return F.coalesce(value, token)
    if mode == MASKED:
        at = F.instr(value, "@")
        stars = F.rpad(F.lit(""), F.length(value), "*")
        short = F.concat(F.left(value, F.lit(1)), F.lit("***"), F.right(value, F.lit(2)))
        return F.when(value.isNull(), token).when(at > 1, F.concat(F.left(value, F.lit(1)), F.lit("***@"), F.element_at(F.split(value, "@"), -1))).when(F.length(value) < 4, stars).otherwise(short)
    if mode is None:
        return token
    hidden = F.coalesce(readable(token), F.lit(False)) if on_unknown == "redact" else value.isNotNull()
    return F.when(hidden, F.lit(REDACTED_TEXT)).otherwise(token)


def audit_view(
    spark: SparkSession,
    open_view: Callable[[SparkSession], DataFrame],
    tokenized: DataFrame,
    spec: PiiSpec,
    vault: DataFrame,
    policy: Policy,
    unlisted: str = "PUBLIC",
    on_unknown: str = "redact",
) -> DataFrame:
    """`(role, column_name, mode, n_cells, n_expected, matches)`: each role's own read of the view against what its mode allows.

    `open_view` makes the view in the session it is given and returns it. Every role gets a new session, as a user would,
    so a wrong rule in the view, a wrong policy, or a role that is not switched shows. The cells a role sees are compared as a multiset per
    column with those expected of the table's distinct tokens; a few numbers per role and column reach the driver.
    """
    found = known_tokens(tokenized, spec, vault)
    roles: list[tuple[str, str | None]] = [*sorted(policy.roles.items()), (unlisted, None)]
    modes = list(dict.fromkeys(mode for _, mode in roles))
    sums = [_multiset(_expected(mode, F.col("token"), F.col("value"), on_unknown), F.col("n_cells")).alias(f"sum_{k}") for k, mode in enumerate(modes)]
    wanted = {r["column_name"]: r for r in found.groupBy("column_name").agg(F.sum("n_cells").alias("n"), *sums).collect()}
    rows = []
    for role, mode in roles:
        session = spark.newSession()
        for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            session.conf.set(name, spark.conf.get(name))
        set_role(session, role)
        view = open_view(session)
        seen = view.agg(F.count(F.lit(1)).alias("n"), *[_multiset(text(c), F.lit(1)).alias(c) for c in spec.columns]).first()
        for c in spec.columns:
            n, total = (wanted[c]["n"], wanted[c][f"sum_{modes.index(mode)}"]) if c in wanted else (0, None)
            rows.append((role, c, mode or "TOKEN", seen["n"], n, seen["n"] == n and seen[c] == total))
    return spark.createDataFrame(rows, "role string, column_name string, mode string, n_cells bigint, n_expected bigint, matches boolean")


def table_report(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """`(table_name, table_exists, n_rows)`, 0 rows for a table that does not exist."""
    reports: DataFrame | None = None
    for name in names:
        exists = spark.catalog.tableExists(name)
        counts = row_count(spark.table(name)) if exists else spark.range(1).select(F.lit(0).cast("bigint").alias("n_rows"))
        row = counts.select(F.lit(name).alias("table_name"), F.lit(exists).alias("table_exists"), "n_rows")
        reports = row if reports is None else reports.unionByName(row)
    if reports is None:
        raise ValueError("no table names given")
    return reports
