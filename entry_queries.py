"""The registered queries: each takes (spark, folder of parquet tables) and returns a DataFrame."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entry_clients import HexClient, HmacClient, PhonelessClient
from veilspark.functions.cells import rows_with_pii, tokenizable_cells
from veilspark.functions.replies import token_in_reply
from veilspark.functions.tokens import TokenKey, mock_token
from veilspark.operators import audit, govern, insights, paging
from veilspark.operators import tokenize as tok
from veilspark.operators import vault as vaults
from veilspark.operators.assign import assign_tokens, detokenize_via_client, read_values, status_counts, tokenize_via_vault
from veilspark.operators.lookup import LookupLimits
from veilspark.operators.merge import PART, merge_parts, upsert, write_parts
from veilspark.operators.numbering import batch_plan, number_rows
from veilspark.plans import publish
from veilspark.sources import customers
from veilspark.sources.customers import CUSTOMER_PII as PII
from veilspark.sources.store import RunStore, input_fingerprint
from veilspark.spec import MASKED, MODES, PLAIN_TEXT, REDACTED, PiiSpec, Policy
from veilspark.streaming import protect

Query = Callable[[SparkSession, str], DataFrame]

DEMO_SECRET = b"demo key, not for production use"
DEMO_POLICY = Policy.for_prefix("demo")
EVENT_PII = PiiSpec(columns=("user_id",), key=("event_id",))
SNAPSHOT_KEYS = ["customer_id", "email", "total_purchases", "created_at"]
PAGE_OFFSET, PAGE_SIZE = 50, 25
DEEP_OFFSET, MERGE_PARTS = 1_000, 32
# In the grown table nine of ten customers share an address.
SHARED_EMAIL, LOST_TOKEN = "everyone@example.com", "tok_lost"
# No slice of a vault counts as small, so every lookup takes the form of a large one.
ALL_LARGE = LookupLimits(broadcast_bytes=0, hot_cells=100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers.customer_profile(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))


def demo_key(spark: SparkSession) -> TokenKey:
    return TokenKey.from_secret(spark, DEMO_SECRET)


@dataclass(frozen=True)
class Published:
    """A tokenized customer table and its vault, both stored."""

    table: DataFrame
    vault: vaults.Vault


_published: dict[tuple, tuple[str, dict, bool]] = {}


def published(spark: SparkSession, sf_dir: str) -> Published:
    """Tokenize once, read many times: the stored tables of this session and these input files."""
    paths = [f"{sf_dir}/{name}.parquet" for name in ("customer", "orders")]
    wanted = (spark.sparkContext.applicationId, sf_dir, input_fingerprint(spark, *paths))
    if wanted not in _published:
        store, source, key = RunStore(spark), profile(spark, sf_dir), demo_key(spark)
        store.write(tok.tokenize(source, PII, key), "customer_data")
        built = vaults.build_vault(source, PII, key)
        stored = store.write(built, "vault", ("column_name",), vaults.VAULT_OPTIONS)
        unique = vaults.vault_duplicates(stored).isEmpty()
        _published[wanted] = store.database, dict(vaults.Vault.open(stored).slices), unique
    database, slices, unique = _published[wanted]
    return Published(
        spark.table(f"{database}.customer_data"), vaults.Vault(spark.table(f"{database}.vault"), slices, unique)
    )


def _shares_email() -> Column:
    return F.col("email").isNotNull() & (F.substring("customer_id", 5, 20).cast("bigint") % 10 != 0)


_grown: dict[tuple, str] = {}


def grown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, vaults.Vault]:
    """A table published from a fiftieth of the customers and again from all, when one e-mail address fills nine tenths of its column.

    Its vault is stored in buckets and opened as if every slice were large.
    """
    paths = [f"{sf_dir}/{name}.parquet" for name in ("customer", "orders")]
    wanted = (spark.sparkContext.applicationId, sf_dir, input_fingerprint(spark, *paths))
    if wanted not in _grown:
        store, key = RunStore(spark), demo_key(spark)
        source = profile(spark, sf_dir).withColumn("email", F.when(_shares_email(), SHARED_EMAIL).otherwise(F.col("email")))
        few = F.substring("customer_id", 5, 20).cast("bigint") % 50 == 1
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for rows in (source.where(few), source):
            publish.tokenize_and_publish(rows, PII, key, store.name("grown"), store.name("vault"), buckets=buckets, limits=ALL_LARGE)
        _grown[wanted] = store.database
    database = _grown[wanted]
    return spark.table(f"{database}.grown"), vaults.Vault.stored(spark, f"{database}.vault", ALL_LARGE)


# Generators, scans, snapshots


def generate_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers.generate_customers(spark, table(spark, sf_dir, "customer").count())


def customer_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return insights.customer_dataset(published(spark, sf_dir).table)


def customer_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir)
    detail = insights.customer_detail(p.table)
    shown = [c for c in PII.columns if c in detail.columns]
    return govern.detokenize(detail, PII, p.vault, PLAIN_TEXT, shown)


def customer_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir)
    first = insights.customer_overview(p.table)
    return govern.detokenize_few(first, insights.OVERVIEW_ROWS, RunStore(spark), PII, p.vault, MASKED)


def table_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.table_sample(published(spark, sf_dir).table, "customer_id")


def pii_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_with_pii(profile(spark, sf_dir), PII)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizable_cells(profile(spark, sf_dir), PII, PII.key)


def typed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers.typed(profile(spark, sf_dir))


def typed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared table, created, filled by two inserts and read back."""
    name, rows = RunStore(spark).name("customers"), profile(spark, sf_dir)
    odd = F.col("total_purchases") % 2 == 1
    customers.insert_typed(rows.where(odd), name)
    customers.insert_typed(rows.where(~odd), name)
    return spark.table(name)


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_count(profile(spark, sf_dir))


def snapshot_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_rows(pii_rows(spark, sf_dir), SNAPSHOT_KEYS, RunStore(spark), "snapshot")


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_plan(pii_rows(spark, sf_dir), PII, SNAPSHOT_KEYS, RunStore(spark))


def key_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.key_page(profile(spark, sf_dir), "customer_id", PAGE_OFFSET, PAGE_SIZE)


def key_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far into the table, from the files of its own rows."""
    name, keys = RunStore(spark).name("keys"), profile(spark, sf_dir).select("customer_id")
    paging.write_page_index(keys, "customer_id", name, rows_per_file=400)
    return paging.indexed_page(spark, name, "customer_id", DEEP_OFFSET, PAGE_SIZE)


def empty_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a table without rows: it is published, and its report counts nothing."""
    store = RunStore(spark)
    nobody = profile(spark, sf_dir).where("customer_id IS NULL")
    report = publish.tokenize_and_publish(nobody, PII, demo_key(spark), store.name("customer_data"), store.name("vault"))
    rows = spark.table(store.name("customer_data")).agg(F.count(F.lit(1)).alias("n_published"))
    return rows.select("n_published", *[F.lit(n).cast("bigint").alias(c) for c, n in (("n_rows", report.n_rows), ("n_tokens", report.n_tokens), ("n_calls", report.n_calls))])


def row_dicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows as dictionaries, with the cap applied by Spark, as JSON text."""
    ordered = profile(spark, sf_dir).select("customer_id", "loyalty_status", "total_purchases").orderBy("customer_id")
    found = [(json.dumps(r, sort_keys=True, separators=(",", ":")),) for r in paging.row_dicts(ordered)]
    return spark.createDataFrame(found, "row string")


# Tokenizing


def tokenize_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.tokenize(profile(spark, sf_dir), PII, demo_key(spark))


def token_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tok.token_staging(snapshot_row_number(spark, sf_dir), PII, demo_key(spark))


def token_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = tok.with_tokens(profile(spark, sf_dir), PII, demo_key(spark))
    merged = tok.merge_tokens(staged, PII, {c: F.col(f"{c}_token") for c in PII.columns})
    return merged.drop(*[f"{c}_token" for c in PII.columns])


def token_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = profile(spark, sf_dir)
    staging = tok.token_staging(source, PII, demo_key(spark), rn="customer_id")
    return tok.merge_staging(source, PII, staging, "customer_id")


def _with_first_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile where Gold customers already hold a token per value."""
    source = profile(spark, sf_dir)
    earlier = F.col("loyalty_status") == "Gold"
    return source.withColumns(
        {f"{c}_token": F.when(earlier & F.col(c).isNotNull(), F.concat(F.lit("kept_"), F.md5(c))) for c in PII.columns}
    )


def _mock_columns(df: DataFrame) -> DataFrame:
    return df.select("customer_id", *PII.columns, *[f"{c}_token" for c in PII.columns])


def mock_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mock_columns(tok.mock_tokens(profile(spark, sf_dir), PII))


def mock_tokenize_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = tok.mock_tokens(_with_first_tokens(spark, sf_dir), PII)
    return _mock_columns(tok.mock_tokens(once, PII, seed=1))


def mock_update_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _with_first_tokens(spark, sf_dir)
    page = paging.key_page(source, "customer_id", PAGE_OFFSET, PAGE_SIZE)
    return _mock_columns(paging.mock_update_page(source, PII, page))


def mock_update_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = paging.paged_update(profile(spark, sf_dir), PII, RunStore(spark), PAGE_SIZE)
    return updated.select("customer_id", "page_no", *[f"{c}_token" for c in PII.columns])


def vault_assigned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenized, _ = tokenize_via_vault(
        profile(spark, sf_dir), PII, demo_key(spark), lambda: HmacClient(DEMO_SECRET), RunStore(spark)
    )
    return tokenized


def vault_client_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens assigned by one client call per batch, then read back the same way."""
    store = RunStore(spark)
    sent = vaults.distinct_cells(profile(spark, sf_dir), PII)
    assigned = store.write(assign_tokens(sent, demo_key(spark), HexClient), "assigned")
    return read_values(assigned, HexClient)


def publish_via_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers published with tokens that a vault chose for them; their plain-text version is gone afterwards."""
    store, source = RunStore(spark), profile(spark, sf_dir)
    name = store.name("customer_data")
    publish.point_view(spark, name, publish.write_version(source, name))
    publish.publish_via_client(
        spark.table(name), PII, demo_key(spark), lambda: HmacClient(DEMO_SECRET), name, store.name("vault"), retire=True
    )
    return spark.table(name)


def _hex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with reversible tokens, of which no vault knows those of customers who share data."""
    lost = F.when(F.col("consent_data_sharing"), F.lit("lost_")).otherwise(F.lit(HexClient.PREFIX))

    def token(c: str) -> Column:
        return F.when(F.trim(c) != "", F.concat(lost, F.lower(F.hex(F.encode(c, "utf-8"))))).otherwise(F.col(c))

    return profile(spark, sf_dir).withColumns({c: token(c) for c in PII.columns})


def _client_read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return detokenize_via_client(_hex_table(spark, sf_dir), PII, PhonelessClient, RunStore(spark), MASKED, backoff=0.01)


def detokenize_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read masked through a client, where some tokens are unknown and every call for phone numbers fails."""
    return _client_read(spark, sf_dir)[0]


def client_read_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(_client_read(spark, sf_dir)[1])


def parse_token_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = profile(spark, sf_dir).select("customer_id", "email", "loyalty_status")
    token = F.concat(F.lit("TOKEN_"), F.substring(F.md5("email"), 1, 16))

    def reply(pattern: str) -> Column:
        return F.replace(F.lit(pattern), F.lit("@T"), token)

    replies = (
        F.when(F.length("email") % 3 == 0, reply('{"tokens":{"email":""},"token":"@T"}'))
        .when(F.length("email") % 5 == 0, reply('{"tokens":{"email":null},"token":"@T"}'))
        .when(F.col("loyalty_status") == "Silver", reply('{"tokens":{"email":"@T"},"token":"other"}'))
        .when(F.col("loyalty_status") == "Gold", reply('{"tokens":{"phone":"other"},"fields":{"email":"@T"}}'))
        .when(F.col("loyalty_status") == "Platinum", reply('{"fields":{},"token":"@T","email":"other"}'))
        .otherwise(reply('{"email":"@T"}'))
    )
    return source.select("customer_id", replies.alias("reply")).withColumn(
        "token", token_in_reply(F.col("reply"), "email")
    )


# Vault


def vault_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vaults.build_vault(profile(spark, sf_dir), PII, demo_key(spark))


def vault_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault of the customers who consented to marketing, refreshed from all customers."""
    source = profile(spark, sf_dir)
    first = vaults.build_vault(source.filter("consent_marketing"), PII, demo_key(spark))
    return vaults.refresh_vault(source, PII, demo_key(spark), first)


def vault_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of customers sharing data are staged; those of marketing customers are merged in."""
    source, key = profile(spark, sf_dir), demo_key(spark)
    staging = tok.token_staging(source.filter("consent_data_sharing"), PII, key, rn="customer_id")
    token = mock_token(F.col("email"), F.col("customer_id"))
    incoming = source.filter("consent_marketing AND email IS NOT NULL").select(
        "customer_id", token.alias("email_token")
    )
    return upsert(staging, incoming, ["customer_id"], ["email_token"])


def vault_merge_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New e-mail tokens of one customer in fifty merged into a stored table: the other parts' files stay."""
    name, source = RunStore(spark).name("staging"), profile(spark, sf_dir)
    write_parts(tok.token_staging(source, PII, demo_key(spark), rn="customer_id"), name, ["customer_id"], MERGE_PARTS)
    chosen = (F.substring("customer_id", 5, 20).cast("bigint") % 50 == 7) & F.col("email").isNotNull()
    incoming = source.filter(chosen).select("customer_id", mock_token(F.col("email"), F.col("customer_id")).alias("email_token"))
    merge_parts(name, incoming, ["customer_id"], ["email_token"], MERGE_PARTS)
    return spark.table(name).drop(PART)


def vault_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of a vault with 3-digit hash tokens, which do collide."""
    weak = F.concat(F.lit("TOKEN_"), F.substring(F.md5("value"), 1, 3))
    vault = vaults.distinct_cells(profile(spark, sf_dir), PII).withColumn("token", weak)
    return vaults.vault_duplicates(vault)


# Governed reads


def _detokenize(mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = published(spark, sf_dir)
        return govern.detokenize(p.table, PII, p.vault, mode)

    return run


def detokenize_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir)
    status = F.col("loyalty_status")
    mode = F.when(status == "Gold", MASKED).when(status == "Platinum", REDACTED).otherwise(PLAIN_TEXT)
    return govern.detokenize(p.table, PII, p.vault, mode)


def detokenize_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode over a table where the tokens of data-sharing customers are not in the vault."""
    p = published(spark, sf_dir)
    broken = p.table.withColumns(
        {c: F.when(F.col("consent_data_sharing"), F.concat(F.lit("lost_"), c)).otherwise(F.col(c)) for c in PII.columns}
    )
    asked = broken.select("customer_id", F.explode(F.array(*map(F.lit, MODES))).alias("mode"), *PII.columns)
    return govern.detokenize(asked, PII, p.vault, F.col("mode"))


def detokenize_after_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read through the shuffled form, where the hot tokens come from the summary of the last publish."""
    df, vault = grown(spark, sf_dir)
    return govern.detokenize(df, PII, replace(vault, bucketed=False))


def detokenize_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read six large columns masked: the vault stays in its buckets, and the rows are shuffled once."""
    df, vault = grown(spark, sf_dir)
    return govern.detokenize(df, PII, vault, MASKED)


def policy_unknown_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of a masked role over a table in which nine tenths of the e-mail cells hold one token that the vault lacks."""
    df, vault = grown(spark, sf_dir)
    broken = df.withColumn("email", F.when(_shares_email(), LOST_TOKEN).otherwise(F.col("email")))
    govern.set_role(spark, "DEMO_CUSTOMER_SERVICE")
    name = f"governed_{uuid.uuid4().hex[:12]}"
    govern.create_governed_view(name, broken, PII, vault, DEMO_POLICY)
    return spark.table(name)


def _governed_view(spark: SparkSession, sf_dir: str) -> str:
    p = published(spark, sf_dir)
    name = f"governed_{uuid.uuid4().hex[:12]}"
    govern.create_governed_view(name, p.table, PII, p.vault, DEMO_POLICY)
    return name


def _as_role(role: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        govern.set_role(spark, role)
        return spark.table(_governed_view(spark, sf_dir))

    return run


def policy_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after: whether the view exists, and every row as read through it and from the table that is left."""
    govern.set_role(spark, "DEMO_AUDITOR")
    name, p = _governed_view(spark, sf_dir), published(spark, sf_dir)

    def state(rows: DataFrame, which: str) -> DataFrame:
        return rows.select(F.lit(which).alias("state"), F.lit(spark.catalog.tableExists(name)).alias("view_exists"), "*")

    before = state(spark.table(name), "before")  # resolved here, so it can be read when the view is gone
    govern.drop_governed_view(spark, name)
    return before.unionByName(state(p.table, "after"))


def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and group on governed columns: the values compared are those the role sees."""
    govern.set_role(spark, "DEMO_CUSTOMER_SERVICE")
    seen = spark.table(_governed_view(spark, sf_dir))
    return (
        seen.filter("first_name = 'J***an' OR email LIKE 'm***@%'")
        .groupBy("first_name", "last_name")
        .agg(F.count("email").alias("n_emails"), F.sum("total_purchases").alias("purchases"))
    )


def mask_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL functions by role, with the default mode and with a mode, for every cell of the table.

    A function looks up one value, so cells are reduced to distinct tokens first: a hot token is
    looked up once and no key of the join occurs twice.
    """
    p = published(spark, sf_dir)
    govern.set_role(spark, "DEMO_CUSTOMER_SERVICE")
    prefix = f"f{uuid.uuid4().hex[:8]}_"
    govern.register_functions(spark, p.vault, DEMO_POLICY, prefix)
    vaults.distinct_cells(p.table, PII).createOrReplaceTempView(f"{prefix}cells")
    return spark.sql(
        f"SELECT column_name, n_cells, {prefix}detokenize(value) AS plain, "
        f"{prefix}conditional_detokenize(value) AS by_role, {prefix}mask_detokenize(value) AS by_alias, "
        f"{prefix}detokenize(value, 'REDACTED', 'someone') AS redacted FROM {prefix}cells"
    )


def session_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    govern.set_role(spark, "DEMO_MARKETING")
    view = _governed_view(spark, sf_dir)
    return spark.sql(
        "SELECT access_role AS role, current_user() IS NOT NULL AS has_user, "
        f"count(*) AS n_rows, count_if(email = '*REDACTED*') AS n_hidden FROM {view}"
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average purchases by loyalty and first name, as an auditor sees the tokenized table."""
    govern.set_role(spark, "DEMO_AUDITOR")
    seen = spark.table(_governed_view(spark, sf_dir))
    return seen.groupBy("loyalty_status", "first_name").agg(
        F.avg("total_purchases").alias("avg_total_purchases"), F.count(F.lit(1)).alias("n_customers")
    )


# Validation and audit


def row_count_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_count_validation(table(spark, sf_dir, "customer"), published(spark, sf_dir).table)


def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a mock run: it tokenizes blank cells too, and here only Gold rows have run."""
    return audit.token_coverage(_with_first_tokens(spark, sf_dir), PII)


def tokenization_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tokenization_summary(profile(spark, sf_dir), PII)


def tokenization_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir)
    return audit.tokenization_status(p.table, PII, p.vault.frame)


def access_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir)
    return audit.access_matrix(p.table, PII, p.vault.frame, DEMO_POLICY)


def access_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every role reads the governed view in a session of its own."""
    p = published(spark, sf_dir)

    def open_view(session: SparkSession) -> DataFrame:
        here = published(session, sf_dir)
        name = f"audited_{uuid.uuid4().hex[:12]}"
        govern.create_governed_view(name, here.table, PII, here.vault, DEMO_POLICY)
        return session.table(name)

    return audit.audit_view(spark, open_view, p.table, PII, p.vault.frame, DEMO_POLICY)


def tokenization_status_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of a table some of whose tokens the vault has lost."""
    p = published(spark, sf_dir)
    return audit.tokenization_status(p.table, PII, p.vault.frame.where("column_name <> 'email' OR length(value) % 3 <> 0"))


def row_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.row_count_validation(table(spark, sf_dir, "customer"), pii_rows(spark, sf_dir))


def access_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the audit reports of a vault that has lost the e-mail values of a length divisible by three."""
    p = published(spark, sf_dir)
    kept = p.vault.frame.where("column_name <> 'email' OR length(value) % 3 <> 0")
    return audit.access_violations(audit.access_matrix(p.table, PII, kept, DEMO_POLICY))


def table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = published(spark, sf_dir)
    p.table.createOrReplaceTempView("veil_customer_data")
    p.vault.frame.createOrReplaceTempView("veil_vault")
    return audit.table_report(spark, ["veil_customer_data", "veil_vault", "veil_not_there"])


# Insights


def _average_by(column: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return insights.avg_purchases(profile(spark, sf_dir), column)

    return run


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions the customer queries use, over all orders."""
    day = F.col("o_orderdate").cast("date")
    number = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("ORD"), F.lpad(number.cast("string"), F.greatest(F.lit(10), F.length(number.cast("string"))), "0")).alias("order_ref"),
        F.lower("o_orderpriority").alias("priority_lower"),
        F.upper("o_orderpriority").alias("priority_upper"),
        F.trim(F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" "))).alias("status"),
        F.substring(F.md5(number.cast("string")), 1, 16).alias("digest"),
        (number % 10).alias("last_digit"),
        (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(2).cast("decimal(1,0)")).cast("decimal(18,2)").alias("doubled"),
        F.ceil(number / 25).cast("bigint").alias("batch"),
        F.date_add(day, 30).cast("timestamp_ntz").alias("due"),
        insights.month("o_orderdate").alias("order_month"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "done").otherwise("part").alias("state"),
        F.coalesce(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")), F.lit("none")).alias("pending"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_urgent"),
    )


# Publishing and streams


def publish_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish plain text as version 1, tokenize it into version 2, move the view and retire version 1."""
    store = RunStore(spark)
    database = f"veilspark_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{store.path(database)}'")
    name = f"{database}.customer_data"
    plain = publish.write_version(profile(spark, sf_dir), name)
    publish.point_view(spark, name, plain)
    publish.tokenize_and_publish(spark.table(name), PII, demo_key(spark), name, f"{database}.vault", retire=True)
    return spark.table(name)


def stream_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = protect.read_stream(spark, f"{sf_dir}/events.parquet*", schema)
    return protect.drain(protect.tokenize_stream(stream, EVENT_PII, demo_key(spark)), RunStore(spark), "events")


def stream_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events tokenized in flight, and read back masked against a stored vault of their users."""
    events, store = table(spark, sf_dir, "events"), RunStore(spark)
    vault = vaults.Vault.open(store.write(vaults.build_vault(events, EVENT_PII, demo_key(spark)), "vault"))
    stream = protect.read_stream(spark, f"{sf_dir}/events.parquet*", events.schema)
    tokens = protect.tokenize_stream(stream, EVENT_PII, demo_key(spark))
    return protect.drain(protect.detokenize_stream(tokens, EVENT_PII, vault, MASKED), store, "events")


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "generate_customers": generate_customers,
    "customer_profile": profile,
    "typed_table": typed_table,
    "typed_insert": typed_insert,
    "customer_dataset": customer_dataset,
    "customer_detail": customer_detail,
    "customer_overview": customer_overview,
    "table_sample": table_sample,
    "rows_with_pii": pii_rows,
    "tokenizable_cells": cells,
    "row_count": row_count,
    "snapshot_row_number": snapshot_row_number,
    "batch_plan": batches,
    "key_page": key_page,
    "key_page_deep": key_page_deep,
    "row_dicts": row_dicts,
    "empty_run": empty_run,
    "tokenize_hmac": tokenize_hmac,
    "token_staging": token_staging,
    "token_merge": token_merge,
    "token_merge_join": token_merge_join,
    "mock_tokenize": mock_tokenize,
    "mock_tokenize_idempotent": mock_tokenize_idempotent,
    "mock_update_page": mock_update_page,
    "mock_update_all_pages": mock_update_all_pages,
    "vault_assigned_tokens": vault_assigned_tokens,
    "vault_client_read": vault_client_read,
    "publish_via_client": publish_via_client,
    "detokenize_via_client": detokenize_client,
    "client_read_status": client_read_status,
    "parse_token_reply": parse_token_reply,
    "vault_build": vault_build,
    "vault_refresh": vault_refresh,
    "vault_upsert": vault_upsert,
    "vault_merge_partial": vault_merge_partial,
    "vault_duplicates": vault_duplicates,
    "detokenize_plain": _detokenize(PLAIN_TEXT),
    "detokenize_masked": _detokenize(MASKED),
    "detokenize_redacted": _detokenize(REDACTED),
    "detokenize_by_mode": detokenize_by_mode,
    "detokenize_unknown": detokenize_unknown,
    "detokenize_after_growth": detokenize_after_growth,
    "detokenize_bucketed": detokenize_bucketed,
    "policy_unknown_hot": policy_unknown_hot,
    "policy_auditor": _as_role("DEMO_AUDITOR"),
    "policy_admin": _as_role("SYSADMIN"),
    "policy_customer_service": _as_role("DEMO_CUSTOMER_SERVICE"),
    "policy_marketing": _as_role("DEMO_MARKETING"),
    "policy_other": _as_role("PUBLIC"),
    "policy_removed": policy_removed,
    "policy_filter": policy_filter,
    "mask_alias": mask_alias,
    "session_context": session_context,
    "row_count_validation": row_count_validation,
    "token_coverage": token_coverage,
    "tokenization_summary": tokenization_summary,
    "tokenization_status": tokenization_status,
    "access_matrix": access_matrix,
    "access_audit": access_audit,
    "access_violations": access_violations,
    "tokenization_status_incomplete": tokenization_status_incomplete,
    "row_count_mismatch": row_count_mismatch,
    "table_report": table_report,
    "avg_purchases_by_loyalty": _average_by("loyalty_status"),
    "avg_purchases_by_consent_marketing": _average_by("consent_marketing"),
    "avg_purchases_by_consent_sharing": _average_by("consent_data_sharing"),
    "scalar_functions": scalar_functions,
    "publish_swap": publish_swap,
    "stream_tokenize": stream_tokenize,
    "stream_detokenize": stream_detokenize,
}
