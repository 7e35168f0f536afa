"""DuckDB SQL giving the same rows as each registered query, from the raw tables alone."""

from __future__ import annotations

from entry_queries import DEEP_OFFSET, DEMO_POLICY, DEMO_SECRET, LOST_TOKEN, PAGE_OFFSET, PAGE_SIZE, SHARED_EMAIL
from veilspark.functions.tokens import padded_key
from veilspark.sources.customers import ADDRESSES, BIRTH_DATES, DEFAULT_AS_OF, FIRST_NAMES, LANGUAGES, LAST_NAMES, LOYALTY
from veilspark.spec import DEFAULT_BATCH_SIZE

COLUMNS = ("first_name", "last_name", "email", "phone_number", "address", "date_of_birth")
OTHERS = (
    "signup_date",
    "last_login",
    "total_purchases",
    "total_spent",
    "loyalty_status",
    "preferred_language",
    "consent_marketing",
    "consent_data_sharing",
    "created_at",
    "updated_at",
)
TAIL = ", ".join(OTHERS)

_IPAD, _OPAD = (block.hex() for block in padded_key(DEMO_SECRET))


def choose(index: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {whens} ELSE '{values[-1]}' END"


PROFILE = f"""
spend AS (
  SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS decimal(18,2)) AS spent,
         min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts
  FROM orders GROUP BY o_custkey),
base AS (
  SELECT c_custkey AS id, n, spent, first_ts, last_ts,
         {choose("c_custkey % 4", FIRST_NAMES)} AS fn, {choose("c_custkey % 4", LAST_NAMES)} AS ln
  FROM customer LEFT JOIN spend ON c_custkey = o_custkey),
profile AS (
  SELECT
    'CUST' || lpad(CAST(id AS varchar), CAST(greatest(8, length(CAST(id AS varchar))) AS integer), '0') AS customer_id,
    CASE WHEN id % 23 = 0 THEN NULL ELSE fn END AS first_name,
    CASE WHEN id % 23 = 0 THEN NULL ELSE ln END AS last_name,
    CASE WHEN id % 23 = 0 THEN NULL
         ELSE lower(fn) || '.' || lower(ln) || CAST(id AS varchar) || '@example.com' END AS email,
    CASE WHEN id % 23 = 0 OR id % 17 = 0 THEN NULL
         ELSE '+1-555-' || lpad(CAST(id % 10000 AS varchar), 4, '0') END AS phone_number,
    CASE WHEN id % 23 = 0 THEN NULL WHEN id % 19 = 0 THEN '' WHEN id % 29 = 0 THEN '  '
         ELSE {choose("id % 10", ADDRESSES)} END AS address,
    CASE WHEN id % 23 = 0 THEN NULL
         ELSE CAST(1985 + id % 10 AS varchar) || '-' || lpad(CAST(1 + id % 12 AS varchar), 2, '0') || '-'
              || lpad(CAST(1 + id % 28 AS varchar), 2, '0') END AS date_of_birth,
    first_ts AS signup_date,
    last_ts AS last_login,
    CAST(coalesce(n, 0) AS bigint) AS total_purchases,
    CAST(coalesce(spent, 0) AS decimal(18,2)) AS total_spent,
    {choose("id % 4", LOYALTY)} AS loyalty_status,
    {choose("id % 2", LANGUAGES)} AS preferred_language,
    id % 2 = 0 AS consent_marketing,
    id % 3 = 0 AS consent_data_sharing,
    first_ts AS created_at,
    last_ts AS updated_at
  FROM base)"""


def hmac(column: str, value: str) -> str:
    message = f"encode({column} || '|' || {value})"
    inner = f"unhex(sha256(unhex('{_IPAD}') || {message}))"
    return f"('tok_' || sha256(unhex('{_OPAD}') || {inner}))"


def cell(column: str) -> str:
    """The token of a cell, NULL if it needs none."""
    return f"CASE WHEN trim({column}) <> '' THEN {hmac(repr(column), column)} END"


def long(source: str, where: str = "true") -> str:
    return " UNION ALL ".join(
        f"SELECT customer_id, '{c}' AS column_name, {c} AS value FROM {source} WHERE {where}" for c in COLUMNS
    )


def vault(source: str, where: str = "true") -> str:
    return f"""SELECT column_name, {hmac("column_name", "value")} AS token, value, n_cells FROM (
      SELECT column_name, value, count(*) AS n_cells FROM ({long(source, where)})
      WHERE trim(value) <> '' GROUP BY column_name, value)"""


TOKENIZED = f"""{PROFILE},
tokenized AS (
  SELECT customer_id, {", ".join(f"coalesce({cell(c)}, {c}) AS {c}" for c in COLUMNS)}, {TAIL} FROM profile),
vault AS ({vault("profile")})"""

ALL = f"customer_id, {', '.join(COLUMNS)}, {TAIL}"


def mask(v: str) -> str:
    return (
        f"CASE WHEN instr({v}, '@') > 1 THEN substr({v}, 1, 1) || '***@' || split_part({v}, '@', -1) "
        f"WHEN length({v}) <= 3 THEN repeat('*', length({v})) "
        f"ELSE substr({v}, 1, 1) || '***' || right({v}, 2) END"
    )


def shown(mode: str, token: str, value: str) -> str:
    return {
        "PLAIN_TEXT": f"coalesce({value}, {token})",
        "MASKED": f"coalesce({mask(value)}, {token})",
        "REDACTED": f"CASE WHEN {value} IS NOT NULL THEN '*REDACTED*' ELSE {token} END",
    }[mode]


def vault_joins(source: str) -> str:
    joins = " ".join(
        f"LEFT JOIN vault v_{c} ON v_{c}.column_name = '{c}' AND v_{c}.token = t.{c}" for c in COLUMNS
    )
    return f"FROM {source} t {joins}"


def read(mode: str) -> str:
    cells = ", ".join(f"{shown(mode, f't.{c}', f'v_{c}.value')} AS {c}" for c in COLUMNS)
    return f"WITH {TOKENIZED} SELECT t.customer_id, {cells}, {TAIL} {vault_joins('tokenized')}"


def read_by(mode: str, source: str) -> tuple[str, str]:
    def one(c: str) -> str:
        whens = " ".join(
            f"WHEN '{m}' THEN {shown(m, f't.{c}', f'v_{c}.value')}" for m in ("PLAIN_TEXT", "MASKED", "REDACTED")
        )
        return f"CASE {mode} {whens} END AS {c}"

    return ", ".join(one(c) for c in COLUMNS), vault_joins(source)


def mock(column: str, seed: int = 0) -> str:
    return f"'TOKEN_' || substr(md5({column} || '|' || customer_id || '|{seed}'), 1, 16)"


def first_token(c: str) -> str:
    return f"CASE WHEN loyalty_status = 'Gold' AND {c} IS NOT NULL THEN 'kept_' || md5({c}) END"


FIRST_TOKENS = f"""{PROFILE},
started AS (SELECT *, {", ".join(f"{first_token(c)} AS {c}_token" for c in COLUMNS)} FROM profile)"""

MOCK_COLUMNS = "customer_id, " + ", ".join(COLUMNS)


def averages(column: str) -> str:
    return (
        f"WITH {PROFILE} SELECT {column}, avg(total_purchases) AS avg_total_purchases FROM profile "
        f"GROUP BY {column} ORDER BY avg_total_purchases DESC, {column}"
    )


SNAPSHOT = f"""{PROFILE},
snapshot AS (
  SELECT row_number() OVER (ORDER BY customer_id, email, total_purchases, created_at) AS rn, *
  FROM profile WHERE {" OR ".join(f"{c} IS NOT NULL" for c in COLUMNS)})"""


def generated() -> str:
    day = "CAST(CAST('{}' AS date) + CAST(k % 2000000 AS integer) AS timestamp)"
    return f"""
    WITH numbered AS (
      SELECT id, id - 1 AS k, (SELECT greatest(5, length(CAST(count(*) AS varchar))) FROM customer) AS width
      FROM range(1, (SELECT count(*) + 1 FROM customer)) t(id)),
    named AS (
      SELECT *, {choose("k % 4", FIRST_NAMES)} AS fn,
             {choose("k % 4", LAST_NAMES)} AS ln FROM numbered)
    SELECT 'CUST' || lpad(CAST(id AS varchar), CAST(width AS integer), '0') AS customer_id,
      fn AS first_name, ln AS last_name, lower(fn) || '.' || lower(ln) || '@example.com' AS email,
      '+1-555-010' || CAST(k % 10 AS varchar) AS phone_number, {choose("k % 10", ADDRESSES)} AS address,
      {choose("k % 10", BIRTH_DATES)} AS date_of_birth,
      {day.format("2018-01-01")} AS signup_date, {day.format("2023-01-01")} AS last_login,
      id * 5 AS total_purchases, CAST(id * 50 AS decimal(18,2)) AS total_spent,
      {choose("k % 4", LOYALTY)} AS loyalty_status,
      {choose("k % 2", LANGUAGES)} AS preferred_language,
      k % 2 = 0 AS consent_marketing, k % 3 = 0 AS consent_data_sharing,
      CAST('{DEFAULT_AS_OF}' AS timestamp) AS created_at, CAST('{DEFAULT_AS_OF}' AS timestamp) AS updated_at
    FROM named"""


def batch_plan() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, rn, {c} AS value FROM snapshot WHERE trim({c}) <> ''" for c in COLUMNS
    )
    return f"""WITH {SNAPSHOT}
    SELECT column_name, rn, value,
           (row_number() OVER (PARTITION BY column_name ORDER BY rn) - 1) // {DEFAULT_BATCH_SIZE} AS batch_no
    FROM ({parts})"""


def mock_query(kind: str) -> str:
    if kind == "plain":
        tokens = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {mock(c)} END AS {c}_token" for c in COLUMNS)
        return f"WITH {PROFILE} SELECT {MOCK_COLUMNS}, {tokens} FROM profile"
    hit = "true"
    if kind == "page":
        hit = f"customer_id IN (SELECT customer_id FROM profile ORDER BY customer_id LIMIT {PAGE_SIZE} OFFSET {PAGE_OFFSET})"
    tokens = ", ".join(
        f"CASE WHEN {c} IS NOT NULL AND {c}_token IS NULL AND {hit} THEN {mock(c)} ELSE {c}_token END AS {c}_token"
        for c in COLUMNS
    )
    return f"WITH {FIRST_TOKENS} SELECT {MOCK_COLUMNS}, {tokens} FROM started"


def paged() -> str:
    tokens = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {mock(c)} END AS {c}_token" for c in COLUMNS)
    return f"""WITH {PROFILE} SELECT customer_id,
      (row_number() OVER (ORDER BY customer_id) - 1) // {PAGE_SIZE} AS page_no, {tokens} FROM profile"""


def replies() -> str:
    return f"""WITH {PROFILE},
    asked AS (
      SELECT customer_id, replace(CASE
        WHEN length(email) % 3 = 0 THEN '{{"tokens":{{"email":""}},"token":"@T"}}'
        WHEN length(email) % 5 = 0 THEN '{{"tokens":{{"email":null}},"token":"@T"}}'
        WHEN loyalty_status = 'Silver' THEN '{{"tokens":{{"email":"@T"}},"token":"other"}}'
        WHEN loyalty_status = 'Gold' THEN '{{"tokens":{{"phone":"other"}},"fields":{{"email":"@T"}}}}'
        WHEN loyalty_status = 'Platinum' THEN '{{"fields":{{}},"token":"@T","email":"other"}}'
        ELSE '{{"email":"@T"}}' END, '@T', 'TOKEN_' || substr(md5(email), 1, 16)) AS reply
      FROM profile)
    SELECT customer_id, reply, nullif(CASE
        WHEN json_exists(reply, '$.tokens.email') THEN reply->>'$.tokens.email'
        WHEN json_exists(reply, '$.fields.email') THEN reply->>'$.fields.email'
        WHEN json_exists(reply, '$.token') THEN reply->>'$.token'
        WHEN json_exists(reply, '$.email') THEN reply->>'$.email' END, '') AS token
    FROM asked"""


def refresh() -> str:
    return f"""WITH {PROFILE},
    first AS ({vault("profile", "consent_marketing")}),
    every AS ({vault("profile")})
    SELECT * FROM first UNION ALL
    SELECT * FROM every e WHERE NOT EXISTS (
      SELECT 1 FROM first f WHERE f.column_name = e.column_name AND f.value = e.value)"""


def upserted() -> str:
    rest = ", ".join(f"t.{c}_token" for c in COLUMNS if c != "email")
    return f"""WITH {PROFILE},
    target AS (SELECT customer_id, {", ".join(f"{cell(c)} AS {c}_token" for c in COLUMNS)}
               FROM profile WHERE consent_data_sharing),
    source AS (SELECT customer_id, {mock("email")} AS email_token
               FROM profile WHERE consent_marketing AND email IS NOT NULL)
    SELECT coalesce(s.customer_id, t.customer_id) AS customer_id,
           CASE WHEN s.customer_id IS NOT NULL THEN s.email_token ELSE t.email_token END AS email_token, {rest}
    FROM target t FULL JOIN source s ON t.customer_id = s.customer_id"""


def merged_parts() -> str:
    rest = ", ".join(f"{cell(c)} AS {c}_token" for c in COLUMNS if c != "email")
    chosen = "CAST(substr(customer_id, 5) AS bigint) % 50 = 7 AND email IS NOT NULL"
    return f"""WITH {PROFILE} SELECT customer_id, CASE WHEN {chosen} THEN {mock("email")} ELSE {cell("email")} END AS email_token, {rest}
      FROM profile"""


def audited() -> str:
    roles = ", ".join(f"('{r}', '{m}')" for r, m in DEMO_POLICY.roles.items())
    return f"""WITH policy(role, mode) AS (VALUES {roles}, ('PUBLIC', 'TOKEN')),
      names(column_name) AS (VALUES {', '.join(f"('{c}')" for c in COLUMNS)}),
      total AS (SELECT count(*) AS n FROM customer)
      SELECT role, column_name, mode, n AS n_cells, n AS n_expected, true AS matches FROM policy, names, total"""


def duplicates() -> str:
    return f"""WITH {PROFILE},
    weak AS (SELECT DISTINCT column_name, value, 'TOKEN_' || substr(md5(value), 1, 3) AS token
             FROM ({long("profile")}) WHERE trim(value) <> '')
    SELECT column_name, 'token' AS kind, token AS item, count(*) AS n FROM weak GROUP BY column_name, token
    HAVING count(*) > 1
    UNION ALL SELECT column_name, 'value', value, count(*) FROM weak GROUP BY column_name, value
    HAVING count(*) > 1"""


def unknown() -> str:
    cells, joins = read_by("t.mode", "asked")
    broken = ", ".join(f"CASE WHEN consent_data_sharing THEN 'lost_' || {c} ELSE {c} END AS {c}" for c in COLUMNS)
    return f"""WITH {TOKENIZED},
    asked AS (SELECT customer_id, {broken}, mode FROM tokenized
              CROSS JOIN (VALUES ('PLAIN_TEXT'), ('MASKED'), ('REDACTED')) m(mode))
    SELECT t.customer_id, t.mode, {cells} {joins}"""


def by_mode() -> str:
    mode = "CASE t.loyalty_status WHEN 'Gold' THEN 'MASKED' WHEN 'Platinum' THEN 'REDACTED' ELSE 'PLAIN_TEXT' END"
    cells, joins = read_by(f"({mode})", "tokenized")
    return f"WITH {TOKENIZED} SELECT t.customer_id, {cells}, {TAIL} {joins}"


def redacted_view() -> str:
    cells = ", ".join(f"CASE WHEN trim({c}) <> '' THEN '*REDACTED*' ELSE {c} END AS {c}" for c in COLUMNS)
    return f"WITH {TOKENIZED} SELECT customer_id, {cells}, {TAIL} FROM tokenized"


SHARES_EMAIL = "(email IS NOT NULL AND CAST(substr(customer_id, 5) AS bigint) % 10 <> 0)"
GROWN = f"""{PROFILE},
grown AS (SELECT * REPLACE (CASE WHEN {SHARES_EMAIL} THEN '{SHARED_EMAIL}' ELSE email END AS email) FROM profile)"""


def grown_masked(email: str | None = None) -> str:
    """Masked cells of the grown table; `email` is what a shared address shows instead."""
    shown_as = {c: f"CASE WHEN trim({c}) <> '' THEN {mask(c)} ELSE {c} END" for c in COLUMNS}
    if email:
        shown_as["email"] = f"CASE WHEN {SHARES_EMAIL} THEN '{email}' ELSE {shown_as['email']} END"
    cells = ", ".join(f"{sql} AS {c}" for c, sql in shown_as.items())
    return f"WITH {GROWN} SELECT customer_id, {cells}, {TAIL} FROM grown"


def client_read() -> str:
    """Masked cells where the client knows the token and can reach it, else the token."""

    def one(c: str) -> str:
        token = f"CASE WHEN consent_data_sharing THEN 'lost_' ELSE 'hex_' END || lower(hex(encode({c})))"
        known = "false" if c == "phone_number" else "NOT consent_data_sharing"
        return f"CASE WHEN trim({c}) <> '' THEN CASE WHEN {known} THEN {mask(c)} ELSE {token} END ELSE {c} END AS {c}"

    return f"WITH {PROFILE} SELECT customer_id, {', '.join(map(one, COLUMNS))}, {TAIL} FROM profile"


def client_status() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, consent_data_sharing AS lost FROM profile WHERE trim({c}) <> ''" for c in COLUMNS
    )
    # A call holds 25 tokens of one column, sorted by nothing else: one that holds a phone number fails as a whole.
    status = "CASE WHEN column_name = 'phone_number' THEN 'failed' WHEN lost THEN 'unknown' ELSE 'found' END"
    return f"""WITH {PROFILE} SELECT column_name, {status} AS status, count(DISTINCT value || CAST(lost AS varchar)) AS n_tokens, count(*) AS n_cells
      FROM ({cells}) GROUP BY 1, 2"""


def coverage() -> str:
    def one(c: str) -> str:
        wanted = f"coalesce(trim({c}) <> '', false)"
        has = f"coalesce({c}_token <> {c}, false)"
        return f"""SELECT '{c}' AS column_name,
          count(*) FILTER (WHERE {wanted}) AS n_tokenizable,
          count(*) FILTER (WHERE {wanted} AND {has}) AS n_tokenized,
          count(*) FILTER (WHERE {wanted} AND NOT {has}) AS n_plaintext,
          count(*) FILTER (WHERE trim({c}) = '') AS n_blank,
          count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM started"""

    return f"WITH {FIRST_TOKENS} {' UNION ALL '.join(one(c) for c in COLUMNS)}"


def summary() -> str:
    tokens = " + ".join(f"count(*) FILTER (WHERE trim({c}) <> '')" for c in COLUMNS)
    calls = " + ".join(
        f"CAST(ceil(count(*) FILTER (WHERE trim({c}) <> '') / {DEFAULT_BATCH_SIZE}.0) AS bigint)" for c in COLUMNS
    )
    return f"""WITH {PROFILE} SELECT CAST({tokens} AS bigint) AS n_tokens, CAST({calls} AS bigint) AS n_calls,
      count(*) AS n_rows FROM profile"""


def matrix(vault_name: str = "vault", more: str = "") -> str:
    """The matrix by the vault `vault_name`, which the tables `more` may define."""
    roles = ", ".join(f"('{r}', '{m}')" for r, m in DEMO_POLICY.roles.items())
    seen = " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, p.role, p.mode, t.{c} AS token, v.value, CASE p.mode
          WHEN 'PLAIN_TEXT' THEN {shown("PLAIN_TEXT", f"t.{c}", "v.value")}
          WHEN 'MASKED' THEN {shown("MASKED", f"t.{c}", "v.value")}
          WHEN 'REDACTED' THEN CASE WHEN trim(t.{c}) <> '' THEN '*REDACTED*' ELSE t.{c} END
          ELSE t.{c} END AS seen
        FROM tokenized t LEFT JOIN {vault_name} v ON v.column_name = '{c}' AND v.token = t.{c} CROSS JOIN policy p"""
        for c in COLUMNS
    )
    return f"""WITH {TOKENIZED},{more} policy(role, mode) AS (VALUES {roles}, ('PUBLIC', 'TOKEN')),
    seen AS ({seen}),
    kinds AS (SELECT role, column_name, mode, CASE WHEN seen IS NULL OR trim(seen) = '' THEN 'blank'
      WHEN seen = value THEN 'plain' WHEN seen = token THEN 'token' WHEN seen = '*REDACTED*' THEN 'redacted'
      WHEN seen = {mask("value")} THEN 'masked' END AS kind FROM seen)
    SELECT role, column_name, mode, {", ".join(
        f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ("plain", "masked", "redacted", "token", "blank"))}
    FROM kinds GROUP BY role, column_name, mode"""


def violations() -> str:
    kept = " kept AS (SELECT * FROM vault WHERE column_name <> 'email' OR length(value) % 3 <> 0),"
    return f"""SELECT * FROM ({matrix("kept", kept)}) WHERE (mode <> 'PLAIN_TEXT' AND n_plain > 0)
      OR (mode IN ('PLAIN_TEXT', 'MASKED') AND n_token > 0) OR (mode IN ('REDACTED', 'TOKEN') AND n_masked > 0)
      OR (mode = 'TOKEN' AND n_redacted > 0)"""


def events(cell_sql: str) -> str:
    return f"""WITH seen AS (SELECT * REPLACE (CAST(user_id AS varchar) AS user_id) FROM events)
    SELECT event_id, ts, {cell_sql} AS user_id, event_type, value, props FROM seen"""


FILTERED = f"""WITH {TOKENIZED}, seen AS (
  SELECT {shown("MASKED", "t.first_name", "v_first_name.value")} AS first_name,
         {shown("MASKED", "t.last_name", "v_last_name.value")} AS last_name,
         {shown("MASKED", "t.email", "v_email.value")} AS email, total_purchases {vault_joins("tokenized")})
SELECT first_name, last_name, count(email) AS n_emails, CAST(sum(total_purchases) AS bigint) AS purchases
FROM seen WHERE first_name = 'J***an' OR email LIKE 'm***@%' GROUP BY first_name, last_name"""

SELECT_TOKENIZED = f"WITH {TOKENIZED} SELECT {ALL} FROM tokenized"
SELECT_PROFILE = f"WITH {PROFILE} SELECT {ALL} FROM profile"

ORACLES: dict[str, str] = {
    "flagship": f"""WITH {TOKENIZED}, seen AS (
      SELECT loyalty_status, coalesce(v_first_name.value, t.first_name) AS first_name, total_purchases
      {vault_joins("tokenized")})
    SELECT loyalty_status, first_name, avg(total_purchases) AS avg_total_purchases, count(*) AS n_customers
    FROM seen GROUP BY loyalty_status, first_name""",
    "generate_customers": generated(),
    "customer_profile": SELECT_PROFILE,
    "typed_table": SELECT_PROFILE,
    "typed_insert": SELECT_PROFILE,
    "customer_dataset": f"WITH {TOKENIZED} SELECT customer_id, {', '.join(COLUMNS)}, {', '.join(OTHERS[:8])} FROM tokenized",
    "customer_detail": f"""WITH {PROFILE} SELECT customer_id, first_name, last_name, email, phone_number, date_of_birth,
      preferred_language, total_purchases, total_spent,
      CAST(date_trunc('month', last_login) AS timestamp) AS last_login_month,
      CAST(date_trunc('month', signup_date) AS timestamp) AS signup_date_month,
      consent_data_sharing, consent_marketing FROM profile""",
    "customer_overview": f"SELECT * FROM ({read('MASKED')}) ORDER BY customer_id LIMIT 100",
    "table_sample": f"{SELECT_TOKENIZED} ORDER BY customer_id LIMIT 5",
    "rows_with_pii": f"{SELECT_PROFILE} WHERE {' OR '.join(f'{c} IS NOT NULL' for c in COLUMNS)}",
    "tokenizable_cells": f"""WITH {PROFILE} SELECT customer_id, column_name, value FROM ({long("profile")})
      WHERE value IS NOT NULL AND trim(value) <> ''""",
    "row_count": f"WITH {PROFILE} SELECT count(*) AS n_rows FROM profile",
    "snapshot_row_number": f"WITH {SNAPSHOT} SELECT rn, {ALL} FROM snapshot",
    "batch_plan": batch_plan(),
    "key_page": f"WITH {PROFILE} SELECT customer_id FROM profile ORDER BY customer_id LIMIT {PAGE_SIZE} OFFSET {PAGE_OFFSET}",
    "key_page_deep": f"WITH {PROFILE} SELECT customer_id FROM profile ORDER BY customer_id LIMIT {PAGE_SIZE} OFFSET {DEEP_OFFSET}",
    "row_dicts": f"""WITH {PROFILE} SELECT '{{"customer_id":"' || customer_id || '","loyalty_status":"' || loyalty_status || '","total_purchases":'
      || CAST(total_purchases AS varchar) || '}}' AS row FROM (SELECT * FROM profile ORDER BY customer_id LIMIT 100)""",
    "empty_run": """SELECT count(*) AS n_published, count(*) AS n_rows, count(*) AS n_tokens, count(*) AS n_calls
      FROM customer WHERE c_custkey IS NULL""",
    "tokenize_hmac": SELECT_TOKENIZED,
    "token_staging": f"WITH {SNAPSHOT} SELECT rn, {', '.join(f'{cell(c)} AS {c}_token' for c in COLUMNS)} FROM snapshot",
    "token_merge": SELECT_TOKENIZED,
    "token_merge_join": SELECT_TOKENIZED,
    "mock_tokenize": mock_query("plain"),
    "mock_tokenize_idempotent": mock_query("idempotent"),
    "mock_update_page": mock_query("page"),
    "mock_update_all_pages": paged(),
    "vault_assigned_tokens": SELECT_TOKENIZED,
    "vault_client_read": f"""WITH {PROFILE} SELECT column_name, 'hex_' || lower(hex(encode(value))) AS token, value,
      count(*) AS n_cells FROM ({long("profile")}) WHERE trim(value) <> '' GROUP BY column_name, value""",
    "publish_via_client": SELECT_TOKENIZED,
    "detokenize_via_client": client_read(),
    "client_read_status": client_status(),
    "parse_token_reply": replies(),
    "vault_build": f"WITH {PROFILE} {vault('profile')}",
    "vault_refresh": refresh(),
    "vault_upsert": upserted(),
    "vault_merge_partial": merged_parts(),
    "vault_duplicates": duplicates(),
    "detokenize_plain": read("PLAIN_TEXT"),
    "detokenize_masked": read("MASKED"),
    "detokenize_redacted": read("REDACTED"),
    "detokenize_by_mode": by_mode(),
    "detokenize_unknown": unknown(),
    "detokenize_after_growth": f"WITH {GROWN} SELECT {ALL} FROM grown",
    "detokenize_bucketed": grown_masked(),
    "policy_unknown_hot": grown_masked(LOST_TOKEN),
    "policy_auditor": read("PLAIN_TEXT"),
    "policy_admin": read("PLAIN_TEXT"),
    "policy_customer_service": read("MASKED"),
    "policy_marketing": redacted_view(),
    "policy_other": SELECT_TOKENIZED,
    "policy_removed": f"""SELECT 'before' AS state, true AS view_exists, {ALL} FROM ({read("PLAIN_TEXT")})
      UNION ALL SELECT 'after', false, {ALL} FROM ({SELECT_TOKENIZED})""",
    "policy_filter": FILTERED,
    "mask_alias": f"""WITH {TOKENIZED} SELECT column_name, n_cells, value AS plain, {mask("value")} AS by_role,
      {mask("value")} AS by_alias, '*REDACTED*' AS redacted FROM vault""",
    "session_context": f"""WITH {PROFILE} SELECT 'DEMO_MARKETING' AS role, true AS has_user, count(*) AS n_rows,
      count(*) FILTER (WHERE trim(email) <> '') AS n_hidden FROM profile""",
    "row_count_validation": """SELECT count(*) AS old_rows, count(*) AS new_rows, true AS matches FROM customer""",
    "token_coverage": coverage(),
    "tokenization_summary": summary(),
    "tokenization_status": "SELECT 'Tokenization Complete' AS status, count(*) AS total_records FROM customer",
    "access_matrix": matrix(),
    "access_audit": audited(),
    "access_violations": violations(),
    "tokenization_status_incomplete": f"""WITH {TOKENIZED} SELECT CASE WHEN count(*) FILTER (WHERE column_name = 'email' AND length(value) % 3 = 0) > 0
      THEN 'Tokenization Incomplete' ELSE 'Tokenization Complete' END AS status, (SELECT count(*) FROM customer) AS total_records FROM vault""",
    "row_count_mismatch": f"""WITH {PROFILE} SELECT old_rows, new_rows, old_rows = new_rows AS matches FROM
      (SELECT count(*) AS old_rows, count(*) FILTER (WHERE {" OR ".join(f"{c} IS NOT NULL" for c in COLUMNS)}) AS new_rows FROM profile)""",
    "table_report": f"""WITH {TOKENIZED}
      SELECT 'veil_customer_data' AS table_name, true AS table_exists, count(*) AS n_rows FROM tokenized
      UNION ALL SELECT 'veil_vault', true, count(*) FROM vault
      UNION ALL SELECT 'veil_not_there', false, 0""",
    "avg_purchases_by_loyalty": averages("loyalty_status"),
    "avg_purchases_by_consent_marketing": averages("consent_marketing"),
    "avg_purchases_by_consent_sharing": averages("consent_data_sharing"),
    "scalar_functions": """SELECT o_orderkey, 'ORD' || lpad(CAST(o_orderkey AS varchar), CAST(greatest(10, length(CAST(o_orderkey AS varchar))) AS integer), '0') AS order_ref,
      lower(o_orderpriority) AS priority_lower, upper(o_orderpriority) AS priority_upper,
      trim('  ' || o_orderstatus || ' ') AS status, substr(md5(CAST(o_orderkey AS varchar)), 1, 16) AS digest,
      o_orderkey % 10 AS last_digit, CAST(CAST(o_totalprice AS decimal(18,2)) * 2 AS decimal(18,2)) AS doubled,
      CAST(ceil(o_orderkey / 25.0) AS bigint) AS batch,
      CAST(CAST(o_orderdate AS date) + 30 AS timestamp) AS due,
      CAST(date_trunc('month', o_orderdate) AS timestamp) AS order_month,
      CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'part' END AS state,
      coalesce(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, 'none') AS pending,
      o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_urgent FROM orders""",
    "publish_swap": SELECT_TOKENIZED,
    "stream_tokenize": events(hmac("'user_id'", "user_id")),
    "stream_detokenize": events(mask("user_id")),
}
