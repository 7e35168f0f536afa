"""The 17-column customer table: a generator, and the same shape derived from sales tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.spec import PiiSpec

CUSTOMER_PII = PiiSpec(
    columns=("first_name", "last_name", "email", "phone_number", "address", "date_of_birth"),
    key=("customer_id",),
)

CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType(), False),
        T.StructField("first_name", T.StringType()),
        T.StructField("last_name", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("phone_number", T.StringType()),
        T.StructField("address", T.StringType()),
        T.StructField("date_of_birth", T.StringType()),
        T.StructField("signup_date", T.TimestampNTZType()),
        T.StructField("last_login", T.TimestampNTZType()),
        T.StructField("total_purchases", T.LongType()),
        T.StructField("total_spent", T.DecimalType(18, 2)),
        T.StructField("loyalty_status", T.StringType()),
        T.StructField("preferred_language", T.StringType()),
        T.StructField("consent_marketing", T.BooleanType()),
        T.StructField("consent_data_sharing", T.BooleanType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
    ]
)

# Fixed values of the sample data.
FIRST_NAMES = ("Jonathan", "Jessica", "Michael", "Stephanie")
LAST_NAMES = ("Anderson", "Williams", "Johnson", "Rodgers")
ADDRESSES = (
    "London, England, SW1A 1AA",
    "Paris, France, 75001",
    "Berlin, Germany, 10115",
    "Tokyo, Japan, 100-0001",
    "Sydney, Australia, 2000",
    "Toronto, Canada, M5H 2N2",
    "Singapore, 238859",
    "Dubai, UAE, 12345",
    "São Paulo, Brazil, 01310-000",
    "Mumbai, India, 400001",
)
BIRTH_DATES = (
    "1985-03-15",
    "1990-07-22",
    "1988-11-08",
    "1992-01-30",
    "1987-09-14",
    "1991-05-03",
    "1989-12-18",
    "1993-04-25",
    "1986-08-11",
    "1994-06-07",
)
LOYALTY = ("Silver", "Gold", "Platinum", "Diamond")
LANGUAGES = ("English", "Spanish")
DEFAULT_AS_OF = "2024-01-01 00:00:00"


#: Days that generated dates run over, so that they stay within year 7500 for any number of rows.
DAYS = 2_000_000


def _pick(values: tuple[str, ...], index: Column) -> Column:
    """`values[index % len(values)]`."""
    return F.get(F.array(*[F.lit(v) for v in values]), index % len(values))


def generate_customers(
    spark: SparkSession, n: int = 50, as_of: str = DEFAULT_AS_OF, partitions: int | None = None
) -> DataFrame:
    """`n` sample customers, every column computed from the row's number.

    The id is as wide as the largest number needs (five digits at least), so ids stay unique for
    any `n`; money is decimal(18,2) for the same reason. Days start over after `DAYS` rows.
    """
    width = max(5, len(str(n)))
    number, k = F.col("id"), F.col("id") - 1
    first, last = _pick(FIRST_NAMES, k), _pick(LAST_NAMES, k)
    stamp = F.lit(as_of).cast("timestamp_ntz")

    def day(start: str) -> Column:
        return F.date_add(F.lit(start).cast("date"), (k % DAYS).cast("int")).cast("timestamp_ntz")

    rows = spark.range(1, n + 1, 1, partitions) if partitions else spark.range(1, n + 1)
    return rows.select(
        F.concat(F.lit("CUST"), F.lpad(number.cast("string"), width, "0")).alias("customer_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), F.lower(last), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("+1-555-010"), (k % 10).cast("string")).alias("phone_number"),
        _pick(ADDRESSES, k).alias("address"),
        _pick(BIRTH_DATES, k).alias("date_of_birth"),
        day("2018-01-01").alias("signup_date"),
        day("2023-01-01").alias("last_login"),
        (number * 5).alias("total_purchases"),
        (number.cast("decimal(16,0)") * F.lit("50.00").cast("decimal(4,2)")).cast("decimal(18,2)").alias("total_spent"),
        _pick(LOYALTY, k).alias("loyalty_status"),
        _pick(LANGUAGES, k).alias("preferred_language"),
        (k % 2 == 0).alias("consent_marketing"),
        (k % 3 == 0).alias("consent_data_sharing"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def customer_profile(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One customer row per `c_custkey`, with order totals and the blank cells real data has.

    Orders are reduced per customer before the join (partial sums run map-side, so a customer with
    a large share of all orders is one row per task by then); both join sides hold a key once.
    """
    spend = orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("spent"),
        F.min("o_orderdate").alias("first_ts"),
        F.max("o_orderdate").alias("last_ts"),
    )
    base = customer.select(F.col("c_custkey").alias("id")).join(spend, "id", "left")
    number = F.col("id")
    first, last = _pick(FIRST_NAMES, number), _pick(LAST_NAMES, number)

    def unless(blank: Column, value: Column) -> Column:
        return F.when(~blank, value)

    def pad(value: Column, width: int) -> Column:
        digits = value.cast("string")
        return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0")  # never cut

    empty = number % 23 == 0
    email = F.concat(
        F.lower(first), F.lit("."), F.lower(last), number.cast("string"), F.lit("@example.com")
    )
    address = (
        F.when(number % 19 == 0, F.lit(""))
        .when(number % 29 == 0, F.lit("  "))
        .otherwise(_pick(ADDRESSES, number))
    )
    born = F.concat_ws(
        "-", (1985 + number % 10).cast("string"), pad(1 + number % 12, 2), pad(1 + number % 28, 2)
    )
    return base.select(
        F.concat(F.lit("CUST"), pad(number, 8)).alias("customer_id"),
        unless(empty, first).alias("first_name"),
        unless(empty, last).alias("last_name"),
        unless(empty, email).alias("email"),
        unless(empty | (number % 17 == 0), F.concat(F.lit("+1-555-"), pad(number % 10000, 4))).alias(
            "phone_number"
        ),
        unless(empty, address).alias("address"),
        unless(empty, born).alias("date_of_birth"),
        F.col("first_ts").alias("signup_date"),
        F.col("last_ts").alias("last_login"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("total_purchases"),
        F.coalesce("spent", F.lit(0)).cast("decimal(18,2)").alias("total_spent"),
        _pick(LOYALTY, number).alias("loyalty_status"),
        _pick(LANGUAGES, number).alias("preferred_language"),
        (number % 2 == 0).alias("consent_marketing"),
        (number % 3 == 0).alias("consent_data_sharing"),
        F.col("first_ts").alias("created_at"),
        F.col("last_ts").alias("updated_at"),
    )


def typed(df: DataFrame, schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """`df` cast to a declared schema, in its column order; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def insert_typed(df: DataFrame, table: str, schema: T.StructType = CUSTOMER_SCHEMA) -> None:
    """Create `table` with the declared schema if it is absent, then append `df`."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        spark.createDataFrame([], schema).write.format("parquet").saveAsTable(table)
    typed(df, schema).write.insertInto(table)
