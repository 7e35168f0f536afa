"""The customer-insight queries, over any table with the customer columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERVIEW_ROWS = 100

DATASET_FIELDS = (
    "customer_id",
    "first_name",
    "last_name",
    "email",
    "phone_number",
    "address",
    "date_of_birth",
    "signup_date",
    "last_login",
    "total_purchases",
    "total_spent",
    "loyalty_status",
    "preferred_language",
    "consent_marketing",
    "consent_data_sharing",
)


def customer_dataset(df: DataFrame) -> DataFrame:
    return df.select(*DATASET_FIELDS)


def month(column: str) -> Column:
    """First instant of the month, still a timestamp without time zone."""
    return F.date_trunc("MONTH", F.col(column)).cast("timestamp_ntz")


def customer_detail(df: DataFrame) -> DataFrame:
    return df.select(
        "customer_id",
        "first_name",
        "last_name",
        "email",
        "phone_number",
        "date_of_birth",
        "preferred_language",
        "total_purchases",
        "total_spent",
        month("last_login").alias("last_login_month"),
        month("signup_date").alias("signup_date_month"),
        "consent_data_sharing",
        "consent_marketing",
    )


def customer_overview(df: DataFrame, key: str = "customer_id") -> DataFrame:
    return df.orderBy(key).limit(OVERVIEW_ROWS)


def avg_purchases(df: DataFrame, by: str) -> DataFrame:
    """Average purchases per group, largest first. Few groups: partial averages run map-side."""
    averages = df.groupBy(by).agg(F.avg("total_purchases").alias("avg_total_purchases"))
    return averages.orderBy(F.desc("avg_total_purchases"), by)
