"""PII tokenization and governed analytics on Spark DataFrames."""

from veilspark.spec import MASKED, PLAIN_TEXT, REDACTED, PiiSpec, Policy

__all__ = ["MASKED", "PLAIN_TEXT", "REDACTED", "PiiSpec", "Policy"]
