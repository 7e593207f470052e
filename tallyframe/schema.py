"""Table schemas and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LEDGER = T.StructType(
    [
        T.StructField("household_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("import_batch_id", T.StringType()),
        T.StructField("source_record_key", T.StringType()),
        T.StructField("source_document_name", T.StringType()),
        T.StructField("occurred_on", T.DateType()),
        T.StructField("posted_on", T.DateType()),
        T.StructField("description_raw", T.StringType()),
        T.StructField("merchant_normalized", T.StringType()),
        T.StructField("amount", MONEY),
        T.StructField("direction", T.StringType()),
        T.StructField("currency", T.StringType()),
        T.StructField("primary_category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("household_role", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("transfer_group_key", T.StringType()),
        T.StructField("statement_period", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

ACCOUNTS = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("household_id", T.StringType()),
        T.StructField("institution", T.StringType()),
        T.StructField("account_name", T.StringType()),
        T.StructField("account_type", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)

OVERRIDES = T.StructType(
    [
        T.StructField("match_key", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("occurred_on", T.DateType()),
        T.StructField("amount", MONEY),
        T.StructField("description_raw", T.StringType()),
        T.StructField("merchant_normalized", T.StringType()),
        T.StructField("primary_category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("household_role", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("note", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

RULES = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("account_filter", T.StringType()),
        T.StructField("direction_filter", T.StringType()),
        T.StructField("primary_category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("merchant_normalized", T.StringType()),
        T.StructField("household_role", T.StringType()),
        T.StructField("lifecycle", T.StringType()),
        T.StructField("confidence", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

PERIODS = T.StructType(
    [
        T.StructField("account_id", T.StringType()),
        T.StructField("period_start", T.DateType()),
        T.StructField("period_end", T.DateType()),
        T.StructField("statement_opening", MONEY),
        T.StructField("statement_closing", MONEY),
        T.StructField("closing_source", T.StringType()),
        T.StructField("computed_inflows", MONEY),
        T.StructField("computed_outflows", MONEY),
        T.StructField("computed_transfers_in", MONEY),
        T.StructField("computed_transfers_out", MONEY),
        T.StructField("computed_closing", MONEY),
        T.StructField("variance", MONEY),
        T.StructField("variance_explanation", T.StringType()),
    ]
)

IMPORT_BATCHES = T.StructType(
    [
        T.StructField("import_batch_id", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("layout", T.StringType()),
        T.StructField("imported_at", T.TimestampType()),
        T.StructField("row_count", T.LongType()),
    ]
)

OVERRIDABLE = ("merchant_normalized", "primary_category", "subcategory", "household_role", "lifecycle")

# The closed vocabularies. Role names other than the neutral ones
# belong to a household and are passed in as a parameter.
PRIMARY_CATEGORIES = (
    "income",
    "fixed_obligation",
    "variable_lifestyle",
    "transfer",
    "tax",
    "rental",
    "medical",
    "investment",
    "abnormal",
    "business_expense",
)
LIFECYCLES = ("recurring", "seasonal", "one_time", "unknown")
HOUSEHOLD_ROLES = ("joint", "rental", "pet", "professional", "tax")
CONFIDENCES = ("high", "medium", "low")
DIRECTIONS = ("inflow", "outflow", "transfer")
