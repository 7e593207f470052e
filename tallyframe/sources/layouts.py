"""Statement layouts: header-named text columns in, ledger rows with a status out.

Every layout yields all rows with ``row_status`` (parsed, skipped, error) and
``row_reason``; filter it into the ledger and the quarantine.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import scalars as S
from tallyframe.operators.common import number_copies


@dataclass(frozen=True)
class Account:
    account_id: str
    institution: str
    account_name: str
    account_type: str
    owner: str = "joint"
    currency: str = "USD"


@dataclass(frozen=True)
class Layout:
    """How one export format is read.

    ``skip`` and ``error`` give a reason or null; ``key`` the parts of the record key;
    ``numbered`` whether equal keys in one file get a suffix.
    """

    name: str
    version: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    account: Account
    skip: Callable[[], Column]
    error: Callable[[], Column]
    occurred_on: Callable[[], Column]
    posted_on: Callable[[], Column]
    description: Callable[[], Column]
    amount: Callable[[], Column]
    direction: Callable[[Column, Column, Sequence[str]], Column]
    key: Callable[[], list[Column]]
    metadata: dict[str, Callable[[], Column]]
    numbered: bool = False
    transfer_patterns: tuple[str, ...] = ()
    account_id: Callable[[], Column] | None = None
    role: str = "joint"
    extra: dict[str, str] = field(default_factory=dict)


def text(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _first_reason(*cases: tuple[Column, str]) -> Column:
    chain = None
    for condition, reason in cases:
        chain = F.when(condition, F.lit(reason)) if chain is None else chain.when(condition, F.lit(reason))
    return chain


def direction_of(amount: Column, description: Column, patterns: Sequence[str]) -> Column:
    """Patterns win, then the sign; zero is an inflow."""
    return F.when(S.any_pattern(description, patterns), "transfer").when(amount < 0, "outflow").otherwise("inflow")


def _iso_or_us(name: str, two_digit: bool = False) -> Column:
    return S.first_date(S.us_date(text(name), two_digit), S.iso_date(text(name)))


def _one_side() -> Column:
    """Signed debit or credit; when both are set, the one that is not zero."""
    debit, credit = S.money(text("debit")), S.money(text("credit"))
    both = debit.isNotNull() & credit.isNotNull()
    return (
        F.when(both & (debit != 0) & (credit == 0), debit)
        .when(both & (credit != 0) & (debit == 0), credit)
        .when(~both, F.coalesce(debit, credit))
    )


def _card_side() -> Column:
    """Charges negative, credits positive."""
    debit, credit = S.money(text("debit")), S.money(text("credit"))
    return F.when(debit.isNotNull(), -F.abs(debit)).otherwise(F.abs(credit))


def _card_direction(amount: Column, description: Column, patterns: Sequence[str]) -> Column:
    charged = S.money(text("debit")).isNotNull()
    return F.when(charged, "outflow").when(S.any_pattern(description, patterns), "transfer").otherwise("inflow")


def _joined_description() -> Column:
    joined = F.concat(text("description"), F.lit(" | "), text("ext"))
    return F.regexp_replace(joined, r"^[ |]+|[ |]+$", "")


def _with_balance() -> list[Column]:
    return [S.collapse("_description"), S.money(text("balance"))]


# Header names, accounts, transfer descriptions and date forms per export.
# Patterns that name a person belong to a household: pass them as ``extra_patterns``.
CARD_A = Layout(
    name="chase-credit-card",
    version="chase-csv-v1",
    required=("transaction_date", "post_date", "description", "amount", "type"),
    optional=("category", "memo"),
    account=Account("acct-chase-credit-card", "Chase", "Chase Credit Card", "credit_card"),
    skip=lambda: _first_reason((text("transaction_date") == "", "pending")),
    error=lambda: _first_reason(
        (F.col("_day").isNull(), "unparseable transaction date"),
        (F.col("_description") == "", "description is empty"),
        (F.col("_amount").isNull(), "amount is empty or unparseable"),
    ),
    occurred_on=lambda: S.us_date(text("transaction_date"), True),
    posted_on=lambda: S.us_date(text("post_date"), True),
    description=lambda: text("description"),
    amount=lambda: S.money(text("amount")),
    direction=lambda amount, _, __: F.when(F.lower(text("type")) == "payment", "transfer")
    .when(amount < 0, "outflow")
    .otherwise("inflow"),
    key=lambda: [S.collapse("_description")],
    metadata={"chase_category": lambda: text("category"), "chase_type": lambda: text("type"), "memo": lambda: text("memo")},
    numbered=True,
)

CHECKING_A = Layout(
    name="beacon-checking",
    version="beacon-csv-v1",
    required=("posted_date", "type", "description", "amount", "account", "balance", "raw_description"),
    optional=("notes",),
    account=Account("acct-beacon", "Beacon", "Beacon checking", "checking"),
    account_id=lambda: F.concat(F.lit("acct-beacon-"), F.lower(text("account"))),
    skip=lambda: _first_reason((text("posted_date") == "", "pending")),
    error=lambda: _first_reason(
        (F.col("_day").isNull(), "unparseable posted date"),
        (F.col("_description") == "", "raw description is empty"),
        (F.col("_amount").isNull(), "amount is empty or unparseable"),
        (text("account") == "", "account is empty"),
        (S.money(text("balance")).isNull(), "balance is empty or unparseable"),
    ),
    occurred_on=lambda: S.iso_date(text("posted_date")),
    posted_on=lambda: S.iso_date(text("posted_date")),
    description=lambda: text("raw_description"),
    amount=lambda: S.money(text("amount")),
    direction=direction_of,
    key=_with_balance,
    metadata={
        "beacon_type": lambda: text("type"),
        "short_description": lambda: text("description"),
        "running_balance": lambda: S.money(text("balance")),
        "notes": lambda: text("notes"),
    },
    transfer_patterns=(
        r"chase\s+credit",
        r"citi\s+autopay\s+payment",
        r"ally\s+bank\s*\$?transfer",
        r"ally\s+bank\s+p2p",
        r"ionbank\s+online\s+xfr",
    ),
)

SAVINGS_A = Layout(
    name="ally-hysa",
    version="ally-csv-v1",
    required=("date", "time", "amount", "type", "description"),
    optional=(),
    account=Account("acct-ally-hysa", "Ally", "Ally HYSA", "savings"),
    skip=lambda: _first_reason((text("date") == "", "missing_date")),
    error=lambda: _first_reason(
        (F.col("_day").isNull(), "unparseable date"),
        (S.clock_time(text("time")).isNull(), "unparseable time"),
        (F.col("_description") == "", "description is empty"),
        (F.col("_amount").isNull(), "amount is empty or unparseable"),
    ),
    occurred_on=lambda: _iso_or_us("date"),
    posted_on=lambda: _iso_or_us("date"),
    description=lambda: text("description"),
    amount=lambda: S.money(text("amount")),
    direction=direction_of,
    key=lambda: [S.collapse("_description")],
    metadata={"ally_type": lambda: text("type"), "occurred_at_time": lambda: S.clock_time(text("time"))},
    transfer_patterns=(
        r"requested\s+transfer\s+from\b",
        r"requested\s+transfer.*ally\s+bank\s+transfer",
        r"requested\s+transfer\s+to\b",
    ),
    extra={"time": "time"},
)

CHECKING_B = Layout(
    name="webster-checking",
    version="webster-csv-v1",
    required=("date", "type", "description", "debit", "credit", "balance"),
    optional=("referenceno", "checknumber"),
    account=Account("acct-webster-checking", "Webster", "Webster checking", "checking"),
    skip=lambda: _first_reason((text("date") == "", "missing_date")),
    error=lambda: _first_reason(
        (F.col("_day").isNull(), "unparseable date"),
        (F.col("_description") == "", "description is empty"),
        (F.col("_amount").isNull(), "debit and credit are both empty or unparseable"),
        (S.money(text("balance")).isNull(), "balance is empty or unparseable"),
    ),
    occurred_on=lambda: _iso_or_us("date"),
    posted_on=lambda: _iso_or_us("date"),
    description=lambda: text("description"),
    amount=_one_side,
    direction=direction_of,
    key=_with_balance,
    metadata={
        "webster_type": lambda: text("type"),
        "reference_no": lambda: text("referenceno"),
        "check_number": lambda: text("checknumber"),
        "running_balance": lambda: S.money(text("balance")),
    },
    transfer_patterns=(r"chase\s+credit\s+crd\s+epay",),
)

CARD_B = Layout(
    name="citi-credit-card",
    version="citi-csv-v1",
    required=("status", "date", "description", "debit", "credit"),
    optional=(),
    account=Account("acct-citi-credit-card", "Citi", "Citi Credit Card", "credit_card"),
    skip=lambda: _first_reason((~F.lower(text("status")).isin("cleared", "posted") | (text("date") == ""), "pending")),
    error=lambda: _first_reason(
        (F.col("_day").isNull(), "unparseable date"),
        (F.col("_description") == "", "description is empty"),
        (S.money(text("debit")).isNull() & S.money(text("credit")).isNull(), "both debit and credit are empty or unparseable"),
        (S.money(text("debit")).isNotNull() & S.money(text("credit")).isNotNull(), "both debit and credit are populated"),
    ),
    occurred_on=lambda: _iso_or_us("date", True),
    posted_on=lambda: _iso_or_us("date", True),
    description=lambda: text("description"),
    amount=_card_side,
    direction=_card_direction,
    key=lambda: [S.collapse("_description")],
    metadata={
        "citi_status": lambda: text("status"),
        "citi_debit_raw": lambda: text("debit"),
        "citi_credit_raw": lambda: text("credit"),
    },
    numbered=True,
    transfer_patterns=(r"\bautopay\b", r"\bauto[-\s]?pmt\b"),
)

SAVINGS_B = Layout(
    name="selfhelp-savings",
    version="selfhelp-csv-v1",
    required=("date", "description", "ext", "amount", "balance"),
    optional=("draft",),
    account=Account("acct-selfhelp-savings", "Self-Help", "Self-Help savings", "savings"),
    skip=lambda: _first_reason((text("date") == "", "missing_date")),
    error=lambda: _first_reason(
        (F.col("_day").isNull(), "unparseable date"),
        (F.col("_description") == "", "row has neither a description nor an ext value"),
        (F.col("_amount").isNull(), "amount is empty or unparseable"),
        (S.money(text("balance")).isNull(), "balance is empty or unparseable"),
    ),
    occurred_on=lambda: _iso_or_us("date"),
    posted_on=lambda: _iso_or_us("date"),
    description=_joined_description,
    amount=lambda: S.money(text("amount")),
    direction=direction_of,
    key=lambda: [S.money(text("balance"))],
    metadata={"ext": lambda: text("ext"), "draft": lambda: text("draft"), "running_balance": lambda: S.money(text("balance"))},
    numbered=True,
    transfer_patterns=(r"ally\s+bank\s+\$?\s*transfer", r"ally\s+bank\s+acctverify"),
)

LAYOUTS: dict[str, Layout] = {
    layout.name: layout for layout in (CARD_A, CHECKING_A, SAVINGS_A, CHECKING_B, CARD_B, SAVINGS_B)
}

# Which tracked source each layout reads.
LAYOUT_OF_SOURCE: dict[str, str] = {
    "doc-001": "chase-credit-card",
    "doc-002": "beacon-checking",
    "doc-003": "ally-hysa",
    "doc-004": "webster-checking",
    "doc-087": "citi-credit-card",
    "doc-088": "selfhelp-savings",
}


def parse(
    raw: DataFrame, layout: Layout | Sequence[Layout], *, extra_patterns: Sequence[str] = (), household: str = "household"
) -> DataFrame:
    """All rows of a statement scan with status, reason and, when parsed, their ledger columns.

    ``raw`` has the layout's header columns as text and ``source_document_name``. With several layouts
    it has the columns of all of them, null where a row's header lacks one, and ``layout`` names each
    row's own: all files are then parsed in one pass.
    """
    several = [layout] if isinstance(layout, Layout) else list(layout)

    def pick(of: Callable[[Layout], Column]) -> Column:
        if isinstance(layout, Layout):
            return of(layout)
        chain = F.when(F.col("layout") == several[0].name, of(several[0]))
        for one in several[1:]:
            chain = chain.when(F.col("layout") == one.name, of(one))
        return chain

    named = list(dict.fromkeys(c for one in several for c in (*one.required, *one.optional)))
    for name in named:
        if name not in raw.columns and (len(several) > 1 or name in layout.optional):
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    used = ["source_document_name", *named]
    if "household_id" in raw.columns:
        used.append("household_id")
    if not isinstance(layout, Layout):
        used.append("layout")
    # Texts are read once; everything after works on the typed columns.
    rows = raw.select(
        *used,
        pick(lambda one: one.occurred_on()).alias("_day"),
        pick(lambda one: one.posted_on()).alias("_posted"),
        pick(lambda one: one.description()).alias("_description"),
        pick(lambda one: one.amount().cast(S.MONEY)).alias("_amount") if len(several) > 1 else layout.amount().alias("_amount"),
        pick(lambda one: one.skip()).alias("_skip"),
    )
    rows = rows.withColumn("_error", F.when(F.col("_skip").isNull(), pick(lambda one: one.error())))
    status = F.when(F.col("_skip").isNotNull(), "skipped").when(F.col("_error").isNotNull(), "error").otherwise("parsed")

    def payload_of(one: Layout) -> Column:
        head = [F.col("_day"), F.col("_amount")]
        if "time" in one.extra:
            head.insert(1, S.clock_time(text("time")))
        return F.concat_ws("|", *[c.cast("string") for c in (*head, *one.key())])

    rows = rows.select("*", status.alias("row_status"), F.coalesce("_skip", "_error").alias("row_reason"), pick(payload_of).alias("_payload"))
    amount, description = F.col("_amount"), F.col("_description")
    numbered = [one for one in several if one.numbered]
    if numbered:
        scope = ["source_document_name", "_payload", "row_status"]
        whole = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in used]), 256)
        if len(several) == 1:
            rows = number_copies(rows, scope, whole)
        else:
            repeats = F.col("layout").isin(*[one.name for one in numbered])
            alone = rows.where(~F.coalesce(repeats, F.lit(False))).withColumn("ordinal", F.lit(0).cast("long"))
            rows = number_copies(rows.where(repeats), [*scope, "layout"], whole).unionByName(alone)
    else:
        rows = rows.withColumn("ordinal", F.lit(0))
    payload = F.when(F.col("ordinal") == 0, F.col("_payload")).otherwise(
        F.concat(F.col("_payload"), F.lit("|seq"), F.col("ordinal").cast("string"))
    )
    # a column, as the sign of the amount asks for it as well
    rows = rows.withColumn("_direction", pick(lambda one: one.direction(amount, description, (*one.transfer_patterns, *extra_patterns))))
    direction = F.col("_direction")
    parsed = F.col("row_status") == "parsed"

    def metadata_of(one: Layout) -> Column:
        pairs = [x for name, value in one.metadata.items() for x in (F.lit(name), value().cast("string"))]
        return F.create_map(*pairs).cast("map<string,string>")

    def when_parsed(value: Column) -> Column:
        return F.when(parsed, value)

    owner = F.col("household_id") if "household_id" in raw.columns else F.lit(household)
    account = pick(lambda one: one.account_id() if one.account_id else F.lit(one.account.account_id))
    return rows.select(
        "row_status",
        "row_reason",
        owner.alias("household_id"),
        when_parsed(account).alias("account_id"),
        when_parsed(F.substring(F.sha2(payload, 256), 1, 16)).alias("source_record_key"),
        "source_document_name",
        when_parsed(F.col("_day")).alias("occurred_on"),
        when_parsed(F.col("_posted")).alias("posted_on"),
        when_parsed(description).alias("description_raw"),
        F.lit(None).cast("string").alias("merchant_normalized"),
        when_parsed(S.signed_amount(amount, direction).cast(S.MONEY)).alias("amount"),
        when_parsed(direction).alias("direction"),
        pick(lambda one: F.lit(one.account.currency)).alias("currency"),
        F.lit("unclassified").alias("primary_category"),
        F.lit(None).cast("string").alias("subcategory"),
        pick(lambda one: F.lit(one.role)).alias("household_role"),
        F.lit("recurring").alias("lifecycle"),
        F.lit(None).cast("string").alias("transfer_group_key"),
        S.statement_period("source_document_name").alias("statement_period"),
        pick(metadata_of).alias("metadata"),
        pick(lambda one: F.lit(one.name)).alias("layout"),
    )


def parsed_rows(rows: DataFrame) -> DataFrame:
    """The ledger part of a parsed scan; the row id is derived from its key, so a retry repeats it."""
    kept = rows.where("row_status = 'parsed'").drop("row_status", "row_reason")
    return kept.withColumn("id", S.digest(32, F.col("household_id"), F.col("account_id"), F.col("source_record_key")))


def quarantined_rows(rows: DataFrame) -> DataFrame:
    return rows.where("row_status <> 'parsed'").select("source_document_name", "layout", "row_status", "row_reason")


def accounts_of(rows: DataFrame) -> DataFrame:
    """Account rows a parsed scan implies."""
    found = rows.where("row_status = 'parsed'").select("account_id", "household_id", "layout").distinct()
    chain = None
    for layout in LAYOUTS.values():
        a = layout.account
        value = F.struct(
            F.lit(a.institution).alias("institution"), F.lit(a.account_name).alias("account_name"),
            F.lit(a.account_type).alias("account_type"), F.lit(a.owner).alias("owner"), F.lit(a.currency).alias("currency"),
        )
        condition = F.col("layout") == layout.name
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return found.withColumn("_a", chain).select("account_id", "household_id", "_a.*")


def file_summary(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Per file: rows to insert, update, skip and in error; a file with errors and no parsed row is an error."""
    known = existing.select("account_id", "source_record_key").distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, ["account_id", "source_record_key"], "left")
    parsed = F.col("row_status") == "parsed"
    out = joined.groupBy("source_document_name", "layout").agg(
        F.count_if(parsed & F.col("_known").isNull()).alias("inserted"),
        F.count_if(parsed & F.col("_known").isNotNull()).alias("updated"),
        F.count_if(F.col("row_status") == "skipped").alias("skipped"),
        F.count_if(F.col("row_status") == "error").alias("errors"),
    )
    failed = (F.col("inserted") + F.col("updated") == 0) & (F.col("errors") > 0)
    return out.withColumn("status", F.when(failed, "error").otherwise("ingested"))


def run_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files_seen"),
        F.count_if(F.col("status") == "ingested").alias("files_ingested"),
        F.count_if(F.col("status") == "no_parser").alias("files_without_parser"),
        F.count_if(F.col("status") == "error").alias("files_with_errors"),
        F.sum("inserted").alias("inserted"),
        F.sum("updated").alias("updated"),
        F.sum("skipped").alias("skipped"),
    )
