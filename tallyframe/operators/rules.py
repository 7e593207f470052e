"""Rule classification by prioritised regular expressions.

A short rule table is one column expression; a table of any length is a join (``rule_index``). Both
give the same rows, so every function here takes either: a sequence of rules or a DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions import scalars as S
from tallyframe.operators import overrides as O
from tallyframe.operators import rule_index
from tallyframe.schema import OVERRIDABLE, RULES

# Up to here a rule table becomes an expression; a longer one is joined.
EXPRESSION_RULES = 2_000
RULES_PER_BLOCK = 200

# The default rules. Roles name no person; a household edits them.
SEED_RULES = (
    ("rule-transfer-catchall", ".+", None, "transfer", "transfer", None, None, None, None, "high", 900),
    ("rule-interest-paid", "(?i)interest paid", None, None, "income", "interest", None, None, "recurring", "high", 10),
    ("rule-payroll", r"(?i)\bpayroll\b", None, None, "income", "payroll", "Payroll", None, "recurring", "high", 10),
    ("rule-mobile-check-dep", "(?i)mobile check dep", None, "inflow", "income", "check_deposit", "Mobile Check Deposit", None, "one_time", "high", 10),
    ("rule-fidelity-moneyline", "(?i)fid bkg svc llc moneyline", None, None, "income", "rsu_proceeds", "Fidelity MoneyLine", None, "one_time", "high", 15),
    ("rule-amazon", r"(?i)\bamazon\b|\bamzn\b", None, None, "variable_lifestyle", "amazon", "Amazon", None, "recurring", "high", 20),
    ("rule-whole-foods", "(?i)whole foods|wholefds", None, None, "variable_lifestyle", "groceries", "Whole Foods", None, "recurring", "high", 20),
    ("rule-selfhelp-ally-sweep", r"(?i)ally bank \$?\s*transfer", "acct-selfhelp-savings", "transfer", "transfer", None, "Ally Sweep", None, "recurring", "high", 5),
    ("rule-selfhelp-acctverify", "(?i)ally bank acctverify", "acct-selfhelp-savings", "transfer", "transfer", None, "Ally Account Verification", None, "one_time", "high", 15),
    ("rule-selfhelp-dividend", r"(?i)(?:^|\|\s*)dividend\s*$", "acct-selfhelp-savings", "inflow", "income", "interest", "Self-Help Dividend", None, "recurring", "high", 18),
    ("rule-selfhelp-rent", r"(?i)(?:^|\|\s*)share deposit(?: transfer)?\s*$", "acct-selfhelp-savings", "inflow", "rental", "rental_income", "Rent", "rental", "recurring", "high", 20),
)

# Rules saved by hand stay in this band; 5 is kept for transfers.
MANUAL_BAND = (6, 9)
MANUAL_DEFAULT = 8
STRUCTURAL_PRIORITY = 5


def seed_rules(spark: SparkSession) -> DataFrame:
    import datetime

    stamp = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(*r, stamp) for r in SEED_RULES], RULES)


def in_order(rules: DataFrame) -> DataFrame:
    """Rules in evaluation order."""
    return rules.orderBy("priority", "created_at", "id")


Rules = Sequence[Row] | DataFrame


def load_rules(rules: DataFrame, limit: int = EXPRESSION_RULES) -> Rules:
    """The rule table in evaluation order on the driver where it is short, else the table itself, to be joined."""
    rows = in_order(rules).limit(limit + 1).collect()
    return rules if len(rows) > limit else rows


def _match(rule: Row) -> Column:
    condition = F.col("description_raw").rlike("(?i)" + rule["pattern"])
    if rule["direction_filter"]:
        condition = (F.col("direction") == rule["direction_filter"]) & condition
    if rule["account_filter"]:
        condition = (F.col("account_id") == rule["account_filter"]) & condition
    return condition


def _outputs(rule: Row) -> Column:
    fields = [F.lit(rule[f]).cast("string").alias(f) for f in OVERRIDABLE]
    return F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule["confidence"]).alias("confidence"), *fields)


def first_match(rules: Sequence[Row]) -> Column:
    """Struct of the first rule that matches and sets something; null when none does."""
    useful = [r for r in rules if any(r[f] is not None for f in OVERRIDABLE)]
    blocks = []
    for at in range(0, len(useful), RULES_PER_BLOCK):
        chain = None
        for rule in useful[at : at + RULES_PER_BLOCK]:
            chain = F.when(_match(rule), _outputs(rule)) if chain is None else chain.when(_match(rule), _outputs(rule))
        blocks.append(chain)
    if not blocks:
        kind = "struct<rule_id:string,confidence:string," + ",".join(f"{f}:string" for f in OVERRIDABLE) + ">"
        return F.lit(None).cast(kind)
    return F.coalesce(*blocks)


def match_rules(ledger: DataFrame, rules: Rules, eligible: Column | None = None, name: str = "match") -> DataFrame:
    """Every row with the rule that would classify it, null where none does or the row is not eligible."""
    asked = F.lit(True) if eligible is None else eligible
    if isinstance(rules, DataFrame):
        return rule_index.with_matches(ledger, rules, asked, name)
    return ledger.withColumn(name, F.when(asked, first_match(rules)))


def classify(
    ledger: DataFrame,
    rules: Rules,
    overrides: DataFrame,
    *,
    reclassify_all: bool = False,
    account: str | None = None,
) -> DataFrame:
    """Rule outputs written onto unclassified rows (or all but overridden ones), then overrides re-applied.

    A null output leaves its field; an empty string overwrites it.
    """
    base = O.stamp_flags(ledger, overrides) if reclassify_all else ledger
    eligible = ~S.is_flagged() if reclassify_all else F.col("primary_category") == "unclassified"
    if account:
        eligible = eligible & (F.col("account_id") == account)
    marked = match_rules(base, rules, eligible, "_m")
    changed = {f: F.coalesce(F.col(f"_m.{f}"), F.col(f)) for f in OVERRIDABLE}
    provenance = S.merge_metadata(
        "metadata", {"classifier_rule_id": F.col("_m.rule_id"), "classifier_confidence": F.col("_m.confidence")}
    )
    changed["metadata"] = F.when(F.col("_m").isNotNull(), provenance).otherwise(F.col("metadata"))
    return O.apply_overrides(marked.withColumns(changed).select(*ledger.columns), overrides)


def classify_counts(
    ledger: DataFrame,
    rules: Rules,
    overrides: DataFrame,
    *,
    reclassify_all: bool = False,
    dry_run: bool = False,
    account: str | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """Rows scanned, matched and left over. ``scanned`` counts protected rows too.

    A dry run writes nothing, so it protects only rows already flagged.
    """
    base = O.stamp_flags(ledger, overrides) if reclassify_all and not dry_run else ledger
    scanned = F.lit(True) if reclassify_all else F.col("primary_category") == "unclassified"
    if account:
        scanned = scanned & (F.col("account_id") == account)
    eligible = scanned & ~S.is_flagged() if reclassify_all else scanned
    hit = F.col("_m").isNotNull()
    return match_rules(base.where(scanned), rules, eligible, "_m").groupBy(*scope).agg(
        F.count("*").alias("scanned"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unclassified")
    )


def upsert_rules(rules: DataFrame, changes: DataFrame, *, manual: bool = False) -> DataFrame:
    """Rules with ``changes`` (ordered by ``seq``) merged in by id; ``created_at`` is kept.

    A change without any output is refused. Manual changes are moved into their band.
    """
    has_output = F.coalesce(*[F.col(f) for f in OVERRIDABLE]).isNotNull()
    accepted = changes.where(has_output & (F.col("pattern") != ""))
    if manual:
        low, high = MANUAL_BAND
        clamped = F.least(F.greatest(F.coalesce("priority", F.lit(MANUAL_DEFAULT)), F.lit(low)), F.lit(high))
        accepted = accepted.withColumn("priority", clamped.cast("int"))
    newest = Window.partitionBy("id").orderBy(F.col("seq").desc())
    accepted = accepted.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(*rules.columns)
    born = rules.select("id", F.col("created_at").alias("_born"))
    merged = accepted.join(born, "id", "left").withColumn("created_at", F.coalesce("_born", "created_at")).select(*rules.columns)
    return rules.join(accepted.select("id"), "id", "left_anti").unionByName(merged)


def preview(ledger: DataFrame, candidates: Sequence[tuple[str, str]], samples: int = 5) -> DataFrame:
    """Match count and first samples for each candidate ``(name, pattern)``.

    Only matches are exploded; the sample window keeps a few rows per task before it shuffles.
    """
    hits = F.array_compact(
        F.array(*[F.when(F.col("description_raw").rlike("(?i)" + p), F.lit(n)) for n, p in candidates if p.strip()])
    )
    matched = ledger.select("id", "description_raw", F.explode(hits).alias("candidate"))
    counts = matched.groupBy("candidate").agg(F.count("*").alias("match_count"))
    newest = Window.partitionBy("candidate").orderBy("id")
    few = matched.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= samples)
    return few.join(counts, "candidate").select("candidate", "match_count", "position", "id", "description_raw")


def suggested_pattern() -> Column:
    """A narrow default pattern: the longest lettered merchant word, else the first words of the description."""
    merchant = F.trim(F.coalesce("merchant_normalized", F.lit("")))
    words = F.filter(F.split(merchant, r"\s+"), lambda w: w.rlike("[a-zA-Z]"))
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"), w.alias("w"))))["w"]
    raw = F.trim("description_raw")
    no_tail = F.regexp_replace(raw, r"[#*].*$", "")
    stem = F.trim(F.regexp_replace(no_tail, r"\s+\d[\d/\-:.]*\s*$", ""))
    base = F.when(stem == "", raw).otherwise(stem)
    head = F.array_join(F.slice(F.split(base, r"\s+"), 1, 3), " ")
    text = F.when(merchant != "", F.coalesce(longest, merchant)).otherwise(head)
    return S.escape_regex(text)


def suggest(ledger: DataFrame, scope: Sequence[str] = ("household_id",)) -> DataFrame:
    """Suggested patterns over the unclassified backlog, most rows then largest amount first."""
    grouped = (
        ledger.where(P.is_unclassified_backlog())
        .groupBy(*scope, suggested_pattern().alias("pattern"))
        .agg(F.count("*").alias("row_count"), F.sum(F.abs("amount")).alias("total"))
    )
    return grouped.orderBy(*scope, F.col("row_count").desc(), F.col("total").desc(), "pattern")
