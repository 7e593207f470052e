"""Scalar expressions: money, dates, text, keys, months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Two-letter codes dropped from the end of a merchant text.
US_STATES = (
    "al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms "
    "mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv "
    "wi wy dc"
).split()

# Words that carry no routing information.
STOP_WORDS = (
    "all", "and", "annual", "export", "history", "if", "in", "of", "or", "pdf",
    "screenshot", "the", "ytd", "2026", "2027",
)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- money -----------------------------------------------------------------


def money(text: Column | str) -> Column:
    """Money text to ``decimal(18,2)``: ``$`` and ``,`` removed, blanks trimmed, unreadable is null."""
    return F.trim(F.translate(_c(text), "$,", "")).try_cast(MONEY)


def cents(amount: Column | str) -> Column:
    """Whole cents, half up."""
    return F.round(_c(amount) * 100).cast("bigint")


def dollars(amount: Column | str) -> Column:
    return _c(amount).cast("double")


def signed_amount(amount: Column | str, direction: Column | str) -> Column:
    """Outflows negative, inflows positive, transfers as given."""
    a, d = _c(amount), _c(direction)
    return F.when(d == "outflow", -F.abs(a)).when(d == "inflow", F.abs(a)).otherwise(a)


def posted_effect(amount: Column | str = "amount", direction: Column | str = "direction") -> Column:
    """What a row does to its own account's cash balance."""
    a, d = _c(amount), _c(direction)
    return (
        F.when(d == "inflow", F.abs(a))
        .when(d == "outflow", -F.abs(a))
        .when(d == "transfer", a)
        .otherwise(F.lit(0).cast(MONEY))
    )


def variance_badge(variance: Column | str) -> Column:
    v = F.abs(_c(variance))
    return F.when(v.isNull(), "unknown").when(v < 1, "green").when(v <= 10, "yellow").otherwise("red")


# --- dates -----------------------------------------------------------------


def us_date(text: Column | str, two_digit_year: bool = False) -> Column:
    """``M/D/YYYY`` (and ``M/D/YY`` when asked, pivoting at 69) without a format-parser policy."""
    t = _c(text)
    full = r"^\d{1,2}/\d{1,2}/\d{4}$"
    short = r"^\d{1,2}/\d{1,2}/\d{2}$"
    # the shape is tested once, its parts are cut at the slashes
    month = F.lpad(F.substring_index(t, "/", 1), 2, "0")
    day = F.lpad(F.substring_index(F.substring_index(t, "/", 2), "/", -1), 2, "0")
    last = F.substring_index(t, "/", -1)

    def build(year: Column) -> Column:
        return F.concat_ws("-", year, month, day).try_cast("date")

    parsed = F.when(t.rlike(full), build(F.substring(last, 1, 4)))
    if two_digit_year:
        yy = F.substring(last, 1, 2)
        century = F.when(yy >= "69", F.lit("19")).otherwise(F.lit("20"))
        parsed = parsed.when(t.rlike(short), build(F.concat(century, yy)))
    return parsed


def iso_date(text: Column | str) -> Column:
    """A bare ISO date, or the local date of an ISO timestamp with any offset."""
    t = _c(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.substring(t, 1, 10).try_cast("date"))


def first_date(*candidates: Column) -> Column:
    """The first reading that fits."""
    return F.coalesce(*candidates)


def clock_time(text: Column | str) -> Column:
    """``H:M:S`` or ``H:M`` as ``HH:mm:ss``; anything out of range is null."""
    t = _c(text)
    pattern = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
    h, m, s = (F.lpad(F.regexp_extract(t, pattern, i), 2, "0") for i in (1, 2, 3))
    ok = t.rlike(pattern) & (h <= "23") & (m <= "59") & (s <= "61")
    return F.when(ok, F.concat_ws(":", h, m, s))


def month_label(day: Column | str) -> Column:
    return F.date_format(_c(day), "yyyy-MM")


def month_start(day: Column | str) -> Column:
    return F.trunc(_c(day), "month")


def next_month_start(day: Column | str) -> Column:
    return F.add_months(F.trunc(_c(day), "month"), 1)


def month_index(day: Column | str) -> Column:
    return F.year(_c(day)) * 12 + F.month(_c(day)) - 1


def statement_period(file_name: Column | str) -> Column:
    """``20YY[-_]M{1,2}`` in a file stem, months 1-12, else null."""
    stem = F.regexp_replace(_c(file_name), r"\.[^.]*$", "")
    found = F.regexp_extract(stem, r"20\d{2}[-_]\d{1,2}", 0)
    label = F.translate(F.regexp_replace(found, r"[-_](?=\d$)", "-0"), "_", "-")
    # each step is named once, so the name is searched once
    return F.nullif(F.regexp_extract(label, r"^\d{4}-(?:0[1-9]|1[0-2])$", 0), F.lit(""))


# --- text ------------------------------------------------------------------


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def collapse_lower(text: Column | str) -> Column:
    return F.lower(collapse(text))


def any_pattern(text: Column | str, patterns: Sequence[str]) -> Column:
    """Case-insensitive search for any of the patterns."""
    if not patterns:
        return F.lit(False)
    return _c(text).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def vendor(merchant: Column | str = "merchant_normalized", description: Column | str = "description_raw") -> Column:
    return F.coalesce(F.nullif(_c(merchant), F.lit("")), _c(description))


def normalize_merchant(description: Column | str) -> Column:
    """Stable merchant key: folded case, trailing state code and reference ids removed."""
    folded = collapse_lower(description)
    no_state = F.regexp_replace(folded, f" (?:{'|'.join(US_STATES)})$", "")
    no_ids = F.regexp_replace(no_state, r"(?:\s*(?:#|ref#?|trace#?)?\s*\d{4,}\s*)+$", "")
    bare = F.trim(F.regexp_replace(F.trim(no_ids), r"[ #\-*.]+$", ""))
    return F.when(bare == "", folded).otherwise(bare)


def merchant_key(merchant: Column | str = "merchant_normalized", description: Column | str = "description_raw") -> Column:
    named = F.nullif(F.trim(_c(merchant)), F.lit(""))
    return F.coalesce(F.lower(named), normalize_merchant(description))


def title_case(text: Column) -> Column:
    """The first letter of every run of letters upper, the others lower: ``o'neil 7-eleven`` is ``O'Neil 7-Eleven``."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def merchant_name(merchant: Column | str = "merchant_normalized", description: Column | str = "description_raw") -> Column:
    named = F.nullif(F.trim(_c(merchant)), F.lit(""))
    return F.coalesce(named, title_case(normalize_merchant(description)))


def account_label(institution: Column | str = "institution", name: Column | str = "account_name") -> Column:
    return F.concat_ws(" · ", _c(institution), _c(name))


def tokens(text: Column | str) -> Column:
    """Distinct lower-case words and numbers of three or more characters, stop words removed."""
    spaced = F.regexp_replace(_c(text), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    parts = F.regexp_extract_all(F.lower(spaced), F.lit(r"([a-z]+|[0-9]+)"), F.lit(1))
    keep = F.filter(parts, lambda p: (F.length(p) > 2) & ~p.isin(*STOP_WORDS))
    return F.array_distinct(keep)


def bigrams(text: Column | str) -> Column:
    """Distinct character bigrams; empty below two characters."""
    t = _c(text)
    size = F.length(t)
    positions = F.when(size >= 2, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(positions, lambda i: F.substring(t, i, F.lit(2))))


def squash(text: Column | str) -> Column:
    """Lower-case letters and digits only: how an institution alias is compared."""
    return F.regexp_replace(F.lower(F.trim(_c(text))), r"[^a-z0-9]", "")


def escape_regex(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), r"([.*+?^${}()|\[\]\\])", r"\\$1")


# --- keys ------------------------------------------------------------------


def digest(size: int, *parts: Column) -> Column:
    """The first ``size`` hex characters of SHA-256 over the parts joined with ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, size)


def record_key(*parts: Column) -> Column:
    return digest(16, *parts)


def override_key(
    account: Column | str = "account_id",
    day: Column | str = "occurred_on",
    amount: Column | str = "amount",
    description: Column | str = "description_raw",
) -> Column:
    return digest(24, _c(account), _c(day), _c(amount).cast(MONEY), collapse_lower(description))


# --- metadata --------------------------------------------------------------


def no_metadata() -> Column:
    return F.create_map().cast("map<string,string>")


def parse_metadata(text: Column | str) -> Column:
    """JSON text to a map; unreadable text is an empty map."""
    return F.coalesce(F.from_json(_c(text), "map<string,string>"), no_metadata())


def metadata_field(metadata: Column | str, name: str) -> Column:
    return F.try_element_at(_c(metadata), F.lit(name))


def merge_metadata(metadata: Column | str, extra: dict[str, Column]) -> Column:
    """The map with ``extra`` entries replacing equal keys; null values are left out."""
    base = F.coalesce(_c(metadata), no_metadata())
    pairs = F.create_map(*[x for k, v in extra.items() for x in (F.lit(k), v.cast("string"))])
    added = F.map_filter(pairs, lambda _, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(added, k))
    return F.map_concat(kept, added)


def is_flagged(metadata: Column | str = "metadata") -> Column:
    return F.coalesce(metadata_field(metadata, "manual_override_applied").isin("true", "1"), F.lit(False))
