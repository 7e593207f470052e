"""Rules of any number against rows of any number, by a text that every match must contain.

A regular expression is tested only where it can match. From each pattern comes a *required text*: the
longest run of signs that stands in every match (one per branch of an outer alternation). Rules are
filed under the rarest three signs of that text, rows are looked up under all their three signs, and
the two meet by equi-join. Of the candidates, required text and pattern are tested, in this order, and
the first rule in evaluation order wins.

A pattern without a required text of three signs (``.+``, ``[0-9]{4}``) can match anywhere, so its rule
is filed under each of ``SALTS`` keys and every row is looked up under one of them.

Rows are folded to their different descriptions, rules to their different patterns, and only these meet;
filters on account and direction are equalities and are joined after. So many rules of one pattern
cost a row what one of them does. No rule is left out, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.schema import OVERRIDABLE

GRAM = 3
SALTS = 64
# The index goes to all tasks where so few patterns and directions are in it; texts then stay where they are.
BROADCAST_RULES = 5_000
ASKED = ("description_raw", "account_id", "direction")

_GAP = "\x01"
# What the reading below would not see through: gaps in the pattern itself, quoting, character codes,
# back-references by name, flags that widen case or spacing, classes inside classes.
_OPAQUE = r"[\x00-\x02]|\\[QExuck0N]|\(\?[a-zA-Z-]*[xuU]|&&|\[[^\]]*\[|\[\^?\]"
_NESTING = 8


def folded(text: Column) -> Column:
    """A-Z to a-z and nothing else, which is what case-insensitive patterns fold."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _branches(pattern: Column) -> Column:
    """Branches of the outer alternation, with a gap for all that is not a sign that must stand there."""
    # escaped classes, anchors and references are gaps; other escaped signs are put aside as themselves
    text = F.regexp_replace(pattern, r"\\[a-zA-Z1-9]", _GAP)
    # an escaped sign that means something unescaped counts as a gap: shorter, never wrong
    text = F.regexp_replace(text, r"\\[^a-zA-Z0-9 '\"#&/,:;_@%!~<>=-]", _GAP)
    text = F.regexp_replace(text, r"\\(.)", "$1")
    text = F.regexp_replace(text, r"\[[^\]]*\]", _GAP)
    for _ in range(_NESTING):
        text = F.regexp_replace(text, r"\([^()]*\)", _GAP)
    # what may be absent or repeated ends a run: a sign before + stands once at least
    text = F.regexp_replace(text, r"[^+*?}](?:[*?]|\{[^}]*\})[+?]?", _GAP)
    text = F.regexp_replace(text, r"\+[+?]?|[.^$]", _GAP)
    return F.split(text, r"\|")


def _longest(branch: Column) -> Column:
    runs = F.transform(F.split(branch, _GAP), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))
    return folded(F.array_max(runs)["r"])


def required_texts(pattern: Column) -> Column:
    """Texts of which every match holds one, folded; an empty array when there is none to be told."""
    texts = F.transform(_branches(pattern), _longest)
    bad = pattern.rlike(_OPAQUE) | F.exists(texts, lambda t: (F.length(t) < GRAM) | t.rlike(r"[()\[\]{}*+?\\]"))
    return F.when(~bad, F.array_distinct(texts)).otherwise(F.array().cast("array<string>"))


def grams(text: Column) -> Column:
    """Different runs of three signs of a folded text."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - (GRAM - 1), F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def _salt(number: Column) -> Column:
    """A key that is no run of signs."""
    return F.concat(F.lit(_GAP), number.cast("string"))


def _place() -> Column:
    """What a rule sets, behind its place in the order of evaluation."""
    fields = [F.col(f).cast("string").alias(f) for f in OVERRIDABLE]
    out = F.struct(F.col("id").alias("rule_id"), "confidence", *fields)
    return F.struct("priority", "created_at", "id", out.alias("out"))


def one_per_filter(rules: DataFrame) -> DataFrame:
    """``pattern, account, direction, place``: of rules with equal pattern and filters that set something only the first can win."""
    useful = rules.where(F.coalesce(*[F.col(f) for f in OVERRIDABLE]).isNotNull()).where(F.col("pattern").isNotNull())
    filters = [F.coalesce(f"{name}_filter", F.lit("")).alias(name) for name in ("account", "direction")]
    return useful.groupBy("pattern", *filters).agg(F.min(_place()).alias("place"))


def filed(rules: DataFrame, common: DataFrame) -> DataFrame:
    """``key, required, pattern, general, named`` of every different pattern of ``one_per_filter``; ``common`` counts rows per ``key``.

    A required text is filed under that of its runs which the fewest rows hold. ``general`` are the
    pattern's rules for all accounts, ``named`` tells whether it has rules for single ones.
    """
    general = F.collect_list(F.when(F.col("account") == "", F.struct("direction", "place"))).alias("general")
    read = rules.groupBy("pattern").agg(general, F.max(F.col("account") != "").alias("named")).withColumn("texts", required_texts(F.col("pattern")))
    held = ("pattern", "general", "named")
    anywhere = read.where(F.size("texts") == 0).select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), _salt)).alias("key"), F.lit("").alias("required"), *held
    )
    somewhere = read.select(*held, F.explode("texts").alias("required"))
    runs = somewhere.select("pattern", "required", F.explode(grams(F.col("required"))).alias("key")).join(common, "key", "left")
    rarest = F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), F.col("key").alias("key")))
    chosen = runs.groupBy("pattern", "required").agg(rarest.alias("r")).select(F.col("r.key").alias("key"), "required", "pattern")
    return chosen.join(read.select(*held), "pattern").select("key", "required", *held).unionByName(anywhere)


def first_matches(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``description_raw, account_id, direction, match``: the first rule for each of those that has one.

    Each different pattern meets each different description; accounts and directions meet filters by equality.
    """
    asked = rows.select(*ASKED).where(F.col("description_raw").isNotNull()).distinct()
    texts = asked.select("description_raw").distinct().withColumn("_low", folded(F.col("description_raw")))
    looked_up = F.concat(grams(F.col("_low")), F.array(_salt(F.pmod(F.xxhash64("description_raw"), F.lit(SALTS)))))
    entries = texts.select("description_raw", "_low", F.explode(looked_up).alias("key"))
    common = entries.groupBy("key").agg(F.count("*").alias("rows"))

    firsts = one_per_filter(rules)
    index = filed(firsts, common)
    per_pattern = firsts.select("pattern", F.when(F.col("account") == "", F.col("direction")).alias("direction")).distinct()
    if per_pattern.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hit = F.contains(F.col("_low"), F.col("required")) & F.rlike(F.col("description_raw"), F.concat(F.lit("(?i)"), F.col("pattern")))
    met = entries.join(index, "key").where(hit)

    whom = [F.col(c).alias(f"_{c}") for c in ASKED]
    rule = F.explode("general").alias("rule")
    general = met.select("description_raw", rule).groupBy("description_raw", F.col("rule.direction").alias("direction")).agg(F.min("rule.place").alias("place"))
    ways = F.array_distinct(F.array(F.lit(""), F.coalesce("direction", F.lit(""))))
    each = asked.select(*whom, F.col("description_raw"), F.explode(ways).alias("direction"))
    for_all = each.join(general, ["description_raw", "direction"]).select(*[f"_{c}" for c in ASKED], "place")

    named = met.where("named").select("description_raw", "pattern").distinct()
    own = asked.where("account_id <> ''").select(*whom, "description_raw", F.col("account_id").alias("account")).join(named, "description_raw")
    own = own.join(firsts.where("account <> ''"), ["pattern", "account"]).where((F.col("direction") == "") | (F.col("direction") == F.col("_direction")))
    found = for_all.unionByName(own.select(*[f"_{c}" for c in ASKED], "place")).groupBy(*[f"_{c}" for c in ASKED]).agg(F.min("place").alias("_p"))
    return found.select(*[F.col(f"_{c}").alias(c) for c in ASKED], F.col("_p.out").alias("match"))


def with_matches(rows: DataFrame, rules: DataFrame, eligible: Column, name: str = "match") -> DataFrame:
    """``rows`` with the first rule of each eligible row as a struct, null where none matches."""
    marked = rows.withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    found = first_matches(marked.where("_eligible"), rules).select(*[F.col(c).alias(f"_{c}") for c in ASKED], F.col("match").alias(name))
    same = F.col("_eligible") & (F.col("description_raw") == F.col("_description_raw"))
    for c in ASKED[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return marked.join(found, same, "left").select(*rows.columns, name)
