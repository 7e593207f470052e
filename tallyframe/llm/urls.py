"""URL filtering: host and path rules, and a character language-model ratio for what no rule decides.

Two smoothed variable-order Markov models are learned, one from the URLs that rules allow and one
from those they block. Each symbol is predicted from up to three before it; an order mixes its own
counts with the next shorter order in proportion to how many different symbols follow the context
(Witten-Bell), so unseen contexts fall back to shorter ones. A URL's score is the difference of its
log-likelihoods divided by its length. The threshold is the score that separates allowed from
blocked URLs best (true positive plus true negative rate), found on a histogram of all of them.

URLs are reduced to an alphabet of at most 41 symbols, so the model has at most 41**4 grams and
contexts whatever the input; that bound is what allows the gram table to be broadcast.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is
judged by the model on what it holds (a null URL as empty text). Equal rows are judged once and
returned as often as they occur. Without allowed or without blocked URLs all scores are 0 and the
threshold is 0, so everything undecided is allowed. An empty table gives no rows. Other columns of
``pages`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import ascii_lower, settle

#: verdict and rule, as given for the query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 3
SYMBOLS = 41
STEP = 0.01
EDGE = 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rules(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does. Among equals the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def symbols(url: Column) -> Column:
    """Lower case, digits as ``0``, anything but common URL signs as ``*``, an end sign."""
    text = F.regexp_replace(ascii_lower(F.coalesce(url, F.lit(""))), "[0-9]", "0")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(text, r"[^a-z0/._?=&%:~+-]", "*"), F.lit("$"))


def _grams(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per symbol with its context before it."""
    at = F.explode(F.sequence(F.lit(1), F.length("symbols") - ORDER)).alias("at")
    return rows.select(*keep, "symbols", at).select(*keep, F.substring("symbols", F.col("at"), F.lit(ORDER + 1)).alias("gram"))


def gram_scores(rows: DataFrame) -> DataFrame:
    """Log-likelihood ratio of every gram that occurs in any URL. ``rows``: ``symbols, verdict, n``."""
    counts = settle(
        _grams(rows, "verdict", "n").groupBy("gram").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(c) for v, c in (("allow", "a"), ("block", "r"))]),
        "url-grams",
    )
    scores = counts.select("gram", *[F.lit(1.0 / SYMBOLS).alias(f"p{c}") for c in "ar"])
    for order in range(ORDER + 1):
        seen = counts.groupBy(F.substring("gram", ORDER + 1 - order, order + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        context = F.substring("g", 1, order) if order else F.lit("")
        around = seen.groupBy(context.alias("c")).agg(
            *[F.sum(c).alias(f"n{c}") for c in "ar"], *[F.sum((F.col(c) > 0).cast("long")).alias(f"t{c}") for c in "ar"]
        )
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        before = F.substring("gram", ORDER + 1 - order, order) if order else F.lit("")
        mixed = [
            F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}"))).otherwise(F.col(f"p{c}")).alias(f"p{c}")
            for c in "ar"
        ]
        scores = scores.join(seen, tail == F.col("g")).join(around, before == F.col("c")).select("gram", *mixed)
    return scores.select("gram", (F.log("pa") - F.log("pr")).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Where allowed and blocked part best. At most ``2 * EDGE / STEP`` rows come to the driver."""
    bounded = F.greatest(F.lit(-EDGE), F.least(F.lit(EDGE), F.col("score")))
    bins = (
        scored.where("verdict is not null").groupBy(F.floor(bounded / STEP).alias("bin"))
        .agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")])
        .orderBy("bin").collect()
    )
    allow, block = (sum(b[v] for b in bins) for v in ("allow", "block"))
    if not allow or not block:
        return 0.0
    best, at, kept, dropped = -1.0, 0.0, allow, 0
    for b in bins:
        if (value := kept / allow + dropped / block) > best:
            best, at = value, b["bin"] * STEP
        kept, dropped = kept - b["allow"], dropped + b["block"]
    return at


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages``."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = by_rules(F.col("host"), F.col("path"), rules)
    rows = settle(
        pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))
        .select("page_id", "n", host.alias("host"), path.alias("path"), symbols(F.col("url")).alias("symbols"))
        .select("*", rule.alias("rule"), verdict.alias("verdict"), F.expr("uuid()").alias("row")),
        "url-rows",
    )
    ratios = settle(gram_scores(rows), "url-ratios")
    both = rows.agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("r")).first()
    weight = 1.0 if both["a"] and both["r"] else 0.0
    sums = _grams(rows, "row").join(F.broadcast(ratios), "gram").groupBy("row").agg((F.avg("ratio") * weight).alias("score"))
    scored = settle(rows.drop("symbols").join(sums, "row"), "url-scores")
    allowed = F.when(F.col("score") >= _threshold(scored), "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", allowed).alias("verdict"), "score", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_again")
    ).drop("_again")
