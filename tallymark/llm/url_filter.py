"""URL filter: rules by host and path, and a logistic regression over n-grams.

Everything is DataFrame work.  URLs that no rule fits are judged by a logistic
regression on hashed character n-grams of host and path.  It is trained from a
small labelled table by full-batch gradient steps; a step is one aggregation over
that table, and only the weights, one number per bucket, pass through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import written

BUCKETS = 2_048
ORDERS = (3, 4)
LABELLED_ROWS = 2_000  # bound of the labelled table
STEPS = 12
RATE = 8.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for a host with its subdomains, where the path starts with the rule's."""

    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """Place or verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.place)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.lit(getattr(rule, what))).otherwise(found)
    return found


def grams(host: Column, path: Column) -> Column:
    """Buckets of all character n-grams of ``^host`` and ``path$``, repeats included."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))
    runs = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in ORDERS]
    return F.transform(F.concat(*runs), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


def _margin(buckets: Column, weights: list[float], bias: float) -> Column:
    """Bias plus the mean weight of a URL's n-grams."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.lit(bias) + total / F.greatest(F.size(buckets), F.lit(1))


def train(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias from ``host, path, blocked``; without both labels, all zero but the bias.

    The two classes weigh the same, so neither is favoured for being frequent.
    """
    table = written(labelled.select(grams(F.col("host"), F.col("path")).alias("grams"), F.col("blocked").cast("int").alias("blocked")), "urls")
    sizes = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("blocked")).first()
    bad, good = sizes["blocked"], sizes["n"] - sizes["blocked"]
    weights, bias = [0.0] * BUCKETS, 0.0
    if not bad or not good:
        return weights, 1.0 if bad else -1.0
    share = F.when(F.col("blocked") == 1, F.lit(0.5 / bad)).otherwise(F.lit(0.5 / good))
    scale: list[float] | None = None
    for _ in range(steps):
        error = share * (1 / (1 + F.exp(-_margin(F.col("grams"), weights, bias))) - F.col("blocked"))
        rows = table.select(error.alias("error"), share.alias("share"), "grams")
        each = rows.select(
            F.explode(F.concat(F.col("grams"), F.array(F.lit(-1)))).alias("bucket"),
            F.greatest(F.size("grams"), F.lit(1)).alias("n"), "error", "share",
        )
        sums = each.groupBy("bucket").agg(
            F.sum(F.when(F.col("bucket") < 0, F.col("error")).otherwise(F.col("error") / F.col("n"))).alias("slope"),
            F.sum(F.col("share") / F.col("n") / F.col("n")).alias("curve"),
        ).collect()
        if scale is None:
            scale = [0.0] * BUCKETS
            for row in sums:
                if row["bucket"] >= 0:
                    scale[row["bucket"]] = 1 / (row["curve"] ** 0.5 + 1e-4)
        for row in sums:
            if row["bucket"] < 0:
                bias -= row["slope"]
            else:
                weights[row["bucket"]] -= RATE / len(ORDERS) * scale[row["bucket"]] * row["slope"]
    return weights, bias


def labelled_by_rules(pages: DataFrame, rules: list[Rule], rows: int = LABELLED_ROWS) -> DataFrame:
    """A small labelled table: up to ``rows`` distinct URLs that a rule decides, with the rule's verdict.

    Taken by a hash of host and path, so no order of the pages shows.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select(host.alias("host"), path.alias("path"))
    known = parts.withColumn("verdict", fitting_rule(F.col("host"), F.col("path"), rules, "verdict")).where("verdict is not null")
    return (
        known.distinct().orderBy(F.xxhash64("host", "path"), "host", "path").limit(rows)
        .select("host", "path", (F.col("verdict") == "block").alias("blocked"))
    )


def judge(pages: DataFrame, rules: list[Rule], labelled: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    ``rule`` is null where none fits, and then the model decides: block if its
    margin is above zero.  A null URL or one without ``://`` has an empty host and
    path and goes to the model like any other; repeated rows are judged each; a
    null ``page_id`` stays null; other columns are not read.
    """
    weights, bias = train(labelled)
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    by_model = F.when(_margin(grams(h, p), weights, bias) > 0, F.lit("block")).otherwise(F.lit("allow"))
    return parts.select(
        "page_id", "host", "path", fitting_rule(h, p, rules, "place").alias("rule"),
        F.coalesce(fitting_rule(h, p, rules, "verdict"), by_model).alias("verdict"),
    )
