"""URL filter: rules first, and a character language-model ratio for URLs without a rule. DataFrame functions only.

Two variable-order Markov models are counted, over URLs that rules accept and that rules reject. A character's probability
after a context mixes the counts there with the probability after the next shorter context (Witten-Bell: a context with many
different followers trusts its counts less), down to a uniform one. A URL's score is the difference of its log-likelihoods
per character, held against a threshold calibrated on URLs that the counts have not seen.

The difference of log-likelihoods is a sum over substrings: write L(s) for the log-ratio of the last character of s after the
rest, and b(s) for the log-ratio of the weights with which context s hands down to the next shorter one. A position whose
longest known substring is s then scores L(s) plus b of all longer known contexts, which is the sum of
d(s) = L(s) - L(s without its first character) - b(context of s) over its known substrings and of b over its known contexts.
So one table of substrings with one weight each scores any URL by a join and a sum, and URLs are never brought together.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlens.session import materialise


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: Characters of the longest context.
ORDER = 4
#: Substrings up to which their weights are broadcast to the URLs; more are joined by a shuffle.
HELD = 1_000_000
#: Of 16 md5 digits, the first digits below this mark URLs that calibrate.
CALIBRATE = "4"
#: Uniform probability of a character that no context knows.
ALPHABET = 256
#: Width of a threshold's step, in nats per character.
STEP = 0.01

BEGIN, END = "\u0002", "\u0003"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The part behind the first :// up to /, ? or #, with A-Z lowered; the part from there up to ? or #."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits: its host or one below it, and a path that starts with the rule's.

    Of equally long rules the one listed first wins; without a fitting rule both are null.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url (null: empty), host, path, rule, rule_verdict."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    parted = base.select("*", *[c.alias(n) for c, n in zip(host_and_path(F.col("url")), ("host", "path"), strict=True)])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parted.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def substrings(url: Column, order: int = ORDER) -> Column:
    """Every substring of up to ``order`` + 1 characters that ends with a character of the URL or its end, as an array."""
    text = F.concat(F.lit(BEGIN), url, F.lit(END))
    places = F.sequence(F.lit(2), F.length(url) + 2)

    def ending(n: int) -> Column:
        return F.transform(places, lambda p: F.when(p >= n, F.substring(text, p - (n - 1), F.lit(n))))

    return F.filter(F.concat(*map(ending, range(1, order + 2))), lambda s: s.isNotNull())


def training_urls(found: DataFrame) -> DataFrame:
    """(url, accepted, calibrates): all different URLs of each verdict."""
    known = found.filter("rule_verdict IS NOT NULL").select("url", (F.col("rule_verdict") == "allow").alias("accepted")).distinct()
    return known.select("url", "accepted", (F.right(F.md5("url"), F.lit(1)) < CALIBRATE).alias("calibrates"))


def model(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """(part, weight) of all substrings met in the URLs that do not calibrate, and the empty substring's weight.

    Substrings are counted where they arise and summed by a shuffle; every further step is over the different ones.
    """
    parts = sample.filter("NOT calibrates").select("accepted", F.explode(substrings(F.col("url"), order)).alias("part"))
    counted = parts.groupBy("part").agg(
        F.count_if("accepted").cast("double").alias("n_a"), F.count_if(~F.col("accepted")).cast("double").alias("n_r")
    )
    size = F.length("part")
    counted = counted.select("part", size.alias("size"), F.substring("part", F.lit(1), size - 1).alias("context"), "n_a", "n_r")
    contexts = counted.groupBy("context").agg(
        *[F.sum(f"n_{k}").alias(f"all_{k}") for k in "ar"], *[F.count_if(F.col(f"n_{k}") > 0).cast("double").alias(f"kinds_{k}") for k in "ar"]
    )
    full = counted.join(contexts, "context")

    def mixed(kind: str, lower: Column) -> Column:
        # A context that one kind of URL never had hands all weight down.
        weight = F.col(f"all_{kind}") + F.col(f"kinds_{kind}")
        return F.when(weight > 0, (F.col(f"n_{kind}") + F.col(f"kinds_{kind}") * lower) / weight).otherwise(lower)

    uniform = F.lit(1.0 / ALPHABET)
    level = full.filter("size = 1").select("*", *[mixed(k, uniform).alias(f"p_{k}") for k in "ar"])
    levels = [level]
    for n in range(2, order + 2):
        lower = level.select(F.col("part").alias("shorter"), F.col("p_a").alias("low_a"), F.col("p_r").alias("low_r"))
        met = full.filter(F.col("size") == n).join(lower, F.substring("part", 2, n) == F.col("shorter"))
        level = met.select(*full.columns, *[mixed(k, F.col(f"low_{k}")).alias(f"p_{k}") for k in "ar"], (F.log("low_a") - F.log("low_r")).alias("lower"))
        levels.append(level)
    every = levels[0].withColumn("lower", F.lit(0.0))
    for level in levels[1:]:
        every = every.unionByName(level)
    down = [F.when(F.col(f"all_{k}") > 0, F.col(f"kinds_{k}") / (F.col(f"all_{k}") + F.col(f"kinds_{k}"))).otherwise(1.0) for k in "ar"]
    handed = F.log(down[0]) - F.log(down[1])
    own = every.select("part", (F.log("p_a") - F.log("p_r") - F.col("lower") - handed).alias("weight"))
    return own.unionByName(contexts.select(F.col("context").alias("part"), handed.alias("weight"))).groupBy("part").agg(F.sum("weight").alias("weight"))


def scores(urls: DataFrame, weights: DataFrame, order: int = ORDER, held: int = HELD) -> DataFrame:
    """(url, score) of different URLs: the log-ratio per character, the end counted as one, rounded to 9 digits.

    The empty context stands before each character, so its weight and that of a URL's begin, two rows, are taken out of the table. The
    others are broadcast up to ``HELD``; a URL's parts are then summed in the task they arise in, and one row per URL is shuffled.
    """
    ends = {r["part"]: r["weight"] for r in weights.filter(F.col("part").isin("", BEGIN)).collect()}
    inner = weights.filter(~F.col("part").isin("", BEGIN))
    inner = F.broadcast(inner) if weights.count() <= held else inner
    parts = urls.select("url", F.explode(substrings(F.col("url"), order)).alias("part"))
    sums = parts.join(inner, "part", "left").groupBy("url").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"))
    total = F.col("total") + F.lit(ends.get("", 0.0)) * (F.length("url") + 1)
    if order:
        total = total + F.lit(ends.get(BEGIN, 0.0))
    return sums.select("url", F.round(total / (F.length("url") + 1), 9).alias("score"))


def threshold(scored: DataFrame, step: float = STEP) -> DataFrame:
    """One row, ``threshold``: the step at which (accepted at or above it) + (rejected below it), as shares, is largest.

    ``scored`` is the calibrating part of the ruled URLs with (accepted, score). Of equal steps the lowest wins. If either kind
    is missing there is nothing to weigh, and the threshold is 0.
    """
    steps = scored.groupBy(F.floor(F.col("score") / step).alias("at")).agg(
        F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")
    )
    # A row a step that a score per character falls into, some hundreds whatever the number of URLs.
    up, below = Window.orderBy(F.desc("at")), Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    gain = F.sum("a").over(up) / F.sum("a").over(every) + F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(every)
    best = steps.select("at", F.when((F.sum("a").over(every) > 0) & (F.sum("r").over(every) > 0), F.round(gain, 9)).alias("gain"))
    return best.agg(F.coalesce(F.max_by(-F.col("at"), F.struct("gain", -F.col("at"))), F.lit(0)).alias("at"), F.max("gain").alias("gain")).select(
        F.when(F.col("gain").isNull(), 0.0).otherwise(-F.col("at") * step).alias("threshold")
    )


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides), a row per page.

    A URL without a rule is allowed if its score reaches the threshold. Null and unparted URLs have empty host and path and
    are scored by the characters they have. Without ruled URLs of both kinds nothing is known, all scores tend to 0 and
    the threshold is 0. Equal URLs are scored once; rows are never merged.
    """
    found = ruled(pages, rules)
    sample = materialise(training_urls(found), "url-training")
    weights = materialise(model(sample, order), "url-model")
    checked = sample.filter("calibrates").join(scores(sample.filter("calibrates").select("url").distinct(), weights, order), "url")
    limit = threshold(checked).first()["threshold"]
    open_ = found.filter("rule IS NULL").select("url").distinct()
    scored = scores(open_, weights, order).select(F.col("url").alias("scored_url"), "score")
    rows = found.join(scored, (F.col("url") == F.col("scored_url")) & F.col("rule").isNull(), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
