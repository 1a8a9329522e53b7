"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The urls that a rule decides are the labelled ones; the trees learn from them and judge the others.  Features:
length, depth, digit ratio, character entropy, parameter counts, host shape, and suffix statistics (how often
labelled urls with the same last host label, last two labels or first path segment are blocked).

Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is judged like any
other; without labelled urls of both kinds the verdict is that of the labelled ones, ``allow`` if there are
none; equal urls get equal verdicts; rows that repeat are judged alike; input columns named like the four written
ones are replaced, all others pass through.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from graticule.functions.arrays import let
from graticule.plans.lineage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BOUND = 200_000  # labelled rows that the trees are fitted on
SMALL = 100_000  # suffix values that are broadcast; more are joined by salted shuffles
SALTS = 8
LEAST = 20  # labelled urls behind a suffix statistic
SMOOTH = 10.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule], value) -> Column:
    """``value(rule)`` of the longest fitting rule; null where none fits."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.when(F.length(text) > 0, F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))).otherwise(0.0)


LEXICAL = ["length", "host_length", "labels", "hyphens", "depth", "path_length", "digit_ratio", "bits", "parameters", "query_length", "fragment"]
SUFFIXES = ["last_label", "last_two", "first_segment"]


def lexical(urls: DataFrame, url: str) -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    path, host = F.col("path"), F.col("host")
    asked = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    values = {
        "length": F.length(u), "host_length": F.length(host), "labels": F.size(F.split(host, r"\.")), "hyphens": F.regexp_count(u, F.lit("[-_]")),
        "depth": F.regexp_count(path, F.lit("/[^/]")), "path_length": F.length(path), "digit_ratio": F.regexp_count(u, F.lit("[0-9]")) / F.greatest(F.length(u), F.lit(1)),
        "bits": entropy(u), "parameters": F.regexp_count(asked, F.lit("[^&=]+=?[^&]*")), "query_length": F.length(asked), "fragment": F.instr(u, "#"),
    }
    return suffixed(urls.withColumns({k: v.cast("double") for k, v in values.items()}))


def suffixed(urls: DataFrame) -> DataFrame:
    host, path = F.col("host"), F.col("path")
    return urls.withColumns({"last_label": F.regexp_extract(host, r"([^.]*)$", 1), "last_two": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1), "first_segment": F.regexp_extract(path, r"^/([^/]*)/", 1)})


def sampled(labelled: DataFrame, n: int, url: str = "url") -> DataFrame:
    """About BOUND of ``n`` labelled rows, all if they are fewer: of the rows of one url its share, chosen by content."""
    share = min(1.0, BOUND / n)
    counted = labelled.groupBy(url, "host", "path", "blocked").agg(F.count(F.lit(1)).alias("_n"))
    drawn = F.pmod(F.xxhash64(url), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("_n") * share + drawn).cast("int") if share < 1 else F.col("_n").cast("int")
    return counted.withColumn("_k", F.explode(F.array_repeat(F.lit(0), copies))).drop("_n", "_k")


class UrlTrees:
    """Trees over lexical features.  Suffix statistics are of all labelled urls (column ``blocked`` 0/1), the trees are fitted on about BOUND of them."""

    def __init__(self, rounds: int = 12, depth: int = 4, seed: int = 7):
        self.rounds, self.depth, self.seed = rounds, depth, seed
        self.model = self.constant = None
        self.stats: dict[str, DataFrame] = {}

    def fit(self, labelled: DataFrame, url: str = "url") -> UrlTrees:
        counts = labelled.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
        self.constant = float(counts["n"] > 0 and 2 * counts["b"] > counts["n"])
        if counts["b"] in (0, counts["n"]):
            return self
        prior = counts["b"] / counts["n"]
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(s).alias("value")) for s in SUFFIXES]))
        rate = (F.sum("blocked") + F.lit(SMOOTH * prior)) / (F.count(F.lit(1)) + SMOOTH)
        told = suffixed(labelled.select("host", "path", "blocked")).select(each.alias("s"), "blocked").groupBy("s.kind", "s.value")
        told = cut(told.agg(rate.alias("rate"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("kind", "value", "rate"))
        self.small = told.count() <= SMALL
        self.stats = {s: told.where(F.col("kind") == s).select(F.col("value").alias(s), F.col("rate").alias(f"{s}_rate")) for s in SUFFIXES}
        self.prior = prior
        labelled = lexical(sampled(labelled, counts["n"], url), url).persist()
        train = self._vectors(labelled).select("features", F.col("blocked").cast("double").alias("label")).orderBy(F.xxhash64("features", "label"))
        self.model = GBTClassifier(maxIter=self.rounds, maxDepth=self.depth, seed=self.seed, stepSize=0.3).fit(train)
        labelled.unpersist()
        return self

    def _vectors(self, urls: DataFrame) -> DataFrame:
        for s in SUFFIXES:
            if self.small:
                urls = urls.join(F.broadcast(self.stats[s]), s, "left")
            else:  # a value that many urls share is spread over SALTS tasks
                salted = self.stats[s].withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
                urls = urls.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [s, "_salt"], "left").drop("_salt")
            urls = urls.fillna({f"{s}_rate": self.prior})
        return VectorAssembler(inputCols=LEXICAL + [f"{s}_rate" for s in SUFFIXES], outputCol="features").transform(urls)

    def blocked(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """``urls`` (with host and path) plus ``prediction``: 1.0 to block."""
        if self.model is None:
            return urls.withColumn("prediction", F.lit(self.constant))
        scored = self.model.transform(self._vectors(lexical(urls, url)))
        return scored.select(*urls.columns, "prediction")


def with_rules(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``urls`` plus host, path, rule and rule_verdict."""
    split = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    host, path = F.col("host"), F.col("path")
    return split.withColumns({"rule": rule_of(host, path, rules, lambda r: r.name), "rule_verdict": rule_of(host, path, rules, lambda r: r.verdict)})


def judged(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``urls`` plus host, path, rule and verdict (allow or block)."""
    written = ("host", "path", "rule", "verdict")
    split = with_rules(urls.select(F.struct(*[c for c in urls.columns if c not in written]).alias("row"), F.col(url).alias("url")), rules)
    labelled = split.where("rule IS NOT NULL").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("long").alias("blocked"))
    told = UrlTrees().fit(labelled).blocked(split)
    method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return told.select("row.*", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))
