"""URL filter (operator 3): rules first, then a logistic regression on hashed character n-grams.

The model learns from a small labelled URL table: the URLs that a rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm.common import table

#: (rule, verdict): a host, then a path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def url_host(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?`` or ``#``, A-Z lower-cased; empty without one."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last that fits stands
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(part: str, salt: int, sizes: Sequence[int], bits: int) -> np.ndarray:
    """Hashed n-grams of the UTF-8 bytes, with marks at both ends."""
    raw = np.frombuffer(b"\x02" + part.encode() + b"\x03", np.uint8).astype(np.uint64)
    out = []
    for n in sizes:
        if len(raw) >= n:
            h = np.full(len(raw) - n + 1, salt * 1_000_003 + n, np.uint64)
            for k in range(n):
                h = (h ^ raw[k : len(raw) - n + 1 + k]) * np.uint64(0x100000001B3)
            out.append(h ^ h >> np.uint64(29))
    return (np.concatenate(out) & np.uint64((1 << bits) - 1)).astype(np.int64) if out else np.zeros(0, np.int64)


class UrlModel:
    """weights over 2 ** bits buckets and a bias; probability() is that of ``block``."""

    def __init__(self, bits: int = 13, sizes: Sequence[int] = (2, 3, 4)):
        self.bits, self.sizes = bits, tuple(sizes)
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def features(self, host: str, path: str) -> np.ndarray:
        return np.unique(np.concatenate([_grams(host, 1, self.sizes, self.bits), _grams(path, 2, self.sizes, self.bits)]))

    def _flat(self, hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = [self.features(h, p) for h, p in zip(hosts, paths)]
        sizes = np.array([len(x) for x in each], np.int64)
        cols = np.concatenate(each) if each else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(each)), sizes), cols, 1 / np.sqrt(np.maximum(sizes, 1))

    def fit(self, hosts: Sequence[str], paths: Sequence[str], block: np.ndarray, steps: int = 300, rate: float = 2.0, l2: float = 1e-4) -> UrlModel:
        """Full-batch gradient descent with weights that even the two classes out. With a class missing, the
        bias alone answers: the class that is there, or allow without any row."""
        y, n = np.asarray(block, float), len(block)
        if not n or y.min() == y.max():
            self.bias = 20.0 * (2 * y[0] - 1) if n else -20.0
            return self
        rows, cols, scale = self._flat(hosts, paths)
        value = scale[rows]
        each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
        for _ in range(steps):
            z = np.bincount(rows, self.weights[cols] * value, n) + self.bias
            error = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            self.weights -= rate * (np.bincount(cols, error[rows] * value, len(self.weights)) + l2 * self.weights)
            self.bias -= rate * error.sum()
        return self

    def probability(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        rows, cols, scale = self._flat(hosts, paths)
        z = np.bincount(rows, self.weights[cols] * scale[rows], len(hosts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_urls(judged: DataFrame, per_class: int) -> list:
    """Up to ``per_class`` distinct (host, path) of each verdict that a rule gave, by hash order."""
    rows = []
    for verdict in ("allow", "block"):
        own = judged.where(F.col("rule_verdict") == verdict).select("host", "path", "rule_verdict").distinct()
        rows += own.orderBy(F.xxhash64("host", "path"), "host", "path").limit(per_class).collect()
    return rows


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    per_class: int = 2000,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score of every row.

    The labelled table has at most ``per_class`` rows of either verdict (the bound of what the driver sees).
    A null url, or one without ``://``, has an empty host and path, which no rule fits; the model judges it.
    Repeated rows are all judged, alike. An empty table gives no rows. Other columns are not read.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    own = own.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    own = own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(x) for r in rules for x in r])[F.col("rule")] if rules else F.lit(None).cast("string")
    own = own.withColumn("rule_verdict", by_rule)
    seen = labelled_urls(own, per_class)
    model = UrlModel().fit([r.host for r in seen], [r.path for r in seen], np.array([r.rule_verdict == "block" for r in seen]))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for host, path in parts:
            yield pd.Series(model.probability(host.tolist(), path.tolist()))

    own = own.withColumn("block_score", score("host", "path"))
    by_model = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return own.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_model).alias("verdict"), "block_score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_filter": op3_url_filter}
SQL: dict[str, str] = {}
