"""URL filter: host rules first, then logistic regression on hashed character n-grams.

Host and path are cut out of the url; the longest rule that fits decides. Other urls are judged by a
linear model over n-grams of host and path, hashed into ``BUCKETS``. The model is trained from a small
labelled url table by gradient steps that are each one aggregation; only the weights, bounded by
``BUCKETS``, come to the driver. Everything is DataFrame expressions.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and is judged
by the bias and the empty n-grams alone. Null and repeated page ids are rows like others; other columns
are ignored. An empty labelled table gives a model that allows all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import prepare, written

BUCKETS = 4096
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules as host, path and verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Words of the hosts in the labelled table, with 1 for unwanted ones.
LABELLED_HOSTS = (
    ("spam-farm", 1), ("cheap-pills", 1), ("casino-win", 1), ("free-bets", 1), ("adult-x", 1), ("ads-track", 1),
    ("best-casino", 1), ("pills-online", 1), ("win-bets", 1), ("adult-free", 1), ("track-ads", 1), ("spam-cheap", 1),
    ("library", 0), ("citynews", 0), ("thehandbook", 0), ("weather", 0), ("otherthings", 0), ("museum", 0),
    ("theronline", 0), ("tradition", 0), ("nationhouse", 0), ("within", 0), ("earthbook", 0), ("therest", 0),
    ("mathforum", 0), ("stories", 0), ("gardening", 0), ("thanthe", 0), ("recipes", 0), ("university", 0),
)
LABELLED_PREFIXES, LABELLED_ENDS, LABELLED_PATHS = ("", "www.", "blog."), (".example.org", ".example.net"), ("/en/12", "/de/345.html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``url`` and ``label`` (1: unwanted)."""
    rows = [
        (f"https://{p}{h}{e}{q}", y) for h, y in LABELLED_HOSTS for p in LABELLED_PREFIXES for e in LABELLED_ENDS for q in LABELLED_PATHS
    ]
    return spark.createDataFrame(rows, "url string, label int")


def host_of(url: Column) -> Column:
    rest = F.expr("substring(__url, locate('://', __url) + 3)")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(url.contains("://"), F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.expr("substring(__url, locate('://', __url) + 3)")
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def parts(df: DataFrame, url_col: str, *keep: Column) -> DataFrame:
    named = df.select(*keep, F.col(url_col).cast("string").alias("__url"))
    return named.withColumn("host", host_of(F.col("__url"))).withColumn("path", path_of(F.col("__url"))).drop("__url")


def _grams(text: Column, kind: str, size: int) -> Column:
    """Buckets of all n-grams of a text between a start and an end mark."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    places = F.when(F.length(marked) >= size, F.sequence(F.lit(1), F.length(marked) - (size - 1)))
    places = F.coalesce(places, F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substring(marked, i, F.lit(size))), F.lit(BUCKETS)).cast("int"))


def features() -> Column:
    """Distinct buckets of ``host`` and ``path``."""
    all_grams = [_grams(F.col(c), c, n) for c in ("host", "path") for n in SIZES]
    return F.array_distinct(F.concat(*all_grams))


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    bias: float

    def probability(self, buckets: Column) -> Column:
        """That a url with these buckets is unwanted."""
        table = F.split(F.lit(",".join(map(repr, self.weights.tolist()))), ",").cast("array<double>")
        odds = F.aggregate(buckets, F.lit(self.bias), lambda total, b: total + F.get(table, b))
        return 1 / (1 + F.exp(-odds))


def train(labelled: DataFrame, rounds: int = 25, rate: float = 0.6, decay: float = 1e-3) -> UrlModel:
    """Logistic regression by full gradient steps with momentum; each step is one aggregation."""
    prepare(labelled.sparkSession)
    rows = parts(labelled.filter("url is not null and label is not null"), "url", F.col("label").cast("double").alias("label"))
    rows = written(rows.select("label", features().alias("buckets")), "urls")
    n = rows.count()
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    if not n:
        return UrlModel(model.weights, -1.0)
    speed = np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        slope = rows.select("buckets", (model.probability(F.col("buckets")) - F.col("label")).alias("slope"))
        steps = slope.select("slope", F.explode(F.concat(F.col("buckets"), F.array(F.lit(BUCKETS)))).alias("bucket"))
        found = steps.groupBy("bucket").agg((F.sum("slope") / n).alias("g")).collect()
        gradient = np.zeros(BUCKETS + 1)
        for row in found:
            gradient[row["bucket"]] = row["g"]
        gradient[:-1] += decay * model.weights
        speed = 0.8 * speed - rate * gradient
        model = UrlModel(model.weights + speed[:-1], model.bias + float(speed[-1]))
    return model


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule`` (null if none fits), ``verdict`` (allow or block), ``probability``."""
    rows = parts(pages, url_col, F.col(id_col).alias("page_id"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    judged = rows.withColumn("probability", model.probability(features()))
    method = F.when(F.col("probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "probability")
