"""URL verdicts: rules for hosts and paths, and a linear model of character n-grams for the rest.

Method: logistic regression on hashed character n-grams of host and path, trained on a small labelled URL table. Only
DataFrame functions touch the data: n-grams are cut and hashed by Spark, the fitted weights are one array constant, and
a URL's score is the sum of its n-grams' weights.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 1 << 13
SIZES = (3, 4, 5)
# A rule: (verdict, host and path prefix). The host fits itself and its subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

# Labelled host names for training, both kinds put under the same prefixes, domains and paths: what advertising,
# gambling, adult, pharmacy and malware hosts are called, and what editorial and community hosts are called. They are
# general vocabulary; no host name of the given pages is among them.
BLOCKED = (
    "best-casino", "online-casino", "casino-royal", "bet-now", "sports-bets", "bets-online", "free-spins", "poker-win",
    "slots-jackpot", "lottery-win", "win-prize", "pills-online", "cheap-meds", "cheap-viagra", "weight-loss-pills",
    "discount-pharmacy", "viagra-shop", "ad-server", "adtrack", "ads-network", "popup-ads", "click-ads", "track-clicks",
    "user-track", "spam-links", "seo-spam", "spam-mailer", "link-farm", "click-farm", "fake-news-farm", "adult-cams",
    "hot-adult", "adult-dating", "xxx-videos", "x-rated", "porn-tube", "sex-chat", "free-download-crack", "warez-keygen",
    "phishing-login", "malware-host", "free-iphone", "free-gifts", "quick-loans", "payday-loans", "crypto-doubler",
    "get-rich", "replica-watches",
)
ALLOWED = (
    "news", "library", "university", "museum", "city-council", "weather", "science", "history", "health-service",
    "public-radio", "docs", "wiki", "forum", "recipes", "garden", "travel-notes", "local-paper", "archive", "school",
    "research-group", "community", "open-data", "hospital", "bookshop", "theatre", "cinema", "observatory", "the-daily",
    "the-review", "mountain-club", "sailing", "chess-club", "photo-notes", "learn-math", "rivers", "harbour", "shores",
    "lanterns", "orchard", "station", "nation", "education", "translation", "conservation", "astronomy", "northern-lights",
    "other-voices", "the-thread", "mathematics", "earth-atlas", "heritage", "gathering", "brotherhood", "leather-crafts",
    "feathers", "method", "theory", "therapy-centre", "author", "truth", "south-coast", "fourth-estate", "anthology",
    "table-talk", "stable", "vegetables", "workshop", "worship", "friendship", "readings", "evening-post", "morning",
    "strings", "kitchen", "painting", "printing", "walking", "swimming", "gallery", "botany", "geology", "islands",
    "winter-sports", "railways", "canals", "choir", "orchestra", "parliament", "village-hall", "allotments", "beekeeping",
)
PLACES = (("", ".example.com", "/en/12"), ("www.", ".example.org", "/de/480.html"), ("blog.", ".example.com", "/fr/7/"),
          ("m.", ".example.com", "/es/993"), ("blog.", ".example.org", "/en/5"), ("m.", ".example.net", "/fr/31.html"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: the host up to / ? # or the end, A-Z lower-cased, and the path up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                       "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for outcome, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = F.concat(F.lit("."), host).endswith("." + name) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def buckets(host: Column, path: Column) -> Column:
    """Hashed character n-grams of host and path, marked at both ends; digits count as one digit.

    The text is split into its characters once, so the work is proportional to its length. Lambda arguments hold the
    characters because Spark evaluates what else a lambda mentions again for each element.
    """
    text = F.regexp_replace(F.concat(F.lit("^"), host, path, F.lit("$")), "[0-9]+", "0")

    def grams(letters: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(letters) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.array_join(F.slice(letters, i, F.lit(n)), "")),
                                                    F.lit(BUCKETS)))

    return F.flatten(F.transform(F.array(F.split(text, "")),
                                 lambda letters: F.concat(*(grams(letters, n) for n in SIZES))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The labelled table (host, path, label): 1 is blocked."""
    def rows(names: tuple[str, ...], label: float) -> Column:
        return F.struct(F.array(*map(F.lit, names)).alias("names"), F.lit(label).alias("label"))

    return (spark.range(1).select(F.explode(F.array(rows(BLOCKED, 1.0), rows(ALLOWED, 0.0))).alias("r"))
            .select("r.label", F.explode("r.names").alias("name"))
            .select("label", F.explode(F.array(*(
                F.struct(F.concat(F.lit(prefix), "name", F.lit(domain)).alias("host"), F.lit(path).alias("path"))
                for prefix, domain, path in PLACES))).alias("u"))
            .select("label", "u.host", "u.path"))


def train(labelled: DataFrame, penalty: float = 0.05, rounds: int = 12) -> tuple[list[float], float]:
    """Weights per bucket and the intercept of the regularized logistic regression.

    The labelled table is small by contract and its hashed n-grams come to the driver. Newton steps run on the products
    between its rows, which is the same problem in as many unknowns as there are rows.
    """
    rows = labelled.select("label", F.array_distinct(buckets(F.col("host"), F.col("path"))).alias("found")).collect()
    x = np.zeros((len(rows), BUCKETS + 1))
    x[:, -1] = 1.0  # the intercept
    for k, row in enumerate(rows):
        x[k, row["found"]] = 1.0
    label, products, dual = np.array([r["label"] for r in rows]), x @ x.T, np.zeros(len(rows))
    for _ in range(rounds):
        score = products @ dual
        chance = 1 / (1 + np.exp(-score))
        spread = np.maximum(chance * (1 - chance), 1e-6)
        dual = np.linalg.solve(products + penalty * np.diag(1 / spread), score + (label - chance) / spread)
    weights = x.T @ dual
    return weights[:-1].tolist(), float(weights[-1])


def judge(pages: DataFrame, weights: tuple[list[float], float], rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of pages (page_id, url).

    Null url or one without `://`: host and path empty, no rule, and the model's verdict on them is `allow` (score
    null). Repeated rows: one row each. The score is the model's probability that the URL is to be blocked.
    """
    values, intercept = weights
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    table = F.from_json(F.lit(json.dumps(values)), "array<double>")
    total = F.aggregate(F.array_distinct(buckets(F.col("host"), F.col("path"))), F.lit(intercept),
                        lambda s, b: s + F.element_at(table, (b + 1).cast("int")))
    score = F.when((F.col("host") != "") | (F.col("path") != ""), 1 / (1 + F.exp(-total)))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return rows.withColumn("score", score).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def filter_urls(pages: DataFrame) -> DataFrame:
    """Train on the labelled table, then judge every page."""
    return judge(pages, train(labelled_urls(pages.sparkSession)))
