"""URL filter: rules first, then logistic regression on hashed character n-grams.

The model is trained from a small table of labelled URLs, in DataFrame functions alone:
the n-grams of host and path are hashed into ``DIMENSIONS`` buckets, and the weights are
an array that a fold over the training rows updates by stochastic gradient steps. Table
and weights have a fixed size, so the one-row model may be broadcast.

Defined cases: a null url, and one without ``://``, has an empty host and path and no
rule; the model judges it by the n-grams of the empty frame. Repeated rows are judged
alike; an empty table gives an empty result; urls of any length are judged whole; other
columns are not carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS, GRAM, EPOCHS, RATE, DECAY = 1024, 4, 12, 0.5, 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Host and path prefix, then the verdict; the longest rule that fits wins.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Labelled URLs (1: block), hand-written.
LABELLED = (
    ("https://docs.example.org/guide/install", 0), ("https://www.university.edu/library/catalogue", 0), ("https://en.encyclopedia.org/wiki/River", 0),
    ("https://news.example.com/en/2021/05/local-elections", 0), ("https://blog.example.org/en/gardening-tips", 0), ("https://museum.example.org/de/ausstellung", 0),
    ("https://www.city.gov/services/water", 0), ("https://recipes.example.com/fr/soupe-aux-legumes", 0), ("https://journal.science.org/articles/1044", 0),
    ("https://m.weather.example.com/en/forecast", 0), ("https://www.example.com/fr/histoire", 0), ("https://forum.example.org/en/thread/8812", 0),
    ("https://library.example.edu/es/libros", 0), ("https://www.health.gov/advice/sleep", 0), ("https://school.example.org/es/matematicas", 0),
    ("https://code.example.com/en/tutorial/loops", 0), ("https://www.travel.example.com/es/ciudades", 0), ("https://history.example.edu/en/empires", 0),
    ("https://www.parliament.gov/bills/772", 0), ("https://poetry.example.org/fr/recueil", 0), ("https://maps.example.com/en/trails", 0),
    ("https://research.institute.edu/papers/99", 0), ("https://www.example.org/de/sprache", 0), ("https://help.example.com/en/account", 0),
    ("http://casino-bonus.example.biz/free-spins", 1), ("http://win-jackpot.example.info/slots?ref=1", 1), ("http://cheap-pills.example.biz/viagra", 1),
    ("http://xxx-videos.example.tv/watch/123", 1), ("http://adult-chat.example.biz/live", 1), ("http://free-download-crack.example.ru/keygen", 1),
    ("http://torrent-warez.example.cc/full-movie", 1), ("http://click-ads.example.biz/track?id=7", 1), ("http://loan-fast-cash.example.info/apply-now", 1),
    ("http://replica-watches.example.biz/buy-cheap", 1), ("http://hot-singles.example.info/dating", 1), ("http://bet-poker.example.biz/bonus", 1),
    ("http://miracle-diet.example.info/lose-weight-now", 1), ("http://spam-links.example.cc/page/1", 1), ("http://adserver.example.biz/banner/728", 1),
    ("http://porn-tube.example.tv/xxx", 1), ("http://make-money-fast.example.info/crypto-bonus", 1), ("http://casino-slots.example.cc/win-big", 1),
    ("http://buy-followers.example.biz/cheap", 1), ("http://phishing-login.example.ru/verify-account", 1), ("http://free-gift-card.example.info/claim-prize", 1),
    ("http://pills-pharmacy.example.ru/no-prescription", 1), ("http://sex-cams.example.tv/free", 1), ("http://malware-update.example.cc/flash-player.exe", 1),
)


def split_url(url) -> tuple["F.Column", "F.Column"]:
    """Host (A-Z lower-cased) and path of a url column, without query and fragment."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host, path, rules=RULES) -> tuple["F.Column", "F.Column"]:
    """The longest rule that fits (null if none) and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _bucket(kind: str, framed, dimensions: int):
    return lambda i: F.pmod(F.xxhash64(F.concat(F.lit(kind), F.substr(framed, i, F.lit(GRAM)))), F.lit(dimensions)).cast("int")


def features(host, path, dimensions: int = DIMENSIONS) -> "F.Column":
    """Buckets of the character n-grams of host and path, each once, sorted."""
    grams = []
    for kind, part in (("h", host), ("p", path)):
        framed = F.concat(F.lit("^"), part, F.lit("$"))
        at = F.sequence(F.lit(1), F.greatest(F.length(framed) - (GRAM - 1), F.lit(1)))
        grams.append(F.transform(at, _bucket(kind, framed, dimensions)))
    return F.array_sort(F.array_distinct(F.concat(*grams)))


def _margin(weights, buckets) -> "F.Column":
    scale = F.sqrt(F.size(buckets).cast("double"))
    return F.element_at(weights, 1) + F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.element_at(weights, b + 2)) / scale


def _sigmoid(x) -> "F.Column":
    return 1 / (1 + F.exp(-x))


def train(spark: SparkSession, labelled=LABELLED, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, rate: float = RATE) -> DataFrame:
    """One row with ``weights`` (bias first), by gradient steps over the labelled URLs in order of a hash."""
    table = spark.createDataFrame([(u, float(y)) for u, y in labelled], "url string, y double")
    host, path = split_url(F.col("url"))
    rows = table.select(F.xxhash64("url").alias("h"), features(host, path, dimensions).alias("x"), "y")
    steps = rows.agg(F.array_sort(F.collect_list(F.struct("h", "x", "y"))).alias("rows")).select(F.flatten(F.array_repeat("rows", epochs)).alias("steps"))

    def step(weights, row):
        x = row.getField("x")
        pull = (row.getField("y") - _sigmoid(_margin(weights, x))) * F.lit(rate)
        part = pull / F.sqrt(F.size(x).cast("double"))
        return F.transform(weights, lambda w, i: w * F.lit(1 - DECAY) + F.when(i == 0, pull * 0.1).when(F.array_contains(x, i.cast("int") - 1), part).otherwise(F.lit(0.0)))

    return steps.select(F.aggregate("steps", F.array_repeat(F.lit(0.0), dimensions + 1), step).alias("weights"))


def judge_urls(pages: DataFrame, labelled=LABELLED, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row of pages: page_id, host, path, rule, verdict, score (the model's probability of block)."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    weights = [float(w) for w in train(spark, labelled).first()["weights"]]  # a fixed number of weights
    learned = F.lit(weights) if len(weights) < 2 else F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    scored = parts.withColumn("score", _sigmoid(_margin(learned, features(F.col("host"), F.col("path")))))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
