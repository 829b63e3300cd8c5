"""URL filters (5): host and path rules, then logistic regression on hashed character n-grams.

Native: DataFrame expressions only, training included.  The labelled table is
small by contract (at most MAX_LABELLED rows are fitted); its rows become one
array and gradient descent is one ``aggregate`` over that array, so the fit is
one deterministic row.  The fitted weights (DIMENSIONS doubles, a fixed size)
are read once and stand in the scoring plan as a literal: pages are scored in
one pass without a shuffle or a join.

Defined results: a null url or one without ``://`` has an empty host and path,
fits no rule and is judged by the model on the empty string (its bias); equal
urls are judged alike; extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import let, table

#: (verdict, rule): the host is what stands before the first slash.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
#: The small labelled table: 1 is to be blocked.
LABELLED = [
    ("http://casino-win.example.com/play", 1),
    ("https://www.casino-royal.example.net/bonus", 1),
    ("http://free-bets.example.org/odds", 1),
    ("https://m.free-bets.example.com/en/12", 1),
    ("http://cheap-pills.example.net/order", 1),
    ("https://www.cheap-pills.example.org/fr/3", 1),
    ("http://adult-chat.example.com/live", 1),
    ("https://hot-singles.example.net/chat", 1),
    ("http://payday-loans.example.org/apply", 1),
    ("https://win-cash.example.com/slots", 1),
    ("http://poker-win.example.net/de/77", 1),
    ("https://xxx-video.example.org/free", 1),
    ("http://seo-links.example.com/buy", 1),
    ("https://replica-watch.example.net/cheap", 1),
    ("http://slots-bonus.example.org/win", 1),
    ("https://bets-casino.example.com/free", 1),
    ("http://spam-links.example.com/en/5", 1),
    ("https://link-farm.example.net/de/9", 1),
    ("http://ads-click.example.org/banner", 1),
    ("https://m.track-ads.example.com/fr/2", 1),
    ("http://adult-x.example.net/es/31", 1),
    ("https://www.adult-video.example.org/en/4", 1),
    ("http://www.library.example.org/catalog", 0),
    ("https://news.example.com/world/article", 0),
    ("http://blog.garden.example.net/roses", 0),
    ("https://docs.example.org/manual/intro", 0),
    ("http://www.museum.example.com/visit", 0),
    ("https://school.example.net/courses/maths", 0),
    ("http://weather.example.org/today", 0),
    ("https://m.recipes.example.com/soup", 0),
    ("http://www.thering.example.org/en/1291/", 0),
    ("https://tiontion.example.net/fr/7817", 0),
    ("http://blog.tionsh.example.com/fr/7424.html", 0),
    ("https://therst.example.net/es/4163", 0),
    ("http://m.ththan.example.com/de/7944", 0),
    ("https://www.ouerand.example.org/fr/11", 0),
    ("http://hewhand.example.net/en/502", 0),
    ("http://www.ththnt.example.org/de/9860", 0),
    ("https://ththat.example.com/es/9202/", 0),
    ("https://erthly.example.com/es/88.html", 0),
]
#: Longest labelled table that is fitted (the first rows in order of url), n-gram length, hash space, and the descent.
MAX_LABELLED, GRAM, DIMENSIONS, EPOCHS, RATE, DECAY = 1000, 3, 1024, 100, 0.5, 1e-3
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of equal length the first in order of its text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def gram_slots(text: Column) -> Column:
    """Slots of all character n-grams of the text between two end marks; a slot may repeat."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))
    count = F.greatest(F.length(framed) - (GRAM - 1), F.lit(1))

    def slot(s):
        return lambda i: F.conv(F.substr(F.md5(F.substr(s, i, F.lit(GRAM))), F.lit(1), F.lit(6)), 16, 10).cast(
            "int"
        ) % F.lit(DIMENSIONS)

    return let(framed, lambda s: F.transform(F.sequence(F.lit(1), count), slot(s)))


def _score(slots: Column, weights: Column) -> Column:
    total = F.aggregate(slots, F.lit(0.0), lambda a, f: a + F.get(weights, f))
    return total / F.sqrt(F.size(slots)) + F.get(weights, F.lit(DIMENSIONS))


def fit(spark: SparkSession, labelled: DataFrame | None = None) -> list[float]:
    """Weights of the slots and, last, the bias; a fit of no rows gives zeros."""
    if labelled is None:
        labelled = spark.createDataFrame(LABELLED, "url string, label int")
    rows = labelled.orderBy("url", "label").limit(MAX_LABELLED)
    slots = gram_slots(F.concat(host_of(F.col("url")), path_of(F.col("url"))))
    rows = rows.select("url", F.col("label").cast("double").alias("y"), slots.alias("s"))
    # each row's n-gram counts over the root of their number; the last entry stands for the bias
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(DIMENSIONS)),
        lambda d: F.when(d == DIMENSIONS, F.lit(1.0)).otherwise(
            F.size(F.filter(F.col("s"), lambda f: f == d)).cast("double") / F.sqrt(F.size("s"))
        ),
    )
    rows = rows.select("url", "y", dense.alias("x"))
    data = rows.agg(F.array_sort(F.collect_list(F.struct("url", "y", "x"))).alias("data"))

    def one_row(w, r):
        z = F.aggregate(F.zip_with(w, r["x"], lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        step = F.lit(RATE) * (r["y"] - 1 / (1 + F.exp(-z)))
        return let(step, lambda g: F.zip_with(w, r["x"], lambda a, b: a * F.lit(1 - RATE * DECAY) + g * b))

    start = F.array_repeat(F.lit(0.0), DIMENSIONS + 1)
    epochs = F.aggregate(
        F.sequence(F.lit(1), F.lit(EPOCHS)),
        start,
        lambda w, _: F.aggregate(F.col("data"), w, one_row),
    )
    return list(data.select(epochs.alias("w")).first()["w"])


def url_filter(spark: SparkSession, pages: DataFrame, weights: list[float] | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict, one row a page."""
    model = F.lit(weights if weights is not None else fit(spark)).cast("array<double>")
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    z = let(gram_slots(F.concat("host", "path")), lambda s: _score(s, model))
    learned = F.when(1 / (1 + F.exp(-z)) >= THRESHOLD, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark, table(spark, sf_dir, "pages"))
