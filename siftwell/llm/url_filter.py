"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The regression is trained from a small labelled table of URLs; a URL's host and path are cut into
character n-grams (marked ``h`` and ``p``, with start and end marks), hashed to a fixed number of
features, and scored. Everything is DataFrame functions and the DataFrame-based ML library.

Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: from there up to ``? #`` or the
end. A null URL, or one without ``://``, has an empty host and path and gets the method's verdict on
those. A rule holds for its host and all subdomains where the path starts with the rule's; of the
rules that hold, the longest decides. Repeated rows are judged alike. A URL of any length is judged whole; its n-grams are one array.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
SIZES = (3, 4)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def text(self) -> str:
        return self.host + self.path


# The default labelled table is made by a rule from these words, all invented combinations.
_JUNK = (
    "casino", "poker", "bets", "slots", "lottery", "pills", "viagra", "meds", "adult", "xxx", "porn", "cams", "dating", "ads", "adserver", "banner",
    "tracker", "clicks", "popup", "spam", "linkfarm", "seo", "loans", "payday", "replica", "torrent", "warez", "keygen", "followers", "jackpot",
)
_LURES = ("free", "best", "online", "win", "cheap", "hot", "top", "fast", "shop", "club", "zone", "hub", "now", "x", "farm", "track")
_PLAIN = (
    "library", "museum", "school", "garden", "recipes", "weather", "journal", "radio", "council", "travel", "forum", "code", "docs", "wiki", "health", "science",
    "music", "history", "maths", "planet", "river", "bakery", "theatre", "hospital", "university", "archive", "gazette", "atlas", "orchard", "harbour",
)
_PLACES = ("old", "open", "city", "north", "new", "public", "daily", "town")
_SYLLABLES = ("lor", "mar", "vel", "sta", "den", "kin", "bro", "wes", "pal", "tur", "ther", "tion", "ing", "han", "rel", "ston", "ble", "sho", "wil", "ond")
#: Hosts of the supplied tables are no part of the labelled table: verdicts on them are not learned by heart.
_LEFT_OUT = ("free-bets", "casino-win", "cheap-pills", "adult-x", "spam-farm", "ads-track")


def labelled_table(spark: SparkSession, rows: int = 3600) -> DataFrame:
    """The default training data: number, url, label (1 blocks), junk and plain (the word of these lists in the name, or null), a third of them to block.

    Made by a rule in Spark. Of the names to block, and of those with a place, two thirds pair a listed word with another one or with an invented word, so that either
    part of a name tells by itself and verdicts carry over to words that are not listed.
    """
    n = F.col("number")
    pick = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at % len(words) + 1).cast("int"))
    of = lambda size: F.floor(n / size)
    invented = lambda at: F.concat(pick(_SYLLABLES, at), pick(_SYLLABLES, F.floor(at / 20) * 3 + at * 7), F.when(at % 4 == 0, pick(_SYLLABLES, at + 7)).otherwise(""))
    kind = of(18) % 3  # of the first and second part: both listed, only the second, only the first
    junk, plain = F.when(kind != 2, pick(_JUNK, of(3))), F.when(kind != 2, pick(_PLAIN, of(6)))
    lure, place = F.when(kind != 1, pick(_LURES, of(3) * 7 + of(90))), F.when(kind != 1, pick(_PLACES, of(6) + of(180)))
    other = invented(of(3) + 11)
    pair = lambda a, b: F.concat(F.coalesce(a, other), F.lit("-"), F.coalesce(b, other))
    made = F.concat(pick(_SYLLABLES, n), pick(_SYLLABLES, of(20) * 3 + n), F.when(n % 4 == 0, pick(_SYLLABLES, n + 7)).otherwise(""))
    placed = of(6) % 2 == 0
    name = (
        F.when(n % 3 == 0, F.when(of(3) % 2 == 0, pair(lure, junk)).otherwise(pair(junk, lure)))
        .when(n % 3 == 1, F.when(placed, pair(place, plain)).otherwise(pick(_PLAIN, of(6)))).otherwise(made)
    )
    host = F.concat(pick(("", "www.", "m.", "blog."), of(5)), F.col("name"), F.lit(".example."), pick(("com", "org", "net"), of(2) + of(7)))
    path = F.concat(F.lit("/"), pick(("en", "fr", "de", "es"), n + of(11)), F.lit("/"), F.pmod(F.xxhash64("number"), F.lit(10_000)).cast("string"), pick(("", "/", ".html"), of(4)))
    listed = {"junk": F.when(n % 3 == 0, junk), "plain": F.when(n % 3 == 1, F.when(placed, plain).otherwise(pick(_PLAIN, of(6))))}
    named = spark.range(rows).withColumnRenamed("id", "number").withColumn("name", name).where(~F.col("name").isin(*_LEFT_OUT))
    return named.select("number", F.concat(F.lit("https://"), host, path).alias("url"), (n % 3 == 0).cast("int").alias("label"), *(c.alias(k) for k, c in listed.items()))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The deciding rule as ``struct(rule, verdict)``, null where none holds; the rules are a small list."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    holds = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return reduce(lambda rest, r: F.when(holds(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(rest), reversed(ordered), none)


def _cuts(mark: str, whole: Column, n: int) -> Column:
    last = F.length(whole) - F.lit(n - 1)
    cuts = F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(whole, i, F.lit(n))))
    return F.when(last >= 1, cuts).otherwise(F.array().cast("array<string>"))


def ngrams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """The character n-grams of a URL as an array of strings."""
    parts = []
    for mark, text in (("h", host), ("p", path)):
        whole = F.concat(F.lit("^"), text, F.lit("$"))
        for n in sizes:
            parts.append(_cuts(mark, whole, n))
    return F.concat(*parts)


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def train(spark: SparkSession, labelled: DataFrame | None = None, reg: float = 0.002) -> LogisticRegressionModel:
    """Fit the regression on a small table of (url, label); label 1 blocks."""
    table = labelled_table(spark) if labelled is None else labelled
    rows = table.select(ngrams(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"), F.col("label").cast("double").alias("label"))
    return LogisticRegression(maxIter=50, regParam=reg, standardization=False).fit(_vectors(rows.coalesce(1)))


def judge(pages: DataFrame, rules: Sequence[Rule], model: LogisticRegressionModel, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's score, a row per input row."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    grams = _vectors(rows.withColumn("grams", ngrams(F.col("host"), F.col("path"))))
    scored = model.transform(grams).select("page_id", "host", "path", F.element_at(vector_to_array("probability"), 2).alias("score"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], method).alias("verdict"), "score")
