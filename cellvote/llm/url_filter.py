"""URL filters: prefix rules, and logistic regression on hashed character n-grams for the rest.

The n-grams (3 to 5 characters) of host and path are hashed into a fixed number
of buckets; a URL's features are the buckets that occur in it, each with weight
one over the root of their number.  A regression trained on a small labelled
table gives a weight per bucket; scoring looks the weights up in an array of that
fixed size inside the row.  Training and scoring are DataFrame functions.

Digits are folded to `0`, as page numbers say nothing, and only the path's
directories and extension are read.

Defined results: a null URL, or one without `://`, has an empty host and path,
matches no rule and is allowed; rows are judged one by one; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellvote.llm.common import lower_ascii

BUCKETS = 16_384
SIZES = (3, 4, 5)

# The labelled table is made by a rule from words.  Both labels get the same wrappers, partners, ends and paths, so
# that only the words tell them apart.
SPAM_WORDS = """
casino slots poker roulette jackpot blackjack bingo lottery bet bets betting odds gamble gambling pills viagra cialis meds
pharma pharmacy weightloss steroids porn porno xxx sex sexy adult nude cams escort hookup ads advert adserver adclick banner
popup popunder clicks clicktrack tracker pixel spam spammy linkfarm backlinks payday loans quickcash lotto prize winner
replica counterfeit crack keygen warez torrent malware phish verify-login free-gift
""".split()
PLAIN_WORDS = """
news weather history science museum library garden kitchen recipes bread travel hotel maps city council school university
research math physics music albums concert film cinema theatre sports football tennis chess cycling hiking mountain river
forest birds animals dogs horses farm farmers field track tracks trail road train station harbour bank branch market shop
store books reading poetry essay letters archive records photo gallery art design house home family children health doctor
hospital sleep yoga law court justice tax office work jobs career code software python linux project docs manual guide help
forum blog wiki data open energy solar water winter window free cheap flights tickets freedom address head heads roads badge
bread-house open-data car-repair self-help long-reads day-trips how-to well-known sussex essex middlesex analysis pillar
pillow beta better alphabet abbey camera campus crackers documents pixels spanish classic passage title shuttle
""".split()
PARTNERS = "best online top club zone live shop now room world hub star royal mega direct plus".split()
ENDS = "com org net test info io example.com example.org example.net".split()
WRAPS = ("", "www.", "m.", "blog.")
PATHS = ("/", "/en/1", "/de/2", "/fr/3.html", "/es/4", "/index.html", "/page/5", "/a/b/6")
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ing ion ly ble".split()
MADE_UP = 240  # allowed names without meaning


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules (verdict, host, path).
RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule] = RULES) -> Column:
    """STRUCT<rule, verdict> of the longest rule that fits, nulls if none does."""
    chosen = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        mine = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, mine).otherwise(chosen)
    return chosen


def grams(host: Column, path: Column) -> Column:
    """ARRAY<INT>: distinct buckets of the character n-grams of host and path."""
    folded = F.regexp_replace(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "[0-9]+", "0")
    parts = []
    for n in SIZES:
        starts = F.sequence(F.lit(1), F.length("__u") - n + 1)
        each = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substr("__u", i, F.lit(n))), F.lit(BUCKETS)).cast("int"))
        parts.append(F.when(F.length("__u") >= n, each).otherwise(F.array().cast("array<int>")))
    return folded, F.array_distinct(F.concat(*parts))


def with_grams(rows: DataFrame) -> DataFrame:
    folded, buckets = grams(F.col("host"), F.col("path"))
    return rows.withColumn("__u", folded).withColumn("grams", buckets).drop("__u")


@dataclass(frozen=True)
class Model:
    weights: list[float]
    intercept: float

    def score(self, buckets: Column) -> Column:
        """DOUBLE above 0 for what is to be blocked."""
        table = F.from_json(F.lit(str(self.weights)), "array<double>")
        total = F.aggregate(buckets, F.lit(0.0), lambda s, b: s + F.get(table, b))
        return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1))) + F.lit(self.intercept)


def _drawn(key: str, choices):
    """One of the choices, the same for a key wherever it is asked."""
    return choices[crc32(key.encode()) % len(choices)]


def _hosts(word: str) -> list[str]:
    """A word alone and with neutral partners, before and after, with and without a hyphen."""
    names = [word]
    for i, pattern in enumerate(("{w}-{p}", "{p}-{w}", "{w}{p}", "{p}{w}")):
        names.append(pattern.format(w=word, p=_drawn(f"{word} {i}", PARTNERS)))
    return names


def _mixed(word: str) -> list[str]:
    """A word to block beside plain ones: it decides for the whole name."""
    drawn = [_drawn(f"{word} plain {i}", PLAIN_WORDS) for i in range(6)]
    return [f"{word}-{plain}" if i % 2 else f"{plain}-{word}" for i, plain in enumerate(drawn)]


def labelled_urls() -> list[tuple[str, float]]:
    """url, label: 1 is to be blocked, 0 allowed."""
    made_up = ["".join(_drawn(f"made up {i} {j}", SYLLABLES) for j in range(2 + i % 3)) for i in range(MADE_UP)]
    names = [(name, 1.0) for word in SPAM_WORDS for name in _hosts(word) + _mixed(word)]
    names += [(name, 0.0) for word in PLAIN_WORDS for name in _hosts(word)] + [(name, 0.0) for name in made_up]
    urls = []
    for name, label in names:
        wrap, end, path = (_drawn(f"{kind} {name}", choices) for kind, choices in enumerate((WRAPS, ENDS, PATHS)))
        urls.append((f"http://{wrap}{name}.{end}{path}", label))
    # words of either kind as a directory, below a name without meaning
    for i, (word, label) in enumerate([(w, 1.0) for w in SPAM_WORDS] + [(w, 0.0) for w in PLAIN_WORDS]):
        urls.append((f"http://{made_up[i % MADE_UP]}.{ENDS[i % len(ENDS)]}/{word}/{i}", label))
    return sorted(set(urls))


def labelled(spark: SparkSession) -> DataFrame:
    """url, label of the small table above."""
    rows = json.dumps([{"url": url, "label": label} for url, label in labelled_urls()])
    schema = "array<struct<url:string,label:double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), schema)))  # no Python worker takes part


def train(table: DataFrame, penalty: float = 0.00001) -> Model:
    """Fits the weights on a small labelled table (url, label); both labels weigh the same as a whole."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel, Normalizer

    rows = with_grams(table.select("label", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    rows = rows.select("label", F.transform("grams", lambda b: b.cast("string")).alias("names")).coalesce(1)
    counts = {row.label: row["count"] for row in rows.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, 0.5 / counts.get(1.0, 1)).otherwise(0.5 / counts.get(0.0, 1))
    weighed = rows.withColumn("share", share * sum(counts.values()))
    names = [str(b) for b in range(BUCKETS)]
    ones = CountVectorizerModel.from_vocabulary(names, inputCol="names", outputCol="ones", minTF=1.0).setBinary(True)
    unit = Normalizer(inputCol="ones", outputCol="features").transform(ones.transform(weighed))
    regression = LogisticRegression(regParam=penalty, maxIter=100, standardization=False, weightCol="share")
    fit = regression.fit(unit.select("label", "share", "features"))
    return Model([round(float(w), 6) for w in fit.coefficients.toArray()], round(float(fit.intercept), 6))


def judge(pages: DataFrame, model: Model, rules: list[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = with_grams(rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)))
    blocked = (F.col("host") != "") & (model.score(F.col("grams")) > 0)
    verdict = F.coalesce(F.col("hit.verdict"), F.when(blocked, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
