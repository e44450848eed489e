"""Judging urls: rules of hosts and paths first, and where none fits, naive Bayes over the
words of host and path.

Concatenated names of hosts ("freebets") are split by a unigram Viterbi whose counts come
from the words of all pages.  The multinomial naive Bayes counts the tokens of all urls; a url
teaches `block` where one of its words is listed as unwanted, and `allow` otherwise, so the
classes spread to the words that keep company with listed ones.  Tokens fall into `BUCKETS`
hashed buckets, so the model that is broadcast has one size whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import stage

#: (host, path, verdict): a rule fits its host and all subdomains where the path begins with
#: the rule's.  A list of this kind is a parameter, not a table.
Rule = tuple[str, str, str]
#: Words that mark a url as unwanted.
UNWANTED = (
    "adult", "porn", "sex", "xxx", "nude", "escort", "casino", "poker", "slots", "gambling", "bet", "bets", "betting", "jackpot", "lottery",
    "pills", "pharmacy", "viagra", "cialis", "spam", "ads", "adserver", "popunder", "warez", "keygen", "torrent", "payday", "malware", "phishing",
)
#: Share of all words that a listed word has at least in the unigram model.
LISTED_SHARE = 1e-5
#: Letters of a word of the unigram model at most; what is longer is one unknown word.
WORD_LETTERS = 24
#: Words of so few letters are in many names: their rows are dealt to `SALTS` keys.
SHORT, SALTS = 3, 16
#: Buckets of hashed tokens, and the count that each has beforehand.
BUCKETS = 1 << 18
ALPHA = 0.1
#: Hosts are broadcast up to so many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 16_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKUP = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;"


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the column `url`; both empty where it is null or has no ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def names_of(host: Column) -> Column:
    """The runs of letters of a host without its last label."""
    body = F.when(F.instr(host, ".") > 0, F.regexp_extract(host, r"(?s)^(.*)\.", 1)).otherwise(host)
    return F.filter(F.split(F.lower(body), r"\P{L}+"), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    """The runs of letters of a path, and # for each run of digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(path), r"\d+", "/#/"), r"[^\p{L}#]+"), lambda x: x != "")


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n) over the text of all pages, markup aside."""
    words = F.split(F.regexp_replace(F.lower("html"), MARKUP, " "), r"\P{L}+")
    return pages.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def split_name(name: str, known: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The words of `name` of greatest probability.  `known` has log-probabilities by start
    and end; an unknown word of l letters has `unknown` less l * log(10).  Of equal splits the
    one whose last words are longest."""
    best, came = [0.0] + [-math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        starts = range(max(0, end - WORD_LETTERS), end)
        for start in (0, *starts) if starts[0] else starts:
            p = best[start] + known.get((start, end), unknown - (end - start) * math.log(10))
            if p > best[end]:
                best[end], came[end] = p, start
    words, end = [], len(name)
    while end:
        words.append(name[came[end] : end])
        end = came[end]
    return words[::-1]


def host_words(hosts: DataFrame, counts: DataFrame, unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """(host, words) of each of the distinct `hosts`: its names split by the unigram model of
    `counts`, and its last label whole.

    Each part of a name meets the counts in a join, so the vocabulary may have any size.
    """
    total = max(1, counts.agg(F.sum("n")).first()[0] or 0)
    unknown = math.log(10.0 / total)
    named = hosts.select("host", F.posexplode(names_of(F.col("host"))).alias("k", "name"))
    begun = named.select("host", "k", "name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("s"))
    until = F.least(F.lit(WORD_LETTERS), F.length("name") - F.col("s") + 1)
    spans = begun.select("host", "k", "s", "name", F.explode(F.sequence(F.lit(1), until)).alias("l"))
    spans = spans.select("host", "k", "s", "l", F.expr("substring(name, s, l)").alias("word"))
    salt = lambda x: F.when(F.length("word") <= SHORT, x).otherwise(F.lit(0))
    spans = spans.withColumn("salt", salt(F.pmod(F.xxhash64("host", "k", "s"), F.lit(SALTS)).cast("int")))
    listed = counts.sparkSession.createDataFrame([(w.lower(), max(1, math.ceil(LISTED_SHARE * total))) for w in dict.fromkeys(unwanted)], "word string, n long")
    model = counts.filter(F.length("word") <= WORD_LETTERS).unionByName(listed).groupBy("word").agg(F.max("n").alias("n"))
    salts = F.when(F.length("word") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    met = spans.join(model.withColumn("salt", F.explode(salts)), ["word", "salt"])
    known = met.groupBy("host").agg(F.collect_list(F.struct("k", "s", "l", F.log(F.col("n") / total).alias("p"))).alias("known"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def segmented(names: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(names, known):
            by_name: dict[int, dict[tuple[int, int], float]] = {}
            for x in found if found is not None else ():
                by_name.setdefault(x["k"], {})[x["s"] - 1, x["s"] - 1 + x["l"]] = x["p"]
            out.append([w for k, name in enumerate(own) for w in split_name(name, by_name.get(k, {}), unknown)])
        return pd.Series(out)

    last = F.when(F.instr("host", ".") > 0, F.array(F.substring_index("host", ".", -1))).otherwise(F.array().cast("array<string>"))
    both = hosts.join(known, "host", "left")
    return both.select("host", F.concat(segmented(names_of(F.col("host")), "known"), F.filter(last, lambda x: x != "")).alias("words"))


def host_rules(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, rules) of the `hosts` that some rule fits, the longest rule first."""
    table = hosts.sparkSession.createDataFrame([(h.lower(), p, v, h + p) for h, p, v in rules], "rule_host string, rule_path string, verdict string, rule string")
    ends = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(ends)), lambda k: F.array_join(F.slice(ends, k, F.size(ends)), "."))
    fits = hosts.select("host", F.explode(ends).alias("rule_host")).join(F.broadcast(table), "rule_host")
    own = F.struct(F.length("rule").alias("long"), "rule", "rule_path", "verdict")
    return fits.groupBy("host").agg(F.sort_array(F.collect_list(own), asc=False).alias("rules"))


def _with_hosts(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """`urls` with the columns of their host: a broadcast up to `BROADCAST_BYTES`, else a join
    that deals each host's urls to `SALTS` keys."""
    size = hosts.agg(F.sum(F.length("host") * 2 + F.size("words") * 24 + F.when(F.col("rules").isNull(), 0).otherwise(F.size("rules") * 96) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return urls.join(F.broadcast(hosts), "host", "left")
    urls = urls.withColumn("salt", F.pmod(F.xxhash64("url__rid"), F.lit(SALTS)).cast("int"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return urls.join(hosts, ["host", "salt"], "left").drop("salt")


def fit(urls: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratios of block over allow by bucket, and that of the classes, from `buckets` and
    `unwanted` of all rows of `urls`.  The driver gets at most `BUCKETS` rows."""
    marked = F.col("unwanted").cast("long")
    rows = urls.select(F.explode("buckets").alias("bucket"), marked.alias("block")).groupBy("bucket")
    rows = rows.agg(F.sum("block").alias("block"), F.count(F.lit(1)).alias("n")).toArrow()
    n_block, n = urls.agg(F.sum(marked), F.count(F.lit(1))).first()
    block, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy()
    block[at], every[at] = rows["block"].to_numpy(), rows["n"].to_numpy()
    met, allow = max(1, len(at)), every - block
    ratios = np.log((block + ALPHA) / (block.sum() + ALPHA * met)) - np.log((allow + ALPHA) / (allow.sum() + ALPHA * met))
    ratios[every == 0] = 0.0
    return ratios, math.log(((n_block or 0) + 1) / ((n or 0) - (n_block or 0) + 1))


def judge(pages: DataFrame, rules: Sequence[Rule] = (), unwanted: Sequence[str] = UNWANTED) -> DataFrame:
    """page_id, host, path, rule, verdict, words (of the host), score of every row of `pages`.

    `score` is the log of block over allow by naive Bayes; over 0 the verdict is block, unless a
    rule fits: the longest one decides, and of equal ones the last by text.  Null url, or one
    without ://: empty host and path, no words, verdict of the classes' shares.  Null html: no
    words for the unigram model.  Repeated rows and ids are judged alike; an empty table gives no rows.
    Only page_id, url and html are read, whatever other columns are called.
    """
    spark = pages.sparkSession
    host, path = parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("url__rid"))
    hosts = stage(urls.select("host").distinct(), "hosts")
    counts = stage(word_counts(pages), "words")
    about = host_words(hosts, counts, unwanted).join(host_rules(hosts, rules), "host", "left") if rules else host_words(hosts, counts, unwanted).withColumn("rules", F.lit(None))
    about = stage(about.select("host", "words", F.col("rules").cast("array<struct<long:int,rule:string,rule_path:string,verdict:string>>")), "hosts")
    tokens = F.concat("words", path_tokens(F.col("path")))
    fitting = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    seen = _with_hosts(urls, about).select(
        "page_id", "host", "path", "words", fitting.alias("rule"),
        F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")).alias("buckets"),
        F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in unwanted]).cast("array<string>")).alias("unwanted"),
    )
    seen = stage(seen, "urls")
    ratios, prior = fit(seen)
    shared = spark.sparkContext.broadcast(ratios)

    @F.pandas_udf(T.DoubleType())
    def score(buckets: pd.Series) -> pd.Series:
        return pd.Series([prior + math.fsum(shared.value[b]) for b in buckets], dtype="float64")

    made = seen.withColumn("score", score("buckets"))
    by_method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return made.select("page_id", "host", "path", F.col("rule.rule").alias("rule"), F.coalesce(F.col("rule.verdict"), by_method).alias("verdict"), "words", "score")
