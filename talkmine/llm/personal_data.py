"""Personal data by weak supervision: voting labelers, expectation-maximisation, a
final span classifier.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage, texts

#: Kinds in the order in which spans of one start are listed; the first four are base.
KINDS = ("email", "ip", "card", "phone", "secret", "account")
BASE = 4
#: Patterns, written so that a scan is linear in the text and no match is deep.  They
#: find what the plain ones find: a run is entered at its begin or where the last match
#: ended, and card runs of fewer than 14 or more than 19 digits are passed over whole.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9])[A-Fa-f0-9]{32,64}+(?![A-Za-z0-9])"
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Gazetteers, fixed values: ends of mail domains, heads of card numbers by issuer, dialling
#: codes, and address blocks that no person has.
MAIL_ENDS = r"(?i)\.(?:com|org|net|edu|gov|int|info|biz|io|co|me|dev|app|eu|de|at|ch|fr|be|es|pt|it|nl|uk|ie|pl|cz|se|no|dk|fi|ru|us|ca|mx|br|ar|cl|cn|jp|kr|in|au|nz|za)$"
CARD_HEADS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|35(?:2[89]|[3-8])|6(?:011|22|4[4-9]|5)|62|50|5[6-9]|67)"
DIALLING = r"^\+(?:1|7|2[07]|21[0-9]|2[2-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])"
NOBODYS = r"^0*(?:0|127|22[4-9]|2[34][0-9]|25[0-5])\."
#: Words before a span that speak for and against it.
SPEAKS_FOR = r"(?i)(?:token|secret|password|passwd|key|auth|bearer|mail|phone|tel|call|card|account|konto|iban|ip|addr)[a-z]*[\x20\x09]*[:=]?[\x20\x09]*[\"']?$"
SPEAKS_AGAINST = r"(?i)(?:version|release|section|commit|revision|license|licence|isbn|page|chapter)[\x20\x09.:#]*$"
CONTEXT = 24
LABELERS = ("format", "gazetteer", "before_for", "before_against", "left", "right", "length", "variety")
#: Spans of all kinds together count as so many of a kind when its reliabilities are fitted.
SHARED = 8
ROUNDS = 8
ACCEPT = 0.5
_RUN = 128


def _prefix_sums(lengths: Column) -> Column:
    """Sum of the elements before each one, by runs so that long arrays stay cheap."""
    runs = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int"))
    part = lambda b: F.slice(lengths, b * _RUN + 1, F.lit(_RUN))
    grow = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    zero = F.array(F.lit(0))
    base = F.aggregate(F.transform(runs, lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x)), zero, grow)
    inner = F.transform(runs, lambda b: F.transform(F.slice(F.aggregate(part(b), zero, grow), F.lit(1), F.size(part(b))), lambda x: x + F.get(base, b)))
    return F.flatten(inner)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(s)), ""), lambda d: F.try_to_number(d, F.lit("9")).cast("int"))
    each = F.transform(F.filter(digits, lambda d: d.isNotNull()), lambda d, k: F.when(k % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _spans(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add array `name` of (start, end, word) of all matches, in code points.

    The gaps between matches and the matches give the places by running sums.
    """
    hits, gaps = f"{name}__hits", f"{name}__gaps"
    df = df.withColumn(hits, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.transform(F.split("text", pattern, -1), lambda g: F.length(g))))
    sums = f"{name}__sums"
    df = df.withColumn(sums, F.when(F.size(hits) > 0, _prefix_sums(F.transform(hits, lambda h, k: F.length(h) + F.get(gaps, k)))))
    place = lambda h, k: F.struct(
        (F.get(sums, k) + F.get(gaps, k)).alias("start"), (F.get(sums, k) + F.get(gaps, k) + F.length(h)).alias("end"), h.alias("word")
    )
    none = F.array().cast("array<struct<start:int,end:int,word:string>>")
    return df.withColumn(name, F.coalesce(F.when(F.size(hits) > 0, F.transform(hits, place)), none)).drop(hits, gaps, sums)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and `found`: every candidate span with its kind, whether it is base, the
    labelers' votes (1 for, -1 against, 0 abstains) and the features of the classifier."""
    df = texts(docs)
    for name, pattern in (("email", EMAIL), ("ip", IP), ("run", CARD), ("phone", PHONE), ("secret", SECRET)):
        df = _spans(df, name, pattern)
    number = lambda s: F.length(_digits(s))
    mixed = lambda s: s.rlike("[0-9]") & s.rlike("[A-Fa-f]")
    checks = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
        "run": _luhn,
        "phone": lambda s: number(s).between(10, 15),
        "secret": mixed,
    }
    listed_ = {  # (for, against)
        "email": lambda s: (s.rlike(MAIL_ENDS), F.lit(False)),
        "ip": lambda s: (F.lit(False), s.rlike(NOBODYS)),
        "run": lambda s: (_digits(s).rlike(CARD_HEADS), ~_digits(s).rlike(CARD_HEADS)),
        "phone": lambda s: (F.concat(F.lit("+"), _digits(s)).rlike(DIALLING), ~F.concat(F.lit("+"), _digits(s)).rlike(DIALLING)),
        "secret": lambda s: (F.lit(False), F.lit(False)),
    }
    standard = {
        "email": lambda s: F.length(s).between(6, 64),
        "ip": lambda s: F.length(s).between(7, 15),
        "run": lambda s: number(s) == 16,
        "phone": lambda s: number(s).between(10, 12),
        "secret": lambda s: F.length(s).isin(32, 40, 64),
    }
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    kinds = {"email": (0, 0), "ip": (1, 1), "run": (2, 5), "phone": (3, 3), "secret": (4, 4)}

    def described(name: str) -> Column:
        yes, no = kinds[name]

        def one(x: Column) -> Column:
            ok = checks[name](x["word"])
            return F.struct(
                x["start"].alias("start"), F.when(ok, yes).otherwise(no).alias("kind"), x["end"].alias("end"), ok.alias("ok"),
                standard[name](x["word"]).alias("standard"), vote(*listed_[name](x["word"])).alias("listed"),
                F.size(F.array_distinct(F.split(x["word"], ""))).alias("variety"),
                F.substr("text", F.greatest(F.lit(1), x["start"] - CONTEXT + 1), F.least(x["start"], F.lit(CONTEXT))).alias("before"),
                F.substr("text", x["end"] + 1, F.lit(1)).alias("after"),
            )

        return F.transform(name, one)

    df = df.select("doc_id", F.concat(*[described(n) for n in kinds]).alias("found"))

    def voted(x: Column) -> Column:
        left, right = F.right(x["before"], F.lit(1)), x["after"]
        votes = [
            F.when(x["ok"], 1).otherwise(-1),
            x["listed"],
            vote(x["before"].rlike(SPEAKS_FOR), F.lit(False)),
            vote(F.lit(False), x["before"].rlike(SPEAKS_AGAINST)),
            F.when((left == "") | left.rlike(r"[\s\"'=:(<,;]"), 1).otherwise(-1),
            F.when((right == "") | right.rlike(r"[\s\"'.,;:!?)>*#$%&]"), 1).otherwise(-1),
            F.when(x["standard"], 1).otherwise(-1),
            F.when(x["variety"] >= 5, 1).otherwise(-1),
        ]
        shape = F.when(left == "", "begin").when(left.rlike(r"\s"), "blank").when(left.rlike("[\"'=:]"), "sign").otherwise("other")
        extent = x["end"] - x["start"]
        return F.struct(
            x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), (x["ok"] & (x["kind"] < BASE)).alias("base"),
            F.array(*[v.cast("int") for v in votes]).alias("votes"), shape.alias("shape"),
            F.when(extent < 12, "short").when(extent < 24, "middle").otherwise("long").alias("extent"),
        )

    keep = lambda x: (x["kind"] >= BASE) | x["ok"]  # noqa: E731  failed ip and phone matches are dropped
    secret_ok = lambda x: (x["kind"] != 4) | x["ok"]  # noqa: E731  all digits or all letters: not a secret
    return df.select("doc_id", F.transform(F.filter("found", lambda x: keep(x) & secret_ok(x)), voted).alias("found"))


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> Column:
    """Fit two-class labeler models by expectation-maximisation, each kind of span its own;
    the probability that a span with columns `kind` and `votes` is personal data.

    `patterns` counts the vote vectors (kind, votes, n): at most kinds * 3 ** labelers
    rows, however many spans there are.  Each round is one aggregation over it; the driver
    gets the sums, a row for each kind.  A kind's rates start from those of all kinds, which
    count as `SHARED` spans of it.
    """
    get = lambda j: F.get("votes", F.lit(j))
    balance = F.aggregate("votes", F.lit(0), lambda a, v: a + v)
    chance = 1 / (1 + F.exp(-balance.cast("double")))
    names = [(j, v) for j in range(len(LABELERS)) for v in (-1, 0, 1)]
    for _ in range(rounds):
        sums = {"yes": F.sum(F.col("n") * F.col("p")), "no": F.sum(F.col("n") * (1 - F.col("p")))}
        for j, v in names:
            here = F.when(get(j) == v, F.col("n")).otherwise(0)
            sums[f"yes{j},{v}"] = F.sum(here * F.col("p"))
            sums[f"no{j},{v}"] = F.sum(here * (1 - F.col("p")))
        got = {r["kind"]: r.asDict() for r in patterns.withColumn("p", chance).groupBy("kind").agg(*[c.alias(k) for k, c in sums.items()]).collect()}
        every = {k: sum(float(own[k] or 0) for own in got.values()) for k in sums}

        def rate(own: dict, side: str, j: int, v: int) -> float:
            all_kinds = (every[f"{side}{j},{v}"] + 1) / (every[side] + 3)
            return (float(own[f"{side}{j},{v}"] or 0) + SHARED * all_kinds) / (float(own[side] or 0) + SHARED)

        prior = (every["yes"] + 1) / (every["yes"] + every["no"] + 2)
        odds = F.lit(0.0)
        for kind, own in sorted(got.items()):
            here = F.lit(math.log((float(own["yes"] or 0) + SHARED * prior) / (float(own["no"] or 0) + SHARED * (1 - prior))))
            for j in range(len(LABELERS)):
                weigh = {v: math.log(rate(own, "yes", j, v)) - math.log(rate(own, "no", j, v)) for v in (-1, 0, 1)}
                here = here + F.when(get(j) == 1, weigh[1]).when(get(j) == -1, weigh[-1]).otherwise(weigh[0])
            odds = F.when(F.col("kind") == kind, here).otherwise(odds)
        chance = 1 / (1 + F.exp(-odds))
    return chance


def _features(x) -> Column:
    votes = [F.concat(F.lit(f"{name}="), F.get(x["votes"], F.lit(j)).cast("string")) for j, name in enumerate(LABELERS)]
    return F.array(*votes, F.concat(F.lit("kind="), x["kind"].cast("string")), F.concat(F.lit("shape="), x["shape"]), F.concat(F.lit("extent="), x["extent"]))


def classifier(spans: DataFrame, chance: Column) -> tuple[dict[str, float], float]:
    """Log-odds weight of each feature and the prior, from the probabilities that the
    labelers' model gives all spans.  Features are few, whatever the number of spans."""
    own = spans.withColumn("p", chance).withColumn("x", F.struct("votes", "kind", "shape", "extent"))
    rows = own.select(F.explode(F.array_append(_features(F.col("x")), F.lit("all"))).alias("feature"), "p", "n")
    got = {r["feature"]: (r["yes"], r["no"]) for r in rows.groupBy("feature").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).collect()}
    yes, no = got.pop("all", (0.0, 0.0))
    return {f: math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2)) for f, (a, b) in got.items()}, math.log((yes + 1) / (no + 1))


def find(docs: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """doc_id and `spans` (start, kind, end, base) of every row, sorted by start and kind.

    Base spans stay whatever the votes.  Secrets and long numbers that fail the check
    are added when the final classifier accepts them.  Null or empty text: no spans.
    Null or repeated doc_id: a row for each row.  Empty table: no rows.  Columns other than
    doc_id and text, whatever their names, are not read.
    """
    found = stage(candidates(docs), "spans")
    each = found.select(F.explode("found").alias("x")).select("x.*")
    patterns = stage(each.groupBy("votes", "kind", "shape", "extent").agg(F.count(F.lit(1)).alias("n")), "votes")
    weights, prior = classifier(patterns, reliabilities(patterns, rounds))
    table = F.create_map(*[F.lit(y) for item in sorted(weights.items()) for y in item]) if weights else F.lit(None).cast("map<string,double>")
    odds = lambda x: F.aggregate(_features(x), F.lit(prior), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
    bound = math.log(accept / (1 - accept))
    kept = F.filter("found", lambda x: x["base"] | (odds(x) > bound))
    spans = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base"))))
    return found.select("doc_id", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
