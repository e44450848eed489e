"""Words that were heard wrong, found by a lexicon and judged by their context."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import form_similarity
from .automaton import Words, automata, leftmost_longest, longest_at_each
from .staging import stage

# Fixed values of the scorer: priors, keywords, marks and lines.
PRIOR = {"person": 0.55, "book": 0.60, "movie": 0.62, "hotword": 0.45}
KEYWORDS = {
    "person": (
        ("主播", "直播间", "博主", "网红", "UP主", "up主", "粉丝", "观众", "连麦", "榜一", "打赏", "解说", "老师"),
        ("直播", "视频", "账号", "微博", "抖音", "B站", "b站", "发布", "更新", "带货"),
    ),
    "movie": (
        ("电影", "电视剧", "影院", "电影院", "追剧", "影视", "番剧", "动漫", "动画", "剧组", "票房", "上映", "豆瓣", "剧情", "主角", "演员", "导演", "结局", "剧场版", "第二季", "全集", "预告"),
        ("看", "追", "刷", "角色", "片", "剧", "剪辑"),
    ),
    "book": (("小说", "网文", "出版社", "作者", "章节", "文学", "名著", "电子书"), ("书", "读", "出版", "卷", "译本", "看")),
    "hotword": (("梗", "热梗", "玩梗", "弹幕", "出圈", "爆火", "网络用语", "流行语"), ("网友", "评论区", "短视频", "直播", "流行")),
}
TAGS = {
    "game": ("游戏", "电竞", "排位", "上分", "开黑", "段位", "副本", "皮肤", "赛季", "服务器", "端游", "手游", "主机", "Steam", "steam", "通关", "Boss", "boss", "装备", "升级", "打野", "抽卡", "玩", "开黑"),
    "livestream": ("直播间", "主播", "弹幕", "礼物", "上票", "连麦", "带货", "榜"),
    "anime": ("番剧", "动漫", "二次元", "追番", "声优", "漫画"),
    "film": ("演员", "导演", "剧组", "票房", "上映", "影视", "电影"),
    "book": ("小说", "作者", "出版", "网文", "文学", "读"),
}
VERBS = ("玩", "打", "看", "追", "读", "刷", "推荐", "通关", "播", "下载", "安装")
GENERIC_RIGHT = (
    "的等待", "的爱情", "的人生", "的时光", "的感觉", "的时候", "的日子", "的岁月", "的青春", "的承诺",
    "的誓言", "的旅程", "的态度", "的生活", "的东西", "的样子", "的地方", "的方式", "的心情", "的故事",
)
DEGREE_LEFT = ("很", "非常", "特别", "挺", "太", "十分", "极其")
BOUNDS = ("，", "。", "！", "？", "、", "；", " ", "\n")
SENTENCE_ENDS = "。！？!?；;\n"
REPLACE_LINE, SUGGEST_LINE = 0.62, 0.40
STAMP = r"\[[^\]\n]*\]"

#: Texts without any of these letters hold none of the keywords.
KEYWORD_LETTERS = r"[\x{4e00}-\x{9fff}]|[Ss]team|[Bb]oss"
#: Lexicons of so many rows at most are broadcast; larger ones are joined.
BROADCAST_ROWS = 200_000
#: Rows of hits that a Python task holds at a time.
HELD_ROWS = 5_000

_HITS = "doc_id long, named string, start int, end int, alias string, sentence string, sentence_at int, left string, right string"


def alias_index(entries: DataFrame) -> DataFrame:
    """alias, owners (entries that claim it), is_canonical, from lexicon entries; patterns
    are passed over."""
    plain = entries.filter("not coalesce(is_pattern, false)")
    each = plain.select(F.explode("aliases").alias("alias"), "canonical").filter("alias <> ''").distinct()
    counted = each.groupBy("alias").agg(F.count(F.lit(1)).alias("owners"))
    names = entries.select(F.col("canonical").alias("alias"), F.lit(True).alias("is_canonical")).distinct()
    return counted.join(names, "alias", "left").withColumn("is_canonical", F.coalesce("is_canonical", F.lit(False)))


def _sentence(text: str, start: int, end: int, reach: int = 120) -> tuple[str, int]:
    low = max(0, start - reach)
    begin = max([low, *(text.rfind(c, low, start) + 1 for c in SENTENCE_ENDS)])
    stops = [p for c in SENTENCE_ENDS if (p := text.find(c, end, end + reach)) >= 0]
    return text[begin : min(stops) + 1 if stops else min(len(text), end + reach)], begin


def _bare(text: str, stamp: re.Pattern):
    """Where the text between stamps lies."""
    at = 0
    for m in stamp.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def _spans(text: str, words: Words, stamp: re.Pattern) -> list[tuple[int, int]]:
    return [x for a, b in _bare(text, stamp) for x in words.spans(text, a, b)]


def _told_of(doc, text: str, wrong: list[tuple[int, int]], right: list[tuple[int, int]]) -> list[tuple]:
    """Rows of a text's hits, and of the canonical words that it writes (`named`): the longest at
    each place.  Hits inside a canonical word are passed over."""
    right = longest_at_each(right)
    starts, reach, out = [a for a, _ in right], [], []
    for _, b in right:
        reach.append(max(b, reach[-1] if reach else 0))
    for a, b in leftmost_longest(wrong):
        held = bisect_right(starts, a)
        if not held or reach[held - 1] < b:
            sentence, begin = _sentence(text, a, b)
            out.append((doc, None, a, b, text[a:b], sentence, begin, text[max(0, a - 8) : a], text[b : b + 6]))
    return out + [(doc, w, None, None, None, None, None, None, None) for w in sorted({text[a:b] for a, b in right})]


def _hits_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _HITS.split(", ")])
    return frame.astype({"doc_id": "Int64", "start": "Int32", "end": "Int32", "sentence_at": "Int32"})


def _hits_frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    """Rows as they come, a few at a time: a batch of texts has many times as many hits."""
    rows = iter(rows)
    while part := list(islice(rows, HELD_ROWS)):
        yield _hits_frame(part)


def _one_pass(docs: DataFrame, wrong: Words, right: Words) -> DataFrame:
    """Rows of `_told_of` where one automaton holds all aliases, and one all canonical words."""
    shared = docs.sparkSession.sparkContext.broadcast((wrong, right))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (wrong, right), stamp = shared.value, re.compile(STAMP)
        for batch in batches:
            yield from _hits_frames(x for doc, text in zip(_ids(batch["doc_id"]), batch["text"]) for x in _told_of(doc, text, _spans(text, wrong, stamp), _spans(text, right, stamp)))

    return docs.mapInPandas(run, _HITS)


def _ids(ids: pd.Series) -> list:
    return ids.astype(object).where(ids.notna(), None).tolist()


def _by_shards(docs: DataFrame, wrong: Iterable[Words], right: Iterable[Words]) -> DataFrame:
    """The same rows for a lexicon of any size: each automaton passes over the texts, and the
    spans of a text come together again."""
    docs = stage(docs.withColumn("rid", F.monotonically_increasing_id()), "texts")
    spans = None
    for is_wrong, lists in ((True, wrong), (False, right)):
        for words in lists:
            shared = docs.sparkSession.sparkContext.broadcast(words)

            def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                stamp = re.compile(STAMP)
                for batch in batches:
                    yield pd.DataFrame([(rid, a, b) for rid, text in zip(batch["rid"], batch["text"]) for a, b in _spans(text, shared.value, stamp)], columns=["rid", "a", "b"])

            own = stage(docs.select("rid", "text").mapInPandas(run, "rid long, a int, b int").withColumn("wrong", F.lit(is_wrong)), "spans")
            spans = own if spans is None else spans.unionByName(own)
    each = spans.groupBy("rid").agg(*[F.collect_list(F.when(c, F.struct("a", "b"))).alias(k) for k, c in (("wrong", F.col("wrong")), ("right", ~F.col("wrong")))])

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = lambda own: [(x["a"], x["b"]) for x in own]
        for batch in batches:
            yield from _hits_frames(x for doc, text, w, r in zip(_ids(batch["doc_id"]), batch["text"], batch["wrong"], batch["right"]) for x in _told_of(doc, text, pairs(w), pairs(r)))

    return docs.join(each, "rid").mapInPandas(told, _HITS)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def found(docs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, named): a row for each alias found (leftmost, longest) and each entry that owns
    it, and (doc_id, canonical) for each canonical word written.

    Stamps in brackets and words inside a canonical word are passed over.  One pass over the
    texts finds all words; a lexicon beyond one automaton takes a pass for each.
    """
    index = alias_index(entries)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    aliases, names = index.select("alias"), entries.select("canonical")
    lists = [automata(aliases), automata(names)]
    first = [next(x) for x in lists]
    if (more := [next(x, None) for x in lists]) == [None, None]:
        rows = _one_pass(texts, *first)
    else:
        rows = _by_shards(texts, *[chain([f], [] if m is None else [m], rest) for f, m, rest in zip(first, more, lists)])
    rows = stage(rows, "hits")
    plain = entries.filter("not coalesce(is_pattern, false)")
    owners = plain.select(F.explode("aliases").alias("alias"), "canonical", "category", "priority", "context_tags").dropDuplicates(["alias", "canonical"])
    hits = rows.filter("alias is not null").drop("named").join(_small(owners), "alias").join(_small(index), "alias")
    return hits, rows.filter("alias is null").select("doc_id", F.col("named").alias("canonical"))


def detect(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """The hits of `found`."""
    return found(docs, entries)[0]


def _listed(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def _by_key(key: Column, table: dict) -> Column:
    """The words of `key` in a fixed table, none for other keys."""
    pairs = [x for k, words in table.items() for x in (F.lit(k), _listed(words))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), _listed(()))


def _told(words: Column) -> Column:
    """How many of `words` stand in the sentence clear of the hit's place."""
    return F.size(F.filter(words, lambda w: F.contains(F.col("around"), w))).cast("double")


#: What an occurrence of each keyword adds to the strength of each key.
_WEIGHTS: dict[str, dict[str, float]] = {}
for _key in dict.fromkeys((*KEYWORDS, *TAGS)):
    for _words, _weight in (*zip(KEYWORDS.get(_key, ()), (0.5, 0.25)), (TAGS.get(_key, ()), 0.5)):
        for _word in _words:
            _own = _WEIGHTS.setdefault(_word, {})
            _own[_key] = _own.get(_key, 0.0) + _weight
_KEYWORDS = Words(list(_WEIGHTS))


def _strengths(text: str) -> list[dict]:
    """Occurrences of each keyword that do not overlap one another, by weight, at most 1 a key."""
    total, ends = {}, {}
    for start, end in _KEYWORDS.spans(text, 0, len(text)):
        word = text[start:end]
        if start >= ends.get(word, 0):
            ends[word] = end
            for key, weight in _WEIGHTS[word].items():
                total[key] = total.get(key, 0.0) + weight
    return [{"key": key, "strength": min(1.0, x)} for key, x in total.items()]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("strength", T.DoubleType())])))
def _profiled(texts: pd.Series) -> pd.Series:
    return pd.Series([_strengths(x) for x in texts], dtype="object")


def document_profile(docs: DataFrame) -> DataFrame:
    """doc_id, key, strength: how much a document speaks of a category or tag, at most 1.
    Only texts with some letter of the keywords are counted, all words in one pass."""
    docs = docs.filter(F.col("text").rlike(KEYWORD_LETTERS))
    return docs.select("doc_id", F.explode(_profiled("text")).alias("p")).select("doc_id", "p.key", "p.strength")


def scored(hits: DataFrame, profile: DataFrame) -> DataFrame:
    """Hits with prior, similarity, context, fluency, ambiguity, score and decision, and the
    score under a consistent document."""
    own = profile.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "strength"))).alias("profile"))
    rows = hits.join(own, "doc_id", "left")
    keys = F.array_append(F.coalesce("context_tags", F.array().cast("array<string>")), F.col("category"))
    strength = F.coalesce(F.array_max(F.transform(keys, lambda k: F.coalesce(F.try_element_at("profile", k), F.lit(0.0)))), F.lit(0.0))
    begin, end = F.col("start") - F.col("sentence_at"), F.col("end") - F.col("sentence_at")
    # the sentence without the hit; no word holds the sign between its halves
    around = F.concat(F.substr("sentence", F.lit(1), F.greatest(F.lit(0), begin)), F.lit("\u0000"), F.substr("sentence", end + 1, F.length("sentence")))
    rows = rows.withColumn("around", around)
    category, own_tags = F.col("category"), F.array_distinct(F.coalesce("context_tags", F.array().cast("array<string>")))
    tagged = F.aggregate(own_tags, F.lit(0.0), lambda acc, t: acc + _told(_by_key(t, TAGS)))
    prior = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in PRIOR.items() for x in item]), category), F.lit(0.45))
    strong, weak = (_told(_by_key(category, {k: v[i] for k, v in KEYWORDS.items()})) for i in (0, 1))
    rows = rows.withColumns({"n_strong": strong, "n_weak": weak, "n_tags": tagged, "doc_strength": strength, "prior": prior}).drop("around")

    def context(base: float) -> Column:
        local = F.when(F.col("n_strong") > 0, F.greatest(F.lit(base), F.least(F.lit(1.0), 0.6 + 0.15 * (F.col("n_strong") - 1)))).when(F.col("n_weak") > 0, F.greatest(F.lit(base), F.lit(0.30))).otherwise(base)
        local = F.when(F.col("n_tags") > 0, F.least(F.lit(1.0), local + 0.60 + 0.10 * (F.col("n_tags") - 1))).otherwise(local)
        return F.least(F.lit(1.0), local + 0.35 * F.col("doc_strength"))

    any_of = lambda c, words, test: F.array_contains(F.array(*[test(c, w) for w in words]), True)
    verb = any_of(F.right(F.col("left"), F.lit(3)), VERBS, lambda c, w: F.contains(c, F.lit(w)))
    bound = (F.col("left") == "") | (F.col("right") == "") | any_of(F.col("left"), BOUNDS, lambda c, w: F.endswith(c, F.lit(w))) | any_of(F.col("right"), BOUNDS, lambda c, w: F.startswith(c, F.lit(w)))
    generic = F.substr("right", F.lit(1), F.lit(3)).isin(*GENERIC_RIGHT)
    degree = any_of(F.col("left"), DEGREE_LEFT, lambda c, w: F.endswith(c, F.lit(w)))
    when = lambda c, v: F.when(c, v).otherwise(0.0)
    fluency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.55 + when(verb, 0.15) + when(bound, 0.15) - when(generic, 0.35) - when(degree, 0.20)))
    factor = lambda c, v: F.when(c, v).otherwise(1.0)
    ambiguity = F.greatest(F.lit(0.4), factor(F.col("owners") > 1, 0.65) * factor(F.col("is_canonical"), 0.70) * factor(F.length("alias") <= 2, 0.90) * factor(F.col("priority") <= 0, 0.95))
    rows = rows.withColumns({"similarity": F.when(F.col("alias") == F.col("canonical"), 1.0).otherwise(form_similarity(F.col("alias"), F.col("canonical"))), "fluency": fluency, "ambiguity": ambiguity, "context": context(0.0), "context_c": context(0.60)})
    total = lambda c: F.least(F.lit(1.0), (0.15 * F.col("prior") + 0.25 * F.col("similarity") + 0.40 * F.col(c) + 0.20 * F.col("fluency")) * F.col("ambiguity"))
    decided = lambda s: F.when(s >= REPLACE_LINE, "replace").when(s >= SUGGEST_LINE, "keep_suggest").otherwise("keep")
    rows = rows.withColumns({"score": total("context"), "score_c": total("context_c")})
    return rows.withColumn("decision", decided(F.col("score"))).drop("profile")


def consistent(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Suggested hits are replaced where the document writes the canonical word itself (as the
    longest one at its place) or one hit of the same alias and word is replaced already, and
    their score then reaches the line.  Aliases of several owners stay."""
    w = W.partitionBy("doc_id", "alias", "canonical")
    rows = rows.join(named.select("doc_id", "canonical", F.lit(True).alias("named")), ["doc_id", "canonical"], "left")
    backed = F.coalesce("named", F.lit(False)) | (F.max((F.col("decision") == "replace").cast("int")).over(w) == 1)
    lifted = backed & (F.col("owners") == 1) & (F.col("decision") == "keep_suggest") & (F.col("score_c") >= REPLACE_LINE)
    return rows.withColumn("lifted", lifted).withColumn("score", F.when(F.col("lifted"), F.col("score_c")).otherwise(F.col("score"))).withColumn(
        "decision", F.when(F.col("lifted"), "replace").otherwise(F.col("decision"))
    )


def resolved(rows: DataFrame) -> DataFrame:
    """One decision for each place: the highest score, then the owner's name; others keep."""
    w = W.partitionBy("doc_id", "start").orderBy(F.desc("score"), "canonical")
    return rows.withColumn("decision", F.when(F.row_number().over(w) == 1, F.col("decision")).otherwise("keep"))


@F.pandas_udf(T.StringType())
def _written(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Texts with the words at `spans` (start, end, canonical; in order) in place of their own:
    one pass over a text, however many places it has."""
    out = []
    for t, own in zip(text, spans):
        parts, at = [], 0
        for x in own if own is not None else ():
            parts += [t[at : x["start"]], x["canonical"]]
            at = x["end"]
        out.append("".join(parts) + t[at:] if parts else t)
    return pd.Series(out, dtype="object")


def applied(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, text, corrected, n_applied: replaced places written anew."""
    spans = decisions.filter("decision = 'replace'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "canonical"))).alias("spans"))
    rows = docs.join(spans, "doc_id", "left")
    return rows.select("doc_id", "text", _written("text", "spans").alias("corrected"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_applied"))


def correct(docs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corrected documents, decisions)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    hits, named = found(docs, entries)
    profile = document_profile(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"))
    decisions = stage(resolved(consistent(scored(hits, profile), named)), "decisions")
    return applied(docs, decisions), decisions


def statistics(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, lines, chars, applied, suggestions, candidates and whether the text changed."""
    n = decisions.groupBy("doc_id").agg(F.count_if(F.col("decision") == "replace").alias("applied"), F.count_if(F.col("decision") == "keep_suggest").alias("suggestions"), F.count(F.lit(1)).alias("candidates"))
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"), F.length(text).cast("long").alias("chars"))
    out = own.join(n, "doc_id", "left").fillna(0, ["applied", "suggestions", "candidates"])
    return out.withColumn("changed", F.col("applied") > 0)


def report(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Audit rows of replacements and suggestions with the number of their line, the parts of
    their score and what spoke for and against."""
    text = docs.select("doc_id", "text")
    rows = decisions.filter("decision <> 'keep'").join(text, "doc_id")
    ahead = F.substr("text", F.lit(1), F.col("start"))
    line = F.length(ahead) - F.length(F.replace(ahead, F.lit("\n"), F.lit(""))) + 1
    parts = [F.round(c, 4).alias(c) for c in ("prior", "similarity", "context", "fluency", "ambiguity")]
    reasons = {
        "keywords near by": F.col("n_strong") + F.col("n_weak") > 0, "tags near by": F.col("n_tags") > 0, "the document speaks of it": F.col("doc_strength") > 0,
        "several owners": F.col("owners") > 1, "a word of its own": F.col("is_canonical"), "consistent with the document": F.col("lifted"),
    }
    told = F.array_compact(F.array(*[F.when(c, name) for name, c in reasons.items()]))
    return rows.select(
        "doc_id", line.alias("line"), "start", "end", F.col("alias").alias("original"), F.col("canonical").alias("corrected"), "category", "decision", F.round("score", 4).alias("score"),
        *parts, F.array_join(told, "; ").alias("reasons"), "sentence",
    )
