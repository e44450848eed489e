"""Defaults of job parameters.

Fixed values: these must equal what talk recordings are scored with elsewhere, so they
are stated as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scan:
    bucket_seconds: int = 60
    hot_score: int = 2
    hot_chunk_seconds: int = 180
    normal_chunk_seconds: int = 600
    bridge_minutes: int = 2


@dataclass(frozen=True)
class Cluster:
    threshold: float = 0.42
    window: float = 300.0
    time: float = 0.30
    overlap: float = 0.25
    topic: float = 0.30
    adjacency: float = 0.15
    same_story: float = 0.25
    cross_story: float = -0.15


@dataclass(frozen=True)
class Selection:
    target: int = 8
    b_line: float = 60.0
    c_fallback: int = 3
    forced_keep: float = 40.0
    max_drift: float = 120.0


@dataclass(frozen=True)
class Budget:
    tokens_per_char: float = 0.6
    price_in: float = 2.0
    price_out: float = 8.0
    coarse_seconds: int = 1200
    budget: int = 20_000
    max_candidates: int = 3


# Weights of the five sub-scores, grade lines, labels.
DIMENSIONS = {"hook": 30, "contrast": 25, "persona": 20, "standalone": 15, "completeness": 10}
GRADE_LINES = (("S", 90.0), ("A", 80.0), ("B", 60.0), ("C", 50.0))
GRADE_RANK = {"S": 0, "A": 1, "B": 2, "C": 3, "D": 4}
GRADE_LABEL = {"S": "🌟 高光内容", "A": "🌟 高光内容", "B": "✨ 有看点", "C": "✨ 有看点", "D": ""}
TIER_LABEL = {"S": "🚀 重点推荐", "A": "⭐ 推荐", "B_fill": "👌 值得一看", "C_fallback": "📎 备选参考"}
QUALITY_LABEL = {"S": "爆款候选", "A": "强推荐", "B": "测试素材", "C": "备用素材"}
DIMENSION_LABEL = {"hook": "三秒吸引力", "contrast": "反差/意外", "persona": "人物表现力", "standalone": "独立成片", "completeness": "事件完整度"}
NEGATIVE_RULES = ("普通失误", "普通展示", "单纯惊讶", "依赖上下文", "普通评价")
REJECT_KINDS = ("truly_low_value", "context_insufficient", "event_incomplete", "ai_uncertain")
LIKED = "喜欢"
UNKNOWN_STORY = "__unknown__"
TOKEN_MODES = {"快速": (10_000, 2), "标准": (20_000, 3), "精细": (80_000, 3)}

# Words that mark lively minutes, for every kind of show and by kind.
COMMON_STRONG = ("卧槽", "我操", "卧草", "沃草", "我靠", "妈呀", "我的天", "笑死", "离谱", "炸了", "牛逼", "NB", "服了")
LEXICONS = {
    "娱乐聊天": (
        ("反转", "塌房", "吃瓜", "瓜", "曝光", "爆料", "实锤", "分手", "恋爱", "情侣", "吵架", "怼", "骂", "翻脸", "上头"),
        ("峰哥", "丰哥", "风哥", "老铁", "家人们", "兄弟们", "哈哈哈", "说实话", "你知道吗", "有点意思", "钱", "喜欢"),
    ),
    "游戏竞技": (
        ("一穿三", "一穿二", "五杀", "三杀", "团灭", "逆转", "翻盘", "反杀", "丝血", "残血", "极限", "爆头", "世界波", "高光"),
        ("开局", "决赛圈", "走位", "枪法", "队友", "对手", "赢了", "输了", "操作", "意识", "上分", "开枪", "打他"),
    ),
    "知识分享": (
        ("反常识", "颠覆", "误区", "内幕", "揭秘", "真相", "本质", "底层逻辑", "认知", "千万不要", "一定要记住"),
        ("首先", "其次", "举例", "比如", "也就是说", "换句话说", "重点", "记住", "方法", "建议", "原理", "为什么", "原因"),
    ),
    "户外": (
        ("冲", "挑战", "被抓", "报警", "危险", "翻车", "突发"),
        ("大爷", "路人", "小姐姐", "多少钱", "老板", "走", "跑"),
    ),
    "带货": (
        ("秒杀", "抢购", "上链接", "限量", "优惠", "折扣", "赠品"),
        ("下单", "库存", "便宜", "性价比", "价格", "宝宝们", "宝子们"),
    ),
}


@dataclass(frozen=True)
class Words:
    """Strong and normal words of a scan; user words count as strong."""

    strong: tuple[str, ...]
    normal: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, kind: str = "娱乐聊天", user: tuple[str, ...] = ()) -> Words:
        strong, normal = LEXICONS[kind]
        return cls(tuple(dict.fromkeys((*COMMON_STRONG, *strong, *user))), normal)

# Themes of chapters by their words, and that of chapters without any.
THEMES = {
    "美军口粮": ("美军", "美军口粮", "single ration"),
    "俄军口粮": ("俄军", "俄军口粮", "俄罗斯"),
    "乌军口粮": ("乌军", "乌军口粮", "乌克兰"),
    "罐头测评": ("罐头", "牛肉罐头", "午餐肉"),
    "咖啡测评": ("咖啡", "美式", "奶精"),
    "晚餐/微波炉": ("米饭", "微波炉", "蛋糕", "牛腩", " dinner"),
    "互动/抽奖": ("抽奖", "关注", "礼物", "粉丝"),
}
NO_THEME = "直播互动"
