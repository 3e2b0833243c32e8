"""Word lists and patterns of the chapter operators. All are parameters of the operators."""

#: Terms that keywords and titles count.
TERMS = (
    "K线", "k线", "形态", "抄底", "逃顶", "见底", "见顶", "止跌", "锤子线", "上吊线", "流星线", "启明星", "起明星", "黄昏之星",
    "倒锤子线", "看涨", "看跌", "抱线", "报线", "吞没", "孕线", "运线", "实体", "影线", "引线", "趋势", "成交量", "放量", "缩量",
    "支撑", "压力", "均线", "财报", "营收", "利润", "现金流", "估值", "公司", "行业", "市场", "排序",
)

#: Phrases that rule out a line as a title.
TITLE_EXCLUSIONS = (
    "youtube会员专享", "视野环球财经", "globalfinance", "disclaimer", "不构成任何投资建议", "投资有风险", "入市需谨慎", "人市需谨慎", "分享个人投资理念",
)

#: Phrases that cost a sentence 0.45 each as a chapter title.
TITLE_PENALTIES = ("大家好", "欢迎收看", "会员专享", "我们来看", "大家来看", "对不对", "好吧", "好吗")

#: Recurring misreadings and what scoring takes them for, in this order.
CONFUSIONS = (("抱线", "包线"), ("报线", "包线"), ("爆线", "包线"), ("运线", "孕线"), ("起明星", "启明星"), ("引线", "影线"), ("指跌", "止跌"))

#: Patterns over normalised text, their weights and names.
CUES = (
    (r"直接进入(主题|正题)", 1.0, "direct_topic_entry"),
    (r"进入正题", 1.0, "direct_topic_entry"),
    (r"(接着|继续)往下看", 0.98, "continue_to_next"),
    (r"(那|那么)?(我们|咱们)?再看一个", 0.98, "another_topic"),
    (r"^排在第[一二三四五六七八九十]", 0.96, "ranked_topic"),
    (r"^(今天|本期).{0,16}(主题|讲解|来讲)", 0.90, "episode_topic"),
    (r"我先把.{0,22}(排序|大方向)", 0.92, "overview_transition"),
    (r"^(首先|其次|接下来|最后).{0,18}(讲|看|介绍|分析|解释|把)", 0.86, "ordered_transition"),
    (r"^(下面|接下来).{0,12}(看|讲|说|分析)", 0.84, "next_topic"),
    (r"^(总结|小结|结论|所以这就是|以上就是)", 0.94, "summary_transition"),
    (r"^这是第[一二三四五六七八九十]种", 0.80, "numbered_topic"),
)

#: A second configuration, for the supplied tables, whose text is Latin.
LATIN_TERMS = ("the", "tion", "que", "und", "ing", "ent")
LATIN_CUES = ((r"^the", 0.90, "opens_with_article"), (r"tion", 0.60, "abstract_noun"), (r"^(in|of|and)", 0.84, "continues"))
