"""Counts of words, scenarios and tones in short texts.

Words are found as they stand, letter case included. Every operator passes over the texts once and shuffles
counts, never texts; the word lists are literals of the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.functions.text import cut, filled, holds_any, occurrences, words_held
from tallyshelf.operators.rank import ranked

Groups = tuple[tuple[str, tuple[str, ...]], ...]

# The word lists that apply where a report names none.
FOCUS_WORDS = (
    "口感", "甜", "糖", "血糖", "控糖", "低糖", "无糖", "饱腹", "升糖", "GI", "gi", "孕妇", "老人", "糖尿病", "价格", "贵", "便宜", "回购",
    "包装", "物流",
)
SCENARIOS: Groups = (
    ("早餐/代餐", ("早餐", "代餐", "早饭", "当早餐", "当早饭", "早上吃", "晨起")),
    ("零食/加餐/解馋", ("零食", "加餐", "嘴馋", "小零食", "解馋", "垫肚子", "饿了", "肚子饿", "两餐之间", "间食")),
    ("控糖/血糖相关", ("控糖", "血糖高", "升糖", "糖友", "糖尿病", "孕期控糖", "妊娠糖", "血糖")),
    ("孕期/育儿", ("孕期", "孕妇", "怀孕", "产妇", "坐月子", "哺乳", "给宝宝", "给娃", "孩子吃", "小孩吃", "宝宝吃")),
    ("健身/减脂", ("减肥", "减脂", "瘦身", "健身", "卡路里", "热量低", "低脂")),
    ("长辈/家庭", ("老人", "爸妈", "父母", "长辈", "爷爷奶奶", "给家里")),
    ("办公/外出", ("办公室", "上班吃", "出门", "外出", "随身带", "包里", "便携")),
    ("送礼/囤货", ("送礼", "送人", "囤货", "年货")),
    ("夜宵/熬夜", ("夜宵", "熬夜", "晚上饿")),
)
GOOD_WORDS = ("好", "赞", "满意", "回购", "推荐", "不错", "喜欢", "香", "实惠", "值得", "棒", "鲜嫩", "好吃", "划算", "正品", "好评")
BAD_WORDS = ("差", "烂", "难吃", "失望", "假", "骗", "退货", "不建议", "硬", "糟糕", "难用", "臭", "差评", "不好", "难喝", "发霉")
GOOD_PHRASES = (
    "已经回购很多次", "还会再买", "值得回购", "推荐购买", "性价比很高", "性价比不错", "物美价廉", "物流很快", "包装很用心", "包装完好", "口感很好",
    "味道不错", "很好吃", "香而不腻", "饱腹感不错", "控糖很友好", "低糖很适合", "代餐很方便", "品质很稳定", "值得信赖",
)
BAD_PHRASES = (
    "口感偏硬", "口感很硬", "口感发粘", "太甜了", "甜得发腻", "甜度过高", "不太好吃", "很难吃", "味道很奇怪", "有股怪味", "一股异味", "包装破损",
    "漏气受潮", "日期不新鲜", "临期产品", "质量很差", "不值这个价", "与描述不符", "疑似假货", "发货特别慢", "物流太慢了", "售后很差", "退款很麻烦",
    "不建议购买", "不会再买",
)
STAPLES = (
    "包子", "馒头", "花卷", "饺子", "饺皮", "饺子皮", "水饺", "蒸饺", "锅贴", "馄饨", "云吞", "抄手", "面条", "挂面", "拉面", "刀削面", "凉面", "冷面",
    "热干面", "意面", "方便面", "泡面", "速食面", "米粉", "米线", "河粉", "粉丝", "螺蛳粉", "米糕", "年糕", "糍粑", "发糕", "重组米", "重组大米", "大米",
    "米饭", "杂粮饭", "白米饭", "自热米饭", "煲仔饭", "烧麦", "烧卖", "面皮", "春卷", "手抓饼", "葱油饼", "馅饼", "烧饼", "油条", "窝头", "窝窝头", "荞麦面",
    "青稞", "全麦面条",
)
BAKERY = (
    "面包", "吐司", "列巴", "欧包", "贝果", "可颂", "牛角", "蛋糕", "糕点", "饼干", "曲奇", "烘焙", "酥饼", "桃酥", "威化", "华夫", "司康", "蛋挞", "月饼",
    "酥性", "苏打饼干", "全麦面包", "手撕面包",
)


def longest_first(*lists: tuple[str, ...]) -> tuple[str, ...]:
    """SET11: the words of all lists once, longer ones first, otherwise in order."""
    return tuple(sorted(dict.fromkeys(w.strip() for words in lists for w in words if w.strip()), key=lambda w: -len(w)))


def focus_hits(texts: DataFrame, text: str, words: tuple[str, ...] = FOCUS_WORDS, *by: str) -> DataFrame:
    """AGG11: rk, word and its occurrences over all texts, without words of one character; words never found are left out.

    Words are ranked by count, then by their place in the list; a word that is listed twice counts twice.
    """
    used = [(i, w) for i, w in enumerate(words) if len(w) > 1]
    first = {w: i for i, w in reversed(used)}
    times = {w: sum(x == w for _, x in used) for _, w in used}
    sums = [F.sum(occurrences(text, w) * times[w]).alias(f"w{i}") for w, i in first.items()]
    if not sums:
        sums = [F.sum(F.lit(0)).cast("long").alias("w0")]
        first = {"": 0}
    counts = texts.groupBy(*by).agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("first_seen"), F.lit(w).alias("word"), F.col(f"w{i}").alias("n")) for w, i in first.items()]))
    hits = counts.select(*by, rows.alias("hit")).select(*by, "hit.*").where("n > 0")
    return ranked(hits, *by).select(*by, "rk", "word", "n")


def focus_hits_or(texts: DataFrame, fallback: DataFrame, text: str, words: tuple[str, ...] = FOCUS_WORDS) -> DataFrame:
    """AGG12: the hits in texts, or those in fallback if there are none, whether or not there are texts."""
    first = focus_hits(texts, text, words).withColumn("of", F.lit(0))
    both = first.unionByName(focus_hits(fallback, text, words).withColumn("of", F.lit(1)))
    best = F.min("of").over(Window.partitionBy())  # a row for each word at most
    return both.withColumn("best", best).where("of = best").drop("of", "best")


def focus_hits_by_or(texts: DataFrame, fallback: DataFrame, text: str, group: str, words: tuple[str, ...] = FOCUS_WORDS) -> DataFrame:
    """AGG13: as focus_hits_or, decided group by group."""
    first = focus_hits(texts, text, words, group).withColumn("of", F.lit(0))
    both = first.unionByName(focus_hits(fallback, text, words, group).withColumn("of", F.lit(1)))
    return both.withColumn("best", F.min("of").over(Window.partitionBy(group))).where("of = best").drop("of", "best")


def text_units(comments: DataFrame, previews: DataFrame, text: str, *by: str) -> DataFrame:
    """AGG14, AGG15: the texts that are not blank, of comments, or where a group has none of these, of previews."""
    of = lambda df, k: df.select(*by, filled(text).alias(text), *[c for c in df.columns if c not in (*by, text)], F.lit(k).alias("_of")).where(F.col(text).isNotNull())
    first, second = of(comments, 0), of(previews, 1)
    if by:
        return first.unionByName(second.join(first.select(*by).distinct(), list(by), "left_anti"), allowMissingColumns=True).drop("_of")
    none = first.agg(F.count(F.lit(1)).alias("n")).where("n = 0").withColumn("_of", F.lit(1)).drop("n")
    return first.unionByName(second.join(F.broadcast(none), "_of", "left_semi"), allowMissingColumns=True).drop("_of")  # none: one row at most


def scenario_counts(texts: DataFrame, text: str, order: Column, groups: Groups = SCENARIOS, *by: str) -> DataFrame:
    """AGG10, AGG25: rk, scenario, n of the texts with one of its triggers, and their share of all texts.

    A text may count for several scenarios. Ties: the scenario that a text met first, then its place in the list.
    """
    flags = [holds_any(text, triggers) for _, triggers in groups]
    aggs = [F.count(F.lit(1)).alias("n_texts")]
    for i, flag in enumerate(flags):
        aggs += [F.count_if(flag).alias(f"n{i}"), F.min(F.when(flag, order)).alias(f"f{i}")]
    one = texts.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(label).alias("scenario"), F.col(f"n{i}").alias("n"), F.struct(F.col(f"f{i}").alias("at"), F.lit(i).alias("place")).alias("first_seen"))
            for i, (label, _) in enumerate(groups)
        ]
    )
    found = one.select(*by, "n_texts", F.explode(rows).alias("s")).select(*by, "n_texts", "s.*").where("n > 0")
    return ranked(found, *by).select(*by, "rk", "scenario", "n", F.round(F.col("n") / F.col("n_texts"), 6).alias("share"))


def with_tone(texts: DataFrame, text: str, good: tuple[str, ...], bad: tuple[str, ...]) -> DataFrame:
    """Adds good and bad: whether the text contains a word of either list."""
    return texts.withColumns({"good": holds_any(F.coalesce(F.col(text), F.lit("")), good), "bad": holds_any(F.coalesce(F.col(text), F.lit("")), bad)})


GOOD_LEXICON, BAD_LEXICON = longest_first(GOOD_WORDS, GOOD_PHRASES), longest_first(BAD_WORDS, BAD_PHRASES)


def tones(texts: DataFrame, text: str, good: tuple[str, ...] = GOOD_LEXICON, bad: tuple[str, ...] = BAD_LEXICON, *by: str) -> DataFrame:
    """AGG16: how many texts have good words only, bad words only, both, and neither."""
    marked = with_tone(texts, text, good, bad)
    return marked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("text_units"),
        F.count_if(F.expr("good and not bad")).alias("positive_only"),
        F.count_if(F.expr("bad and not good")).alias("negative_only"),
        F.count_if(F.expr("good and bad")).alias("mixed_positive_and_negative"),
        F.count_if(F.expr("not good and not bad")).alias("neutral_or_empty"),
    )


def phrase_hits(texts: DataFrame, text: str, order: Column, phrases: tuple[str, ...], k: int = 18) -> DataFrame:
    """AGG17: rk, word and the number of texts that contain it; ties as the texts meet them, longer phrases first."""
    listed = tuple(sorted(phrases, key=lambda w: -len(w)))
    hits = texts.select(order.alias("at"), F.explode(words_held(text, listed)).alias("hit"))
    counts = hits.groupBy("hit.word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "hit.position")).alias("first_seen"))
    return ranked(counts.orderBy(F.desc("n"), "first_seen").limit(k)).select("rk", "word", "n")


def tone_phrase_hits(
    texts: DataFrame,
    text: str,
    order: Column,
    good: tuple[str, ...] = GOOD_LEXICON,
    bad: tuple[str, ...] = BAD_LEXICON,
    good_phrases: tuple[str, ...] = GOOD_PHRASES,
    bad_phrases: tuple[str, ...] = BAD_PHRASES,
) -> DataFrame:
    """AGG17 for both tones: good phrases among texts with a good word, bad phrases among those with a bad one."""
    marked = with_tone(texts, text, good, bad)
    return (
        phrase_hits(marked.where("good"), text, order, good_phrases)
        .withColumn("tone", F.lit("positive"))
        .unionByName(phrase_hits(marked.where("bad"), text, order, bad_phrases).withColumn("tone", F.lit("negative")))
    )


def tone_samples(
    texts: DataFrame,
    text: str,
    order: Column,
    good: tuple[str, ...] = GOOD_LEXICON,
    bad: tuple[str, ...] = BAD_LEXICON,
    most: int = 14,
    most_mixed: int = 8,
    n: int = 240,
) -> DataFrame:
    """AGG18: per tone the first distinct texts, cut to n code points with an ellipsis.

    Words are looked for in the texts as they are, and only texts with one are stripped. Texts travel as hashes until
    the few that are shown are known; a tone's first ones are ranked after each task has left out what cannot be among
    them, and a text with very many copies is one row after partial aggregation.
    """
    marked = with_tone(texts.withColumn("_at", order), text, good, bad)
    tone = F.expr("case when good and bad then 'mixed' when good then 'positive' when bad then 'negative' end")
    toned = marked.select("_at", text, tone.alias("tone")).where("tone is not null")
    key = lambda: F.sha2(filled(text), 256)
    firsts = toned.groupBy("tone", key().alias("_key")).agg(F.min("_at").alias("_at"))
    ranked_ = firsts.withColumn("rk", F.row_number().over(Window.partitionBy("tone").orderBy("_at"))).where(F.col("rk") <= max(most, most_mixed))
    few = ranked_.where(F.col("rk") <= F.when(F.col("tone") == "mixed", most_mixed).otherwise(most))
    named = few.withColumnRenamed("_at", "_first")  # most rows of each tone at most
    at = texts.select(order.alias("_at"), text)
    shown = at.join(F.broadcast(named), at["_at"] == named["_first"]).where(key() == F.col("_key"))
    return shown.select("tone", "rk", cut(filled(text), n, "…").alias("sample")).groupBy("tone", "rk").agg(F.min("sample").alias("sample"))


def scope_tag(text: Column, first: tuple[str, ...] = STAPLES, second: tuple[str, ...] = BAKERY, names: tuple[str, str] = ("4.1", "4.2")) -> Column:
    """FLT2: the names of the word lists that the text has words of, joined by a plus; empty if of neither."""
    a, b = holds_any(text, first), holds_any(text, second)
    return F.when(a & b, "+".join(names)).when(a, names[0]).when(b, names[1]).otherwise("")


def in_scope(rows: DataFrame, cells: list[str], keep_all_if_none: bool = False, **lists) -> DataFrame:
    """FLT1, FLT3: the rows whose cells, joined by line breaks, have a tag, which is added as scope_tag.

    With keep_all_if_none, all rows stay if none has a tag.
    """
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in cells])
    tagged = rows.withColumn("scope_tag", scope_tag(text, **lists))
    kept = tagged.where("scope_tag <> ''")
    return tagged if keep_all_if_none and kept.isEmpty() else kept


def scope_stats(rows: DataFrame, cells: list[str], **lists) -> DataFrame:
    """FLT1: input, kept and dropped rows."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in cells])
    tag = scope_tag(text, **lists)
    return rows.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(tag != "").alias("kept_rows"), F.count_if(tag == "").alias("dropped_rows")
    )
