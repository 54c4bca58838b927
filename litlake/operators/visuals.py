"""Figures and tables with their context: extraction, ranking, placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litlake.functions.text import clean_text, heading_key, squeeze, strip_html, truncate

# Words that decide where a visual belongs, in order of precedence.
SECTION_RULES = (
    ("局限与不足", r"limitation|future work|failure|poor|weakness"),
    ("关键实验与结果", r"result|experiment|comparison|ablation|performance|accuracy|dataset|percentile|curve|reduction|score|benchmark"),
    ("核心方法", r"method|model|framework|architecture|pipeline|algorithm|module|overview|approach"),
    ("研究问题", r"motivation|problem|challenge|introduction|background"),
)
# Where a visual belongs if nothing speaks, and words that add to its score.
DEFAULT_SECTION = "关键实验与结果"
SCORE_WORDS = r"result|experiment|comparison|ablation|performance|accuracy|flow|curve|dataset|method|model"

# Headings that stand for a section.
ALIASES = {
    "研究问题": ["核心问题", "研究问题", "动机和思想", "基本信息"],
    "核心方法": ["方法概述", "核心方法", "方法", "模型结构", "实验设置"],
    "关键实验与结果": ["主要结果", "实验设置", "关键实验与结果", "实验结果", "结果分析", "贡献展示", "贡献"],
    "局限与不足": ["局限与风险", "局限与不足", "局限", "不足", "未来工作"],
}

# Words that speak for a heading.
HEADING_WORDS = {
    "基本信息": [
        "title", "venue", "conference", "year", "paper", "作者", "标题", "会议", "年份",
    ],
    "核心问题": [
        "problem", "challenge", "motivation", "background", "limitation of existing", "问题", "挑战", "动机", "背景",
    ],
    "动机和思想": [
        "motivation", "idea", "insight", "intuition", "思想", "动机", "直觉", "启发",
    ],
    "方法概述": [
        "method", "model", "framework", "architecture", "pipeline", "algorithm", "module", "overview", "approach", "training",
        "inference", "prompt", "loss", "方法", "模型", "框架", "结构", "流程", "算法", "模块", "训练", "推理",
    ],
    "实验设置": [
        "dataset", "benchmark", "metric", "baseline", "setting", "protocol", "implementation", "数据集", "基准", "指标", "基线", "设置",
        "协议", "实现",
    ],
    "主要结果": [
        "result", "experiment", "comparison", "performance", "accuracy", "f1", "score", "benchmark", "ablation", "generalization",
        "结果", "实验", "性能", "准确率", "对比", "消融", "泛化",
    ],
    "贡献展示": [
        "contribution", "贡献", "propose", "introduce", "提出", "构建",
    ],
    "局限与风险": [
        "limitation", "failure", "risk", "weakness", "future work", "局限", "不足", "风险", "失败", "未来",
    ],
    "可借鉴点": [
        "takeaway", "lesson", "insight", "future", "借鉴", "启示", "参考",
    ],
}

# Fixed values: (heading, points, pattern over the visual's text).
BONUSES = (
    ("实验设置", 3, r"\b(table|benchmark|dataset|metric|baseline)\b|表|数据集|基准|指标|基线"),
    ("主要结果", 4, r"\b(ablation|result|performance|accuracy|f1|score|comparison)\b|消融|结果|性能|对比"),
    ("方法概述", 4, r"\b(method|framework|architecture|pipeline|module|algorithm)\b|方法|框架|结构|流程|模块"),
    ("局限与风险", 4, r"\b(limitation|failure|future work|weakness|risk)\b|局限|不足|失败|未来|风险"),
)

# Rewritten captions, the first pattern that fits, then words in this order.
CAPTION_PATTERNS = (
    (r"Experimental results of (.+?) on (.+?) in terms of emotion classification accuracy", "$1 在 $2 上的情绪分类准确率实验结果"),
    (r"Experimental results of (.+?) setting on multiple datasets in terms of emotion classification accuracy", "$1 设置下多个数据集的情绪分类准确率实验结果"),
    (r"Ablation results of (.+?) and comparison with the vanilla CLIP", "$1 的消融结果，以及与原始 CLIP 的对比"),
    (r"Ablation study of (.+?) setting in (.+?) task", "$1 设置下 $2 任务的消融研究"),
    (r"Effectiveness of different fine-tuning strategies on the (.+?) task", "不同微调策略在 $1 任务上的效果"),
    (r"Visualization results of (.+)", "$1 的可视化结果"),
    (r"Overview of (.+)", "$1 的整体框架"),
    (r"Comparison with (.+)", "与 $1 的对比"),
)
CAPTION_WORDS = (
    ("DA", "领域自适应"),
    ("UC", "通用跨域"),
    ("UCDVER", "无监督跨域视觉情感识别"),
    ("state-of-the-art", "当前最优"),
    ("SOTA", "当前最优"),
    ("source domain", "源域"),
    ("target domain", "目标域"),
    ("classification accuracy", "分类准确率"),
    ("fine-tuning", "微调"),
    ("features-based", "基于特征"),
    ("prompt-based", "基于提示"),
)


def _text(*names: str) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(n), F.lit("")) for n in names]))


def with_context(blocks: DataFrame, doc: str = "doc_id", near: int = 3, least: int = 30) -> DataFrame:
    """Blocks (doc, pos, type, text, text_level) with ``section``, ``before_text`` and ``after_text``.

    section is the last text block before that has level 1 or starts with a
    number; the contexts are the ``near`` text blocks of at least ``least``
    characters next to it on each side, in document order, others skipped
    however many.  One shuffle by document serves all windows.
    """
    order = Window.partitionBy(doc).orderBy("pos")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    coming = order.rowsBetween(1, Window.unboundedFollowing)
    text = clean_text(F.coalesce(F.col("text"), F.lit("")))
    rows = blocks.withColumn("__clean", F.when(F.col("type") == "text", text))
    heading = F.when((F.col("text_level") == 1) | F.col("__clean").rlike(r"^\d+(?:\.\d+)*\s+\S+"), F.col("__clean"))
    fits = F.when(F.length("__clean") >= least, F.col("__clean"))
    counted = rows.withColumn("__fits", fits).withColumn("__heading", heading)
    counted = counted.withColumn("section", F.coalesce(F.last("__heading", ignorenulls=True).over(past), F.lit("")))
    # Places of the qualifying blocks: the frame of a row holds just the ``near`` blocks whose number is next to its own.
    number = F.coalesce(F.count("__fits").over(past), F.lit(0))
    rank = counted.withColumn("__rank", number)
    by_rank = Window.partitionBy(doc).orderBy(F.col("__rank").cast("long"))
    mine = F.when(F.col("__fits").isNotNull(), F.struct("pos", "__fits"))
    # A qualifying block with rank r is the (r+1)-th: it is before rows of rank r+1 .. and after rows of rank .. r.
    earlier = F.collect_list(mine).over(by_rank.rangeBetween(-near, -1))
    later = F.collect_list(mine).over(by_rank.rangeBetween(0, near))
    place = F.col("pos")

    def joined(found: Column, ahead: bool) -> Column:
        kept = F.array_sort(F.filter(found, lambda x: x["pos"] > place if ahead else x["pos"] < place))
        kept = F.slice(kept, 1, near) if ahead else kept
        return F.array_join(F.transform(kept, lambda x: x["__fits"]), " ")

    out = rank.withColumn("__e", earlier).withColumn("__l", later)
    out = out.withColumn("before_text", joined(F.col("__e"), False)).withColumn("after_text", joined(F.col("__l"), True))
    out = out.drop("__e", "__l", "__rank")
    return out.drop("__clean", "__fits", "__heading")


def extract_visuals(blocks: DataFrame, doc: str = "doc_id", most: int | None = None) -> DataFrame:
    """Visual items of ``blocks`` with context: image and table blocks that have a path, a caption or a body.

    A path that a document repeats (without regard to case) counts once; items
    without a path always count.  item_index runs from 1 in document order.
    ``most`` keeps the first ones of each document.
    """
    found = with_context(blocks, doc).where(F.col("type").isin("image", "table"))
    body = truncate(strip_html(F.coalesce(F.col("table_body"), F.lit(""))), 1200)
    found = found.withColumns(
        {
            "caption": clean_text(F.coalesce(F.col("caption"), F.lit(""))),
            "table_body": F.when(F.col("type") == "table", body).otherwise(""),
            "page": F.when(F.col("page_idx").isNotNull(), F.col("page_idx") + 1).otherwise(0),
        }
    ).where("coalesce(path, '') <> '' or caption <> '' or table_body <> ''")
    same = Window.partitionBy(doc, F.lower("path")).orderBy("pos")
    first = found.withColumn("__n", F.row_number().over(same)).where("coalesce(path, '') = '' or __n = 1").drop("__n")
    numbered = first.withColumn("item_index", F.row_number().over(Window.partitionBy(doc).orderBy("pos")))
    return numbered if most is None else numbered.where(F.col("item_index") <= most)


def visual_score() -> Column:
    """5 for a caption, 4 for a table, 3 for a numbered figure or table, 2 for words of results and methods."""
    text = _text("caption", "before_text", "after_text")
    return (
        F.when(F.coalesce(F.col("caption"), F.lit("")) != "", 5).otherwise(0)
        + F.when(F.col("kind") == "table", 4).otherwise(0)
        + F.when(text.rlike(r"\b(fig\.|figure|table)\s*\d+"), 3).otherwise(0)
        + F.when(text.rlike(SCORE_WORDS), 2).otherwise(0)
    ).cast("int")


def top_visuals(items: DataFrame, doc: str, k: int) -> DataFrame:
    """The ``k`` best items of each document by score, path and index; repeated rows count once."""
    scored = items.withColumn("score", visual_score()).distinct()
    order = [F.col("score").desc(), (F.coalesce(F.col("path"), F.lit("")) != "").desc(), F.col("item_index")]
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(*order, F.xxhash64(*scored.columns))))
    return ranked.where(F.col("place") <= k)


def visual_section() -> Column:
    """The section that an item belongs to; tables belong to results unless they speak of limitations."""
    text = _text("caption", "section", "before_text", "after_text")
    out = F.lit(DEFAULT_SECTION)
    for name, pattern in reversed(SECTION_RULES):
        fits = text.rlike(pattern)
        out = F.when(fits | (F.col("kind") == "table") if name == DEFAULT_SECTION else fits, name).otherwise(out)
    return out


def number_refs(caption: Column) -> Column:
    """Distinct ``kind:number`` of the figures and tables named in a caption, in order."""
    found = F.regexp_extract_all(caption, F.lit(r"(?i)\b(?:table|figure|fig\.?)\s*[0-9]+\b"), F.lit(0))
    return F.array_distinct(
        F.transform(
            found,
            lambda x: F.concat(F.when(F.lower(x).startswith("table"), "table:").otherwise("figure:"), F.regexp_extract(x, "([0-9]+)$", 1)),
        )
    )


def visual_number(caption: Column, kind: Column) -> Column:
    """The number after Figure, Fig or Table; empty if there is none of this kind."""
    table = F.regexp_extract(caption, r"(?i)\btable\s*([0-9]+)\b", 1)
    figure = F.regexp_extract(caption, r"(?i)\b(?:figure|fig\.?)\s*([0-9]+)\b", 1)
    return F.when(kind == "table", table).otherwise(figure)


def chinese_caption(caption: Column) -> Column:
    """A caption without its label, the first fitting pattern rewritten, then the fixed words replaced one after the other."""
    text = F.regexp_replace(squeeze(caption), r"(?i)^(table|figure|fig\.?)\s*\d+\s*[:.]\s*", "")
    out = text
    for pattern, new in reversed(CAPTION_PATTERNS):
        out = F.when(text.rlike(f"(?i){pattern}"), F.regexp_replace(text, f"(?i){pattern}", new)).otherwise(out)
    for word, new in CAPTION_WORDS:
        out = F.replace(out, F.lit(word), F.lit(new))
    return F.trim(out)


def context_lines(items: DataFrame, doc: str, most: int = 6) -> DataFrame:
    """(doc, context): the ``most`` best items in document order as Markdown, each with what it has."""
    best = top_visuals(items, doc, most)

    def part(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"\n- {label}："), value))

    lines = F.concat_ws(
        "",
        F.concat(F.lit("### "), F.initcap(F.when(F.col("kind") == "table", "table").otherwise("figure")), F.lit(" "), F.col("item_index")),
        part("类型", F.col("kind")),
        part("页码", F.when(F.col("page") > 0, F.col("page").cast("string")).otherwise("未知")),
        part("Markdown 图片路径", F.concat(F.lit("`"), F.nullif("path", F.lit("")), F.lit("`"))),
        part("所在章节", F.col("section")),
        part("Caption", F.col("caption")),
        part("Footnote", F.col("footnote")),
        part("前文上下文", truncate(F.col("before_text"), 160)),
        part("后文上下文", truncate(F.col("after_text"), 160)),
        part("表格内容摘录", truncate(F.col("table_body"), 220)),
    )
    rows = best.select(doc, F.struct("item_index", lines.alias("line")).alias("x"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n\n").alias("context"))


def headings(summaries: DataFrame, doc: str, text: str, least: int = 2, most: int = 2) -> DataFrame:
    """(doc, pos, level, heading) of the Markdown headings of these levels, without the section of related figures."""
    rows = summaries.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^#{2,4}\s+\S"))
    level = F.length(F.regexp_extract("line", r"^(#{2,4})\s", 1))
    title = F.regexp_extract("line", r"^#{2,4}\s+(.+?)\s*$", 1)
    return rows.select(doc, "pos", level.alias("level"), title.alias("heading")).where(
        F.col("level").between(least, most) & (heading_key(F.col("heading")) != "相关图表")
    )


def _named(key: Column, canonical: str) -> Column:
    names = dict.fromkeys([*ALIASES.get(canonical, [canonical]), canonical])
    return reduce(lambda a, b: a | b, [key.contains(n) | F.lit(n).contains(key) for n in names])


def _terms(key: Column) -> Column:
    return F.regexp_extract_all(key, F.lit(r"[a-zA-Z]{4,}|[一-鿿]{2,}"), F.lit(0))


def heading_score() -> Column:
    """How well a row's ``heading`` fits its visual item."""
    key, text = heading_key(F.col("heading")), squeeze(_text("caption", "section", "before_text", "after_text", "table_body", "kind"))
    placed = visual_section()
    score = F.lit(0)
    for name in ALIASES:
        score = score + F.when((placed == name) & _named(key, name), 4).otherwise(0)
    overlap = F.arrays_overlap(_terms(heading_key(F.coalesce(F.col("section"), F.lit("")))), _terms(key))
    score = score + F.when(overlap, 5).otherwise(0)
    for name, words in HEADING_WORDS.items():
        hits = reduce(lambda a, b: a + b, [text.contains(w.lower()).cast("int") for w in words])
        score = score + F.when(_named(key, name), F.least(hits, F.lit(5)) * 2).otherwise(0)
    score = score + F.when((F.col("kind") == "table") & _named(key, "主要结果"), 2).otherwise(0)
    for name, points, pattern in BONUSES:
        score = score + F.when(text.rlike(pattern) & _named(key, name), points).otherwise(0)
    score = score + F.least(F.size(F.filter(_terms(key), lambda t: text.contains(t))), F.lit(3))
    return score - F.when(key.isin("基本信息", "可借鉴点") & (score <= 2), 2).otherwise(0)


def place_visuals(items: DataFrame, summaries: DataFrame, doc: str, text: str) -> DataFrame:
    """Each item with the heading of its document's summary that fits best (score, then first); null where none scores above 0.

    A heading that names the item's exact number goes before any score.
    """
    heads = headings(summaries, doc, text, 2, 4)
    numbered = F.arrays_overlap(
        number_refs(F.coalesce(F.col("caption"), F.lit(""))),
        F.transform(
            F.regexp_extract_all(heading_key(F.col("heading")), F.lit(r"(?:表|table|图|figure|fig)[0-9]+"), F.lit(0)),
            lambda x: F.concat(F.when(x.rlike("^(表|table)"), "table:").otherwise("figure:"), F.regexp_extract(x, "([0-9]+)$", 1)),
        ),
    )
    joined = items.join(heads, doc, "left")
    scored = joined.withColumn("heading_score", F.when(numbered, 1000).when(F.col("level") == 2, heading_score()).otherwise(-1000))
    best = F.max_by(F.struct("heading", "level", "pos", "heading_score"), F.struct(F.col("heading_score"), -F.col("pos")))
    picked = scored.groupBy(*items.columns).agg(best.alias("b"))
    fits = F.col("b.heading_score") > 0
    return picked.select(*items.columns, F.when(fits, F.col("b.heading")).alias("heading"), F.when(fits, F.col("b.heading_score")).alias("heading_score"))


def render_visual(path: Column, label: Column, caption: Column) -> Column:
    """An HTML block of a figure with its caption."""
    image = F.concat(F.lit('<p align="center">\n  <img src="'), path, F.lit('" alt="'), label, F.lit('" />\n</p>'))
    return F.concat(image, F.when(caption != "", F.concat(F.lit('\n<p align="center"><em>'), caption, F.lit("</em></p>"))).otherwise(""))


def insert_visuals(summaries: DataFrame, items: DataFrame, doc: str, text: str, most: int = 8) -> DataFrame:
    """(doc, text): summaries with the ``most`` best items of their documents below the headings they belong to.

    Items without a path, or whose path the summary has, are left out; items
    that fit no heading stand in a section of their own at the end, named by
    their kind of section.  Headings of related figures are removed.
    """
    best = top_visuals(items, doc, most).where("coalesce(path, '') <> ''").select(*items.columns)
    here = summaries.select(doc, text)
    fresh = best.join(here, doc).where(~F.col(text).contains(F.concat(F.lit("]("), F.col("path"), F.lit(")")))).select(*items.columns)
    placed = place_visuals(fresh, here, doc, text)
    label = F.concat(F.initcap(F.when(F.col("kind") == "table", "table").otherwise("figure")), F.lit(" "), F.coalesce(F.nullif(visual_number(F.coalesce("caption", F.lit("")), F.col("kind")), F.lit("")), F.col("item_index").cast("string")))
    block = F.struct("item_index", render_visual(F.col("path"), label, F.coalesce(chinese_caption(F.col("caption")), F.lit(""))).alias("html"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.col("__block"))), lambda x: x["html"]), "\n\n")
    blocks = placed.withColumn("__section", visual_section()).withColumn("__block", block)
    below = blocks.where("heading is not null").groupBy(doc, "heading").agg(ordered.alias("__html"))
    rest = blocks.where("heading is null").groupBy(doc, "__section").agg(ordered.alias("__html"))
    ends = rest.groupBy(doc).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__section", "__html"))), lambda x: F.concat(F.lit("\n\n## "), x["__section"], F.lit("\n"), x["__html"])), "").alias("__end")
    )
    rows = here.select(doc, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(
        ~(F.col("line").rlike(r"^#{2,4}\s") & (heading_key(F.col("line")) == "相关图表"))
    )
    title = F.regexp_extract("line", r"^#{2,4}\s+(.+?)\s*$", 1)
    rows = rows.withColumn("heading", F.nullif(title, F.lit("")))
    first = Window.partitionBy(doc, "heading").orderBy("pos")
    rows = rows.withColumn("__n", F.when(F.col("heading").isNotNull(), F.row_number().over(first)))
    joined = rows.join(below, [doc, "heading"], "left")
    line = F.when((F.col("__n") == 1) & F.col("__html").isNotNull(), F.concat("line", F.lit("\n\n"), "__html", F.lit("\n"))).otherwise(F.col("line"))
    whole = joined.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("__rows"))
    out = whole.join(ends, doc, "left")
    return out.select(doc, F.concat(F.array_join(F.transform("__rows", lambda x: x["line"]), "\n"), F.coalesce("__end", F.lit(""))).alias(text))
