"""Report metadata: identifiers, modality, tags, introductions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litlake.functions import text as t

# Words of each modality, in order.
MODALITY_WORDS = (
    ("video", ("video", "audiovisual", "audio-visual")),
    ("audio", ("audio", "speech", "prosody", "voice")),
    ("text", ("text", "language", "llm", "dialogue", "conversation")),
    ("image", ("image", "vision", "visual", "facial", "face")),
)
MODALITY_TAGS = {"image": ["Image"], "video": ["Video"], "audio": ["Audio"], "text": ["Text", "Language"], "multimodal": ["Multimodal"]}

# Fixed values: (tag, patterns over the lower-cased text), in order.
TAG_RULES = (
    ("Facial Expression Recognition", (r"\bfer\b", r"facial expression")),
    ("Visual Emotion Recognition", (r"\bver\b", r"visual emotion")),
    ("Emotion Recognition", (r"emotion recognition", r"affect recognition")),
    ("Affective Computing", (r"affective computing", r"emotion analysis")),
    ("Cross-Domain", (r"cross[-\s]?domain", r"domain shift")),
    ("Domain Adaptation", (r"domain adaptation", r"\bda\b")),
    ("Unsupervised Learning", (r"unsupervised", r"without target labels")),
    ("Universal Cross-Domain", (r"universal cross[-\s]?domain", r"\bucd?ver\b")),
    ("Diffusion", (r"diffusion", r"denois")),
    ("Counterfactual Learning", (r"counterfactual",)),
    ("Knowledge Alignment", (r"knowledge[-\s]?aligned", r"knowledge alignment")),
    ("CLIP", (r"\bclip\b",)),
    ("VLM", (r"\bvlm\b", r"vision[-\s]?language model")),
    ("LLM", (r"\bllm\b", r"large language model")),
    ("LoRA", (r"\blora\b",)),
    ("MoE", (r"\bmoe\b", r"mixture of experts")),
    ("Transformer", (r"transformer",)),
    ("Attention", (r"attention",)),
    ("Contrastive Learning", (r"contrastive",)),
    ("Prompt Learning", (r"prompt",)),
    ("Knowledge Distillation", (r"distillation",)),
    ("Knowledge Graph", (r"knowledge graph", r"triplet")),
    ("Action Unit", (r"\bau\b", r"action unit")),
    ("Talking Head Generation", (r"talking head",)),
    ("Lip Synchronization", (r"lip[-\s]?sync",)),
    ("Audio-Driven", (r"audio[-\s]?driven", r"speech[-\s]?driven")),
    ("Generation", (r"generation", r"generate")),
    ("Classification", (r"classification", r"classifier")),
    ("Benchmark", (r"benchmark", r"state[-\s]?of[-\s]?the[-\s]?art", r"\bsota\b")),
    ("Dataset", (r"dataset", r"emoset", r"ser30k", r"emo8")),
)

# Tags for keys, in order; the keys are lower case with single spaces.
TAG_ALIASES = {
    "affect": "Affective Computing", "affective computing": "Affective Computing", "audio": "Audio", "audio driven": "Audio-Driven",
    "au": "Action Unit", "action unit": "Action Unit", "action units": "Action Unit", "face": "Face",
    "facial": "Face", "facial expression": "Facial Expression Recognition", "facial expression recognition": "Facial Expression Recognition",
    "fer": "Facial Expression Recognition", "emotion": "Emotion", "emotion recognition": "Emotion Recognition",
    "visual emotion": "Visual Emotion Recognition", "visual emotion recognition": "Visual Emotion Recognition", "ver": "Visual Emotion Recognition",
    "image": "Image", "vision": "Computer Vision", "video": "Video", "text": "Text", "language": "Language", "multimodal": "Multimodal",
    "multi modal": "Multimodal", "cross domain": "Cross-Domain", "domain adaptation": "Domain Adaptation",
    "unsupervised": "Unsupervised Learning", "supervised": "Supervised Learning", "diffusion": "Diffusion", "generative": "Generative Model",
    "generation": "Generation", "talking head": "Talking Head Generation", "lip sync": "Lip Synchronization", "clip": "CLIP", "vlm": "VLM",
    "llm": "LLM", "lora": "LoRA", "moe": "MoE", "transformer": "Transformer", "attention": "Attention",
    "contrastive learning": "Contrastive Learning", "prompt learning": "Prompt Learning", "knowledge distillation": "Knowledge Distillation",
    "knowledge graph": "Knowledge Graph", "benchmark": "Benchmark", "dataset": "Dataset", "ablation": "Ablation Study",
    "classification": "Classification", "recognition": "Recognition",
}
# Fixed values, the other half of the table above: a tag need only hold one of these keys, where those above must be equal.
CHINESE_TAGS = {
    "情感": "Emotion", "情感识别": "Emotion Recognition", "视觉情感": "Visual Emotion Recognition", "表情识别": "Facial Expression Recognition",
    "面部表情": "Facial Expression Recognition", "动作单元": "Action Unit", "跨域": "Cross-Domain", "领域自适应": "Domain Adaptation",
    "无监督": "Unsupervised Learning", "扩散": "Diffusion", "多模态": "Multimodal", "图像": "Image", "视频": "Video", "音频": "Audio", "文本": "Text",
}
# Words that are written in capitals.
ACRONYMS = ("ai", "au", "clip", "fer", "gan", "llm", "moe", "nlp", "uc", "vae", "ver", "vlm")
MOST_TAGS = 5


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def format_tag(column: Column) -> Column:
    """Words divided by spaces, each capitalised but for acronyms and words in capitals."""
    words = F.split(t.squeeze(F.regexp_replace(column, "[_-]+", " ")), " ")

    def word(w: Column) -> Column:
        return (
            F.when(F.lower(w) == "lora", "LoRA")
            .when(F.lower(w).isin(*ACRONYMS), F.upper(w))
            .when((F.length(w) > 1) & w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}"), w)
            .otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))
        )

    return F.array_join(F.transform(words, word), " ")


def normalize_tag(column: Column) -> Column:
    """A tag's canonical form: alias, else the first Chinese key it holds, else formatted; null for others."""
    edge = r"[ \t\r\n,;|/、，；]+"
    tag = F.regexp_replace(t.squeeze(F.regexp_replace(F.coalesce(column, F.lit("")), "[`*_#]+", " ")), f"^{edge}|{edge}$", "")
    key = F.trim(F.regexp_replace(F.lower(tag), "[^a-z0-9]+", " "))
    chinese = F.coalesce(*[F.when(tag.contains(k), F.lit(v)) for k, v in CHINESE_TAGS.items()])
    return (
        F.when(tag == "", None)
        .when(_map(TAG_ALIASES)[key].isNotNull(), _map(TAG_ALIASES)[key])
        .when(chinese.isNotNull(), chinese)
        .when(t.has_han(tag) | ~tag.rlike("[A-Za-z]"), None)
        .otherwise(format_tag(tag))
    )


def modality(explicit: Column, text: Column) -> Column:
    """The explicit modality if there is one; else the one whose words the text holds, multimodal for several, image for none."""
    lowered = F.lower(text)
    found = F.array_compact(
        F.array(*[F.when(reduce(lambda a, b: a | b, [lowered.contains(w) for w in words]), F.lit(name)) for name, words in MODALITY_WORDS])
    )
    inferred = F.when(F.size(found) > 1, "multimodal").when(F.size(found) == 1, found[0]).otherwise("image")
    return F.coalesce(F.when(~t.is_blank(explicit), t.strip(explicit)), inferred)


def _literals(pattern: str) -> list[str]:
    """Strings that every match of a rule's pattern holds."""
    plain = re.sub(r"\\[a-z]", " ", re.sub(r"[a-z0-9]\?", " ", pattern))
    return re.findall("[a-z0-9]{2,}", plain)


def _holds(text: Column, pattern: str) -> Column:
    """Whether the pattern matches; a substring search, which is far cheaper, goes first."""
    parts = _literals(pattern)
    if parts == [pattern]:
        return text.contains(pattern)
    quick = [text.contains(p) for p in parts]
    return reduce(lambda a, b: a & b, [*quick, text.rlike(pattern)])


def rule_tags(text: Column) -> Column:
    """Tags of the rules that fit, in the rules' order.

    The lower-cased text is bound once, however many rules read it.
    """

    def tags(lowered: Column) -> Column:
        fits = [F.when(reduce(lambda a, b: a | b, [_holds(lowered, p) for p in patterns]), F.lit(tag)) for tag, patterns in TAG_RULES]
        return F.array_compact(F.array(*fits))

    return F.transform(F.array(F.lower(text)), tags)[0]


def report_tags(text: Column, kind: Column, *own: Column, most: int = MOST_TAGS) -> Column:
    """``Emotion``, the rules' tags, the modality's, then the record's own lists; normalised, distinct without regard to case, the first ``most``."""
    by_kind = F.create_map(*[x for k, v in MODALITY_TAGS.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    key = F.trim(F.regexp_replace(F.lower(kind), "[^a-z0-9]+", " "))
    from_kind = F.coalesce(by_kind[key], F.when(kind != "", F.array(format_tag(kind))), F.array().cast("array<string>"))
    raw = F.concat(F.array(F.lit("Emotion")), rule_tags(text), from_kind, *[t.split_list(o) for o in own])
    normal = F.filter(F.transform(raw, normalize_tag), lambda x: x.isNotNull())
    return F.slice(t.distinct_ignoring_case(normal), 1, most)


def merge_tags(generated: Column, existing: Column, most: int = MOST_TAGS) -> Column:
    """Both arrays' tags, normalised, distinct without regard to case, the first ``most``; null arrays count as empty."""
    none = F.array().cast("array<string>")
    normal = F.transform(F.concat(F.coalesce(generated, none), F.coalesce(existing, none)), normalize_tag)
    return F.slice(t.distinct_ignoring_case(F.filter(normal, lambda x: x.isNotNull())), 1, most)


def report_id(explicit: Column, title: Column, stem: Column) -> Column:
    """Slug of the explicit id; else of the title's or stem's acronym; else of the title; else of the stem."""
    own = F.trim(F.regexp_replace(t.strip(F.coalesce(explicit, F.lit(""))), "(?i)^/blog/", ""), F.lit("/"))
    short = F.coalesce(F.nullif(t.acronym(t.clean_title(title)), F.lit("")), F.nullif(t.acronym(stem), F.lit("")), title)
    chosen = F.when(own == "", short).otherwise(own)
    return F.coalesce(F.nullif(t.slug(chosen), F.lit("")), t.slug(stem))


def report_metadata(papers: DataFrame) -> DataFrame:
    """Report records of (stem, full_text, title, paper_id, keywords, matched_keywords, abstract, venue, year): one per row.

    Null columns count as missing.  The title comes from the row, the text's
    first heading or the stem; year and venue from the row or the stem.
    """
    source = t.source_of_stem(F.col("stem"))
    text = F.coalesce(F.col("full_text"), F.lit(""))
    full = t.first_filled(F.col("title"), t.markdown_title(text), source["title"])
    row_text = t.first_filled(F.col("title"), F.col("keywords"), F.col("abstract"))
    kind = modality(F.lit(None).cast("string"), F.concat_ws(" ", row_text, F.substring(text, 1, 4000)))
    # A generator of one row keeps title and modality from being evaluated once for each of their uses.
    known = F.explode(F.array(F.struct(full.alias("full"), kind.alias("modality")))).alias("__known")
    base = papers.select("*", known).withColumns({"__full": F.col("__known.full"), "modality": F.col("__known.modality")})
    tag_text = F.concat_ws(" ", "__full", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "keywords", "abstract", "matched_keywords")], F.substring(text, 1, 10_000))
    return base.select(
        report_id(F.col("paper_id"), F.col("__full"), F.col("stem")).alias("id"),
        t.short_title(F.col("__full"), F.col("stem")).alias("title"),
        F.col("__full").alias("fullTitle"),
        t.infer_year(t.first_filled(F.col("year"), source["year"])).alias("year"),
        t.first_filled(F.col("venue"), source["venue"]).alias("venue"),
        "modality",
        report_tags(tag_text, F.col("modality"), F.col("matched_keywords"), F.col("keywords")).alias("tags"),
        t.first_filled(F.col("abstract"), t.named_section(text, "abstract", 500)).alias("introduction"),
    )


def good_chinese(column: Column) -> Column:
    """Chinese of at least 12 characters without a mark of failure."""
    # Marks of a failed summary.
    bad = reduce(lambda a, b: a | b, [F.lower(column).contains(m) for m in ("llm 总结失败", "请修复")])
    return F.coalesce(t.has_han(column) & ~bad & (F.length(column) >= 12), F.lit(False))


def chinese_introduction(current: Column, title: Column) -> Column:
    """The introduction if it is Chinese, as running text; else one general sentence about the title."""
    name = t.first_filled(title, F.lit("该论文"))
    general = F.concat(F.lit("本文围绕《"), name, F.lit("》展开研究，主要内容包括问题背景、方法设计、实验结果和可借鉴点，详见对应博客总结。"))
    return F.when(F.coalesce(t.has_han(current), F.lit(False)), t.intro_text(current)).otherwise(general)


def introduction_from_summary(markdown: Column) -> Column:
    """Good sentences on core question, method, motivation and task of a Chinese summary, until 220 characters, cut to 320; empty if there are none."""

    def first_good(names: list[str]) -> Column:
        body = t.intro_text(t.summary_section(markdown, names, 1200))
        good = F.filter(t.simple_sentences(body), good_chinese)
        return F.when(F.size(good) > 0, good[0]).when(good_chinese(body), body).otherwise("")

    found = F.array(
        first_good(["核心问题"]), first_good(["方法介绍", "方法概述"]), first_good(["动机和思想"]), t.info_field(markdown, "研究任务")
    )
    kept = F.aggregate(
        F.array_distinct(F.filter(F.transform(found, lambda x: t.intro_text(x)), good_chinese)),
        F.lit(""),
        lambda held, x: F.when(F.length(held) >= 220, held).otherwise(F.concat_ws(" ", F.nullif(held, F.lit("")), x)),
    )
    return t.truncate_intro(kept, 320)


def report_paths(ident: Column) -> Column:
    """struct of the paths that belong to a report."""
    return F.struct(
        F.concat(F.lit("reports/"), ident, F.lit("/paper.json")).alias("metadata"),
        F.concat(F.lit("reports/"), ident, F.lit("/blog.md")).alias("blog"),
        F.concat(F.lit("reports/"), ident, F.lit("/img")).alias("images"),
        F.concat(F.lit("/blog/"), ident).alias("slug"),
    )
