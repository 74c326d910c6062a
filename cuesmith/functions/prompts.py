"""Requests to translation models as columns, one profile each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuesmith.functions.text import neutral_tokens, source_language

# The models' own request formats and the instructions that recorded requests hold.
NAMES = {"en": "English", "zh": "Chinese", "ja": "Japanese", "ko": "Korean"}
CHINESE_NAMES = {"en": "英语", "zh": "中文", "ja": "日语", "ko": "韩语"}
JAKOVN = "<start_of_turn>system\n당신은 전문 일한 번역가입니다. 주어진 일본어를 한국어로 번역하세요.<end_of_turn>\n<start_of_turn>user\n%s<end_of_turn>\n<start_of_turn>model\n"
GEMMA = (
    "<start_of_turn>user\nYou are a professional %s (%s) to {t} ({c}) translator. Your goal is to accurately convey the meaning and nuances of the original %s text while adhering to {t} grammar, vocabulary, "
    "and cultural sensitivities.\nProduce only the {t} translation, without any additional explanations or commentary. Please translate the following %s text into {t}:\n\n\n%s<end_of_turn>\n<start_of_turn>model\n"
)
MILMMT = "Translate this from %s to {t}:\n%s: %s\n{t}:"
HY_ENGLISH = (
    "Use natural, concise {t} subtitles. Preserve the source's politeness, formality, and tone. Do not add insults, facts, guesses, or missing sentence endings. "
    "Translate only the following source text; use background information only for understanding, and do not translate it.\n"
    "Translate the following text into {t}. Note that you should only output the translated result without any additional explanation:\n\n"
)
HY_CHINESE = (
    "使用自然、简洁的{t}字幕，保留原文的敬语、非敬语和语气。不要添加原文没有的辱骂、事实或推测，不要补全未说完的话。"
    "仅翻译下面的原文，背景信息只供理解，不要翻译背景信息。\n将以下文本翻译为{t}，注意只需要输出翻译后的结果，不要额外解释：\n\n"
)


def _name(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), code)


def jakovn(text: Column) -> Column:
    return F.format_string(JAKOVN, neutral_tokens(F.trim(text)))


def gemma(text: Column, code: Column, target: str = "ko") -> Column:
    source = source_language(text, code)
    form = GEMMA.format(t=NAMES[target], c=target)
    return F.format_string(form, _name(source), source, _name(source), _name(source), neutral_tokens(F.trim(text)))


def milmmt(text: Column, code: Column, target: str = "ko") -> Column:
    """Chinese is called simplified unless its code names the traditional script or a region that writes it."""
    source = source_language(text, code)
    parts = F.split(F.translate(F.lower(F.trim(F.coalesce(code, F.lit("")))), "_", "-"), "-")
    rest = F.slice(parts, 2, F.size(parts))
    has = lambda *x: F.arrays_overlap(rest, F.array(*map(F.lit, x)))
    chinese = F.when(has("hant") | (~has("hans") & has("tw", "hk", "mo")), "Chinese (Traditional)").otherwise("Chinese (Simplified)")
    name = F.when(source == "zh", chinese).otherwise(_name(source))
    to = "Chinese (Simplified)" if target == "zh" else NAMES[target]
    return F.format_string(MILMMT.format(t=to), name, name, neutral_tokens(F.trim(text)))


def hymt2(text: Column, code: Column, context: Column, terms: Column, target: str = "ko") -> Column:
    """context: array of earlier texts; terms: array of (source, target), used for Korean only. Either may be empty."""
    chinese = source_language(text, code) == "zh"
    clean = F.transform(F.coalesce(context, F.array().cast("array<string>")), neutral_tokens)
    background = F.concat(F.when(chinese, "〖背景信息〗").otherwise("[Background Information]"), F.lit("\n"), F.array_join(clean, "\n"))
    lines = F.transform(terms, lambda t: F.concat(neutral_tokens(t["source"]), F.when(chinese, " 翻译成 ").otherwise(" translates to "), neutral_tokens(t["target"])))
    glossary = F.concat(F.when(chinese, "参考下面的翻译：").otherwise("Reference the following translations:"), F.lit("\n"), F.array_join(lines, "\n"))
    ask = F.when(chinese, HY_CHINESE.format(t=CHINESE_NAMES[target])).otherwise(HY_ENGLISH.format(t=NAMES[target]))
    use = F.size(F.coalesce(terms, F.array())) > 0 if target == "ko" else F.lit(False)
    return F.concat_ws("\n\n", F.when(F.size(clean) > 0, background), F.when(use, glossary), F.concat(ask, neutral_tokens(F.trim(text))))
