"""Column expressions over caption text: scripts, routing, checks, keys and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Script ranges, labels and language codes that results depend on.
KANA = r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}\x{1b000}-\x{1b16f}]"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{323af}]"
HANGUL = r"[\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{a960}-\x{a97f}\x{ac00}-\x{d7af}\x{d7b0}-\x{d7ff}]"
LATIN = r"A-Za-z\x{c0}-\x{24f}\x{1e00}-\x{1eff}\x{2c60}-\x{2c7f}\x{a720}-\x{a7ff}\x{ab30}-\x{ab6f}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}"
LABELS = {
    "ko": r"^(?:한국어(?:\s*번역)?|번역)\s*[:：]\s*",
    "en": r"(?i)^(?:English(?:\s+translation)?|Translation)\s*[:：]\s*",
    "zh": r"^(?:中文(?:翻译)?|汉语|翻译)\s*[:：]\s*",
    "ja": r"^(?:日本語(?:訳|翻訳)?|翻訳)\s*[:：]\s*",
}
LANGUAGES = ("ko", "en", "zh", "ja")

SPACE = r"[\s\p{Z}]"


def normalized_language(code: Column, default: str = "auto") -> Column:
    """Trimmed lower-case code; null or blank is the default; null where it is none of LANGUAGES or the default."""
    c = F.coalesce(F.nullif(F.lower(F.trim(code)), F.lit("")), F.lit(default))
    return F.when(c.isin(*LANGUAGES, default), c)


def base_language(code: Column) -> Column:
    """A code without its region: zh-Hant and en_US are zh and en; auto for null or blank."""
    c = F.translate(F.lower(F.trim(F.coalesce(code, F.lit("")))), "_", "-")
    return F.when(c == "", F.lit("auto")).otherwise(F.split_part(c, F.lit("-"), F.lit(1)))


def source_language(text: Column, code: Column) -> Column:
    """An explicit code's base, else by script: kana, then Han, then Hangul, else English."""
    base = base_language(code)
    by_script = F.when(text.rlike(KANA), "ja").when(text.rlike(HAN), "zh").when(text.rlike(HANGUL), "ko").otherwise("en")
    return F.when(base != "auto", base).otherwise(by_script)


def punctuation_only(text: Column) -> Column:
    """True for texts of punctuation, symbols and space with at least one that is no space."""
    return text.rlike(r"^[\s\p{Z}\p{P}\p{S}]*$") & (F.regexp_replace(text, SPACE, "") != "")


def profile(path: Column) -> Column:
    """Prompt profile of a model file by its base name. The four patterns and their labels are fixed values."""
    name = F.lower(F.regexp_extract(F.translate(path, "\\", "/"), r"([^/]*)$", 1))
    return (
        F.when(name.rlike(r"(^|[^a-z0-9])ja[-_]ko[-_]vn[-_]12b[-_]v2($|[^a-z0-9])"), "jakovn")
        .when(name.rlike(r"(^|[^a-z0-9])translate[-_]?gemma($|[^a-z])"), "gemma")
        .when(name.rlike(r"(^|[^a-z0-9])hy[-_]?mt2($|[^a-z0-9])"), "hymt2")
        .when(name.rlike(r"(^|[^a-z0-9])milmmt[-_]46($|[^a-z0-9])"), "milmmt")
        .otherwise("generic")
    )


def route(text: Column, code: Column, target: Column, model: Column) -> Column:
    """How a row is handled: literal, passthrough, reject, or the prompt profile of its model."""
    source, kind = source_language(text, code), profile(model)
    literal = punctuation_only(text) & (F.length(F.trim(text)) <= 32)
    same = (base_language(code) == target) | ((base_language(code) == "auto") & (target == "ko") & (source == "ko"))
    one_way = (kind == "jakovn") & ~((source == "ja") & (target == "ko"))
    known = source.isin(*LANGUAGES)
    return F.when(literal, "literal").when(same, "passthrough").when(~known | one_way, "reject").otherwise(kind)


def neutral_tokens(text: Column) -> Column:
    """Angle-bracket token spellings with full-width brackets; comparisons such as x < 3 stay."""
    return F.regexp_replace(text, r"<(\|?[A-Za-z_][A-Za-z0-9_./:|+-]*\|?)>", "＜$1＞")


def leaked_envelope(text: Column) -> Column:
    """True where a text is a JSON object (in a code fence or not) with the request's own field names."""
    body = F.trim(text)
    body = F.when(body.startswith("```") & body.endswith("```"), F.trim(F.regexp_replace(body, r"(?is)^```(?:json)?\s*(.*)```$", "$1"))).otherwise(body)
    keys = F.when(body.startswith("{"), F.json_object_keys(body))
    return F.coalesce(F.array_contains(keys, "current_text") & F.arrays_overlap(keys, F.array(F.lit("source_language"), F.lit("target_language"), F.lit("context"))), F.lit(False))


def output_text(text: Column, target: str) -> Column:
    """A model's answer without its reasoning block and the target's label."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", "")), LABELS[target], "")


def in_target_script(text: Column, target: str) -> Column:
    """A check of scripts, not of language: letters must be of the target's script (zh and ja allow Latin beside
    it), or there are only numbers, symbols and a short upper-case label."""
    body = F.regexp_replace(F.trim(text), LABELS[target], "")
    neutral = r"\s\p{Z}\p{N}\p{P}\p{S}"
    upper = (body != "") & body.rlike(f"^[{neutral}A-Z]*$") & (~body.rlike("[A-Z]") | (F.length(body) <= 32))
    if target == "ko":
        cjk = KANA.replace(r"\x{1b000}-\x{1b16f}", "")
        good = ~body.rlike(cjk) & ~body.rlike(HAN) & (body.rlike(r"[가-힣ㄱ-ㅎㅏ-ㅣ\x{1100}-\x{11ff}\x{a960}-\x{a97f}\x{d7b0}-\x{d7ff}]") | upper)
    else:
        own = {"en": f"[{LATIN}]", "zh": HAN, "ja": f"(?:{HAN}|{KANA})"}[target]
        allowed = f"^(?:[{neutral}\\p{{M}}{LATIN}]" + ("" if target == "en" else f"|{own}") + ")*$"
        good = (body != "") & body.rlike(allowed) & (body.rlike(own) | upper)
    return F.coalesce(good & ~leaked_envelope(text), F.lit(False))


def output_status(text: Column, target: str, truncated: Column | None = None) -> Column:
    """ok, translation_truncated, translation_empty or translation_language."""
    body = output_text(F.coalesce(text, F.lit("")), target)
    empty = (F.trim(body) == "") | body.contains("<think>") | punctuation_only(body)
    status = F.when(empty, "translation_empty").when(~in_target_script(body, target), "translation_language").otherwise("ok")
    return status if truncated is None else F.when(truncated, "translation_truncated").otherwise(status)


def sentence_key(text: Column) -> Column:
    """For comparison only: lower case, without space and punctuation. (lower() keeps ß, which casefold() does not.)"""
    return F.regexp_replace(F.lower(text), r"[\s\p{Z}\p{P}]+", "")


def script_key(text: Column, variants: dict[str, str]) -> Column:
    """sentence_key() with characters that are variants of another (traditional forms, say) as that one; without a
    mapping nothing changes."""
    return F.translate(sentence_key(text), "".join(variants), "".join(variants.values())) if variants else sentence_key(text)


# Units that belong to the number before them.
UNITS = "[%％元块塊秒年月日个個台倍万萬亿億]|美元|日元|人民币|人民幣|分钟|分鐘|小时|小時|公里|公斤|毫秒|원|달러|초|분|시간|개"


# Patterns around a cut, which stands as NUL: one each, so that a row costs a few searches of a short text.
_CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}"
_JOINT = r"'’_\-‐‑"
_NUMBER = rf"\d[.,:，] *\x00 *\d|[0-9][A-Za-z0-9]* *\x00 *[A-Za-z0-9]|[A-Za-z0-9] *\x00 *[A-Za-z0-9]*[0-9]|\d *\x00 *(?:{UNITS})"
# What the two characters beside a cut say alone, for most cuts: space after no joint, and inside a word.
_SPACE, _WORD = rf"^[^{_JOINT}][\s\p{{Z}}]\z", rf"^[\p{{L}}\p{{N}}&&[^{_CJK}]]{{2}}\z"
_OPEN = rf"[^{_JOINT}]\x00[^\s\p{{Z}}\p{{M}}{_JOINT}]"
_PARTED = (
    r"^\p{M}*\x00|\p{Nd}\x00(?:[\p{L}\p{N}]|[.,，．]\p{Nd})|\p{Nd}[.,，．]\x00\p{Nd}"
    rf"|[\p{{L}}\p{{N}}&&[^{_CJK}]][\p{{M}}&&[^{_CJK}]]*\x00[\p{{L}}\p{{N}}&&[^{_CJK}]]"
)


def _cut(left: Column, right: Column) -> Column:
    """left and right with NUL between them; a NUL of theirs is another control character."""
    return F.concat(F.translate(left, "\0", "\1"), F.lit("\0"), F.translate(right, "\0", "\1"))


def numeric_split(left: Column, right: Column) -> Column:
    """True where a cut between left and right would part a number, a name with digits, or a number and its unit."""
    return F.coalesce(_cut(left, right).rlike(_NUMBER), F.lit(False))


def extends_draft(older: Column, newer: Column) -> Column:
    """older is a strict prefix of newer and ends at a boundary of words, of CJK characters or outside a number."""
    size = F.length(older)
    head = newer.startswith(older) & (size < F.length(newer)) & (older != "")
    beside = F.concat(F.right(older, F.lit(1)), F.substr(newer, size + 1, F.lit(1)))
    cut = _cut(older, F.substr(newer, size + 1, F.lit(2)))
    return F.coalesce(head & F.when(beside.rlike(_WORD), F.lit(False)).when(beside.rlike(_SPACE), F.lit(True)).otherwise(cut.rlike(_OPEN) & ~cut.rlike(_PARTED)), F.lit(False))


def short_fragment(text: Column) -> Column:
    """CJK texts of at most 6 letters and digits, others of at most 2 words and 24 letters and digits."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(text.rlike(HAN) | text.rlike(KANA), n <= 6).otherwise((F.size(F.filter(F.split(F.trim(text), r"[\s\p{Z}]+"), lambda w: w != "")) <= 2) & (n <= 24))


def meaningful_clause(text: Column) -> Column:
    """At least 6 CJK letters and digits, or 4 words."""
    n = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return F.when(text.rlike(HAN) | text.rlike(KANA), n >= 6).otherwise(F.size(F.filter(F.split(F.trim(text), r"[\s\p{Z}]+"), lambda w: w != "")) >= 4)


def reading_ms(text: Column, backlog: Column) -> Column:
    """Milliseconds to show a text: 500 and 75 for each visible grapheme, within 650 .. 3500, less with a backlog."""
    n = F.size(F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\X"), F.lit(0)), lambda g: ~g.rlike(rf"^{SPACE}+$")))
    base = F.greatest(F.lit(650.0), F.least(F.lit(3500.0), (500 + 75 * n).cast("double")))
    return base * F.when(backlog >= 6, 0.8).when(backlog >= 3, 0.9).otherwise(1.0)


def good_segment(no_speech: Column, logprob: Column, ratio: Column) -> Column:
    """False for segments that are likely no speech, or repeat themselves."""
    return ~F.coalesce(((no_speech > 0.6) & (logprob < -1)) | (ratio > 2.4), F.lit(False))
