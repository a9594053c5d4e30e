"""Character classes, markers and word lists that operators take as parameters.

Fixed values: results depend on exactly these characters and words.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Script:
    """What text operators need to know of a script: ``letters`` as the inside of a character class of regular
    expressions, edges of clauses, marks of prose, markers of an unwanted variant."""

    letters: str
    edges: str
    prose_marks: str
    markers: str


#: Chinese: unified ideographs with extension A; traditional forms whose simplified counterpart differs.
HAN = Script(
    letters="一-鿿㐀-䶿",
    edges="，。！？；：、,.!?;:…～~ ",
    prose_marks="，。；：！？",
    markers=(
        "們來這國會個時發當後萬與東車長門問開關電話語說讀點對還進遠過樣學實現經濟應該為數屬體麼兩內從產業讓認機動華區"
        "邏輯嚴謹導詞稱種義議論據處質網統標準級結構總織線給續練縮聯興舉寫農運達適選鐵錄鐘銀陸際隨險難靜韓頭題顯風飛馬驗黨齊龍"
    ),
)
#: The unified ideographs alone, by which prose is judged.
PROSE_LETTERS = "一-鿿"
#: Any letters, with Latin punctuation; markers are accented letters of other languages than English.
LATIN = Script(letters="\\p{L}", edges=",.!?;: \n", prose_marks=",.;:!?", markers="äöüßéèêçñíó")

SPAM_TERMS = ("彩票", "时时彩", "快三", "11选5", "开奖", "棋牌", "博彩", "百家乐", "六合彩", "赌场", "娱乐城", "投注", "北京赛车", "pk10", "PK10")
UNTYPABLE_READINGS = ("n", "ng", "m", "hm", "hng")
SWAPPED_PRONOUNS = "他她它"
PERMISSIVE_LICENSES = ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "Unlicense")
SHARE_ALIKE_MARKERS = ("Wikipedia", "MDN", "CC BY-SA", "CC-BY-SA")

#: Keys of two-letter initials and of finals in the double-key layout.
DOUBLE_KEY_INITIALS = {"sh": "u", "ch": "i", "zh": "v"}
DOUBLE_KEY_FINALS = {
    "iu": "q", "ei": "w", "e": "e", "uan": "r", "ue": "t", "ve": "t", "un": "y", "u": "u", "i": "i", "uo": "o", "o": "o",
    "ie": "p", "a": "a", "ong": "s", "iong": "s", "ai": "d", "en": "f", "eng": "g", "ang": "h", "an": "j", "uai": "k",
    "ing": "k", "uang": "l", "iang": "l", "ou": "z", "ua": "x", "ia": "x", "ao": "c", "ui": "v", "v": "v", "in": "b",
    "iao": "n", "ian": "m",
}

#: Markup, in the order in which it is removed.
WIKI_LINK = r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]"
WIKI_TEMPLATE = r"(?s)\{\{[^{}]*\}\}"
WIKI_NOISE = (
    r"(?s)<ref.*?(?:/>|</ref>)",
    r"(?s)<!--.*?-->",
    r"(?s)<(math|code|pre|gallery|timeline)[^>]*>.*?</\1>",
    WIKI_TEMPLATE,
    r"(?s)\{\|.*?\|\}",
    r"\[\[(?:File|Image|檔案|文件|图像|圖像):[^\]]*\]\]",
    r"</?[a-zA-Z][^>]*>",
    r"(?m)^[*#:;=|!].*$",
)
MARKDOWN_LINK = r"!?\[([^\]]*)\]\([^)]*\)"
MARKDOWN_NOISE = (
    r"(?s)^---\n.*?\n---\n",
    r"(?s)```.*?```",
    r"(?s)<!--.*?-->",
    r"(?s)\{\{%.*?%\}\}",
    r"(?s)\{\{<.*?>\}\}",
    r"`[^`]*`",
    MARKDOWN_LINK,
    r"</?[a-zA-Z][^>]*>",
    r"(?m)^\s*\|.*$",
)

MIN_RUN, MAX_RUN = 4, 96
MARKER_SHARE = 0.005
PROSE_SAMPLE, PROSE_LEAST, PROSE_SHARE, PROSE_RUN = 4000, 64, 0.5, 8
CLAUSE_MIN, CLAUSE_MAX = 4, 16
WORD_MIN, WORD_MAX = 2, 4
CONTEXT_BYTES, CONTEXT_STEP = 1024, 16
WINDOW = 8
DEV_SHARE = 25
PER_DIALOGUE, PER_DOCUMENT = 3, 2
COMPARED = 9
DICTIONARY_SOURCES, DECODER_SOURCES = (0, 1), (8, 9)
RESERVED_IDS = ("<pad>", "<unk>", "<bos>")
Z_95, Z_POWER_80 = 1.959963984540054, 0.8416212335729143

# Names of subsets of cases and who belongs to them, as reports have them.
SUBSETS = {
    "clause/full": "level = 'clause' AND style = 'full'",
    "clause/full/context": "level = 'clause' AND style = 'full' AND has_context",
    "clause/full/none": "level = 'clause' AND style = 'full' AND NOT has_context",
    "clause/full/context-stripped": "level = 'clause' AND style = 'full' AND stripped",
    "word/full": "level = 'word' AND style = 'full'",
    "word/full/context": "level = 'word' AND style = 'full' AND has_context",
    "word/full/none": "level = 'word' AND style = 'full' AND NOT has_context",
    "word/full/context-stripped": "level = 'word' AND style = 'full' AND stripped",
    "word/initials": "level = 'word' AND style = 'initials'",
    "word/initials/context": "level = 'word' AND style = 'initials' AND has_context",
    "word/initials/none": "level = 'word' AND style = 'initials' AND NOT has_context",
    "word/initials/context-stripped": "level = 'word' AND style = 'initials' AND stripped",
    "word/mixed": "level = 'word' AND style = 'mixed'",
    "word/mixed/context": "level = 'word' AND style = 'mixed' AND has_context",
    "word/mixed/none": "level = 'word' AND style = 'mixed' AND NOT has_context",
    "word/mixed/context-stripped": "level = 'word' AND style = 'mixed' AND stripped",
    "clause/full/gov": "level = 'clause' AND origin = 'gov'",
    "clause/full/gov/context-stripped": "level = 'clause' AND origin = 'gov' AND stripped",
    "clause/full/dialogue": "level = 'clause' AND origin <> 'gov'",
    "clause/full/dialogue/context": "level = 'clause' AND origin <> 'gov' AND has_context",
    "clause/full/dialogue/context-stripped": "level = 'clause' AND origin <> 'gov' AND stripped",
    "clause/full/unseen": "level = 'clause' AND NOT seen",
    "clause/full/ta": "level = 'clause' AND swap",
    "clause/full/ta/context": "level = 'clause' AND swap AND has_context",
    "clause/full/ta/none": "level = 'clause' AND swap AND NOT has_context",
}
