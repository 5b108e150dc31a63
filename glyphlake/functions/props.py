"""Unicode properties of one character, from the runtime's tables; each process keeps what it has looked up."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import regex

# Short names of the values of the properties that only patterns know.
VALUES = {
    "linebreak": ("Line_Break", "AI AL B2 BA BB BK CB CJ CL CM CP CR EB EM EX GL H2 H3 HL HY ID IN IS JL JT JV LF NL NS NU OP PO PR QU RI SA SG SP SY WJ XX ZW ZWJ"),
    "wordbreak": ("Word_Break", "CR EX Extend FO HL KA LE LF MB ML MN NL NU RI SQ DQ WSegSpace ZWJ XX"),
    "sentencebreak": ("Sentence_Break", "AT CL CR EX FO LE LF LO NU SC SE SP ST UP XX"),
    "graphemebreak": ("Grapheme_Cluster_Break", "CN CR EX L LF LV LVT PP RI SM T V ZWJ XX"),
    "joining": ("Joining_Type", "C D L R T U"),
    "syllabic": ("Indic_Syllabic_Category", "Vowel_Dependent Vowel_Independent Consonant Virama Nukta Bindu Other"),
}
# Binary properties that are reported as flags, and how the pattern language names them.
BINARY = {"deprecated": "Deprecated", "extender": "Extender", "dash": "Dash", "quotation_mark": "Quotation_Mark", "terminal_punctuation": "Terminal_Punctuation", "extended_pictographic": "Extended_Pictographic", "default_ignorable": "Default_Ignorable_Code_Point", "logical_order_exception": "Logical_Order_Exception", "id_start": "ID_Start", "noncharacter": "Noncharacter_Code_Point", "emoji": "Emoji", "emoji_presentation": "Emoji_Presentation", "emoji_modifier_base": "Emoji_Modifier_Base"}


@cache
def _patterns(name: str) -> list[tuple[str, regex.Pattern]]:
    long, values = VALUES[name]
    out = []
    for v in values.split():
        try:
            out.append((v, regex.compile(rf"\p{{{long}={v}}}")))
        except regex.error:  # a value that these tables don't have
            continue
    return out


def _by_pattern(name: str) -> Callable[[str], str]:
    @cache
    def of(c: str) -> str:
        return next((v for v, p in _patterns(name) if p.match(c)), "XX")

    return of


# Names of scripts, the frequent ones first.
SCRIPTS = """Latin Common Inherited Cyrillic Greek Han Hiragana Katakana Hangul Arabic Hebrew Devanagari Thai Armenian Georgian Bengali Tamil Telugu Ethiopic Syriac Mongolian Nushu
Adlam Avestan Balinese Bamum Batak Bopomofo Brahmi Braille Buginese Buhid Canadian_Aboriginal Carian Chakma Cham Cherokee Coptic Cuneiform Cypriot Deseret Duployan Egyptian_Hieroglyphs Elbasan Glagolitic Gothic Grantha Gujarati Gurmukhi
Hanunoo Imperial_Aramaic Javanese Kaithi Kannada Kayah_Li Kharoshthi Khmer Khojki Lao Lepcha Limbu Linear_A Linear_B Lisu Lycian Lydian Malayalam Mandaic Meetei_Mayek Mende_Kikakui Meroitic_Cursive Miao Modi Myanmar New_Tai_Lue Nko
Ogham Ol_Chiki Old_Italic Old_Persian Old_Turkic Oriya Osage Osmanya Pahawh_Hmong Phags_Pa Phoenician Rejang Runic Samaritan Saurashtra Sharada Shavian Sinhala Sora_Sompeng Sundanese Syloti_Nagri
Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tangut Thaana Tibetan Tifinagh Tirhuta Ugaritic Vai Wancho Warang_Citi Yezidi Yi""".split()


@cache
def _scripts() -> list[tuple[str, regex.Pattern]]:
    return [(s, regex.compile(rf"\p{{Script={s}}}")) for s in SCRIPTS]


@cache
def _extensions() -> list[tuple[str, regex.Pattern]]:
    return [(s, regex.compile(rf"\p{{Script_Extensions={s}}}")) for s in SCRIPTS]


@cache
def extensions_of(c: str) -> tuple[str, ...]:
    """All scripts that use a character."""
    return tuple(s for s, p in _extensions() if p.match(c)) or ("Other",)


@cache
def script_of(c: str) -> str:
    return next((s for s, p in _scripts() if p.match(c)), "Other")


#: Property -> its value for a character.
PROPERTIES: dict[str, Callable[[str], str]] = {
    "major": cache(lambda c: unicodedata.category(c)[0]), "minor": cache(unicodedata.category), "bidi": cache(lambda c: unicodedata.bidirectional(c) or "none"),
    "eaw": cache(unicodedata.east_asian_width), "ccc": cache(lambda c: str(unicodedata.combining(c))), "script": script_of, **{n: _by_pattern(n) for n in VALUES},
}


@cache
def _binary() -> list[tuple[str, regex.Pattern]]:
    return [(n, regex.compile(rf"\p{{{p}}}")) for n, p in BINARY.items()]


@cache
def flags_of(c: str) -> tuple[str, ...]:
    """Names of the flags that hold for a character."""
    out = [n for n, p in _binary() if p.match(c)]
    kind = unicodedata.decomposition(c)
    own = {
        "unassigned": unicodedata.category(c) == "Cn", "bidi_mirrored": bool(unicodedata.mirrored(c)),
        "compatibility_decomposition": kind.startswith("<"), "canonical_decomposition": bool(kind) and not kind.startswith("<"),
        "composition_excluded": bool(kind) and not kind.startswith("<") and unicodedata.normalize("NFC", c) != c,
        "changes_on_nfkc_casefold": unicodedata.normalize("NFKC", c).casefold() != c,
    }
    return tuple(out + [n for n, v in own.items() if v])


#: Characters that mean something to SQL, markup and shells.
HAZARDS = set("'\"<>&;|`$\\/%(){}=")


@cache
def effects_of(c: str) -> tuple[str, ...]:
    """What case and compatibility mappings do to a character."""
    k, beyond = unicodedata.normalize("NFKC", c), ord(c) > 127
    again = k
    for _ in range(4):
        again = unicodedata.normalize("NFKC", again)
    own = {
        "case_expansion": len(c.upper()) > len(c) or len(c.lower()) > len(c),
        "case_to_ascii": beyond and (c.upper().isascii() or c.lower().isascii()),
        "case_unstable": c.upper().lower() != c.lower(),
        "syntax_predator": beyond and any(x in HAZARDS for x in k),
        "ascii_compression": beyond and len(k) > 1 and k.isascii(),
        "bomb": len(k) > 10,
        "drift": again != k,
        "fusion": unicodedata.combining(c) > 0,
        "mutation": k != c,
    }
    return tuple(n for n, v in own.items() if v)
