"""Names for characters that don't show, and texts in which these stand in their place."""

from __future__ import annotations

from pyspark.sql import functions as F

# The short names of the ASCII controls, and the marks of invisible characters by code point.
CONTROLS = "NUL SOH STX ETX EOT ENQ ACK BEL BS HT LF VT FF CR SO SI DLE DC1 DC2 DC3 DC4 NAK SYN ETB CAN EM SUB ESC FS GS RS US SP DEL BLANK OB NL DEL2 SUB2".split()
MARKS = {
    0x0000: "NUL", 0x001B: "ESC", 0x007F: "DEL", 0x0085: "NEL", 0x00A0: "NBSP", 0x00AD: "SHY", 0x034F: "CGJ", 0x061C: "ALM",
    0x0F08: "TIB:SS", 0x0F0C: "TIB:DT", 0x0F12: "TIB:RGS", 0x115F: "HCF", 0x1160: "HJF", 0x1680: "OSM", 0x17B4: "KHM:AQ", 0x17B5: "KHM:AA",
    0x1802: "MNG:C", 0x1803: "MNG:FS", 0x1808: "MNG:MC", 0x1809: "MNG:MFS", 0x180E: "MVS",
    0x2000: "EQ", 0x2001: "MQ", 0x2002: "ENSP", 0x2003: "EMSP", 0x2004: "3/EM", 0x2005: "4/EM", 0x2006: "6/EM", 0x2007: "FIGSP", 0x2008: "PUNCSP", 0x2009: "THIN", 0x200A: "HAIR",
    0x200B: "ZWSP", 0x200C: "ZWNJ", 0x200D: "ZWJ", 0x200E: "LRM", 0x200F: "RLM", 0x2011: "NBH", 0x2024: "ODL", 0x2028: "LS", 0x2029: "PS",
    0x202A: "LRE", 0x202B: "RLE", 0x202C: "PDF", 0x202D: "LRO", 0x202E: "RLO", 0x202F: "NNBSP", 0x205F: "MMSP",
    0x2060: "WJ", 0x2061: "FA", 0x2062: "IT", 0x2063: "IS", 0x2064: "INV+", 0x2066: "LRI", 0x2067: "RLI", 0x2068: "FSI", 0x2069: "PDI",
    0x206A: "ISS", 0x206B: "ASS", 0x206C: "IAFS", 0x206D: "AAFS", 0x206E: "NDS", 0x206F: "NODS", 0x2800: "BRAILLE", 0x3000: "IDSP", 0x3164: "HF",
    0xFEFF: "BOM", 0xFFA0: "HHF", 0xFFF9: "IAA", 0xFFFA: "IAS", 0xFFFB: "IAT", 0xFFFC: "OBJ", 0x13437: "EGY:BS", 0x13438: "EGY:ES",
    0x1BCA0: "SHORT:LO", 0x1BCA1: "SHORT:CO", 0x1BCA2: "SHORT:DS", 0x1BCA3: "SHORT:UP",
    0x1D173: "MUS:BB", 0x1D174: "MUS:EB", 0x1D175: "MUS:BT", 0x1D176: "MUS:ET", 0x1D177: "MUS:BS", 0x1D178: "MUS:ES", 0x1D179: "MUS:BP", 0x1D17A: "MUS:EP",
    0xE0001: "TAG:LANG", 0xE007F: "TAG:CANCEL",
}


def marks() -> dict[str, str]:
    """Character -> its mark in brackets: the named ones, and by rule controls, noncharacters, control pictures, tags and selectors."""
    out = {p: f"CTL:0x{p:02X}" for p in (*range(0x01, 0x20), *range(0x80, 0xA0)) if p not in (0x09, 0x0A, 0x0D)}
    out |= {p: f"NON:{p - 0xFDD0:02X}" for p in range(0xFDD0, 0xFDF0)}
    out |= {0x2400 + i: f"PIC:{name}" for i, name in enumerate(CONTROLS)}
    out |= {0xE0000 + p: f"TAG:U+{0xE0000 + p:X}" for p in range(0x20)}
    out |= {0xE0000 + p: f"TAG:{'SP' if p == 0x20 else chr(p)}" for p in range(0x20, 0x7F)}
    out |= {0xFE00 + i: f"VS{i + 1}" for i in range(16)} | {0xE0100 + i: f"VS{i + 17}" for i in range(240)}
    return {chr(p): f"[{name}]" for p, name in sorted((out | MARKS).items())}


def pattern() -> str:
    """One class of all characters that have a mark."""
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in marks()) + "]"


def revealed(text: str = "text") -> F.Column:
    """The text with marks for its invisible characters: one replacement for each of those that it holds (few), not for each place."""
    table = F.create_map(*[F.lit(x) for pair in marks().items() for x in pair])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern()})"), F.lit(1)))
    return F.when(F.col(text).rlike(pattern()), F.aggregate(found, F.col(text), lambda t, c: F.replace(t, c, F.element_at(table, c)))).otherwise(F.col(text))
