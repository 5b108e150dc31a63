"""Character classes, in the notation that Java's and RE2's regular expressions share."""

# Code points of the Unicode properties and controls that the operators name.
BIDI = r"\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}"
JOIN = r"\x{200C}\x{200D}"
TAGS = r"\x{E0000}-\x{E007F}"
SELECTORS = r"\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
IGNORABLE = r"\x{00AD}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}\x{2060}-\x{2065}\x{206A}-\x{206F}\x{3164}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{1BCA0}-\x{1BCA3}\x{1D173}-\x{1D17A}"
SPACES = r"\x{00A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
NONCHARACTERS = r"\x{FDD0}-\x{FDEF}" + "".join(rf"\x{{{p:X}FFFE}}\x{{{p:X}FFFF}}" if p else r"\x{FFFE}\x{FFFF}" for p in range(17))
INVISIBLE = BIDI + JOIN + TAGS + SELECTORS + IGNORABLE
#: Invisible characters that no script needs between letters; joiners are in order inside complex scripts.
SMUGGLED = BIDI + TAGS + SELECTORS + IGNORABLE
PICTOGRAPHS = r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{2600}-\x{27BF}"
REGIONAL = r"\x{1F1E6}-\x{1F1FF}"
SKIN = r"\x{1F3FB}-\x{1F3FF}"

#: Flag -> (severity, pattern of one code point or sequence).
FLAGS = {
    "noncharacter": ("critical", f"[{NONCHARACTERS}]"),
    "bidi_control": ("critical", f"[{BIDI}]"),
    "join_control": ("critical", f"[{JOIN}]"),
    "true_ignorable_cf": ("warn", r"[\x{00AD}\x{0600}-\x{0605}\x{06DD}\x{070F}\x{180E}\x{200B}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}]"),
    "other_default_ignorable": ("warn", r"[\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{2065}\x{3164}\x{FFA0}\x{FFF0}-\x{FFF8}]"),
    "deceptive_spaces": ("warn", f"[{SPACES}]"),
    "dash": ("info", r"[\x{002D}\x{058A}\x{05BE}\x{1400}\x{1806}\x{2010}-\x{2015}\x{2053}\x{207B}\x{208B}\x{2212}\x{2E3A}\x{2E3B}\x{301C}\x{3030}\x{FE31}\x{FE32}\x{FE58}\x{FE63}\x{FF0D}]"),
    "quotation_mark": ("info", r"[\x{0022}\x{0027}\x{00AB}\x{00BB}\x{2018}-\x{201F}\x{2039}\x{203A}\x{300C}-\x{300F}\x{301D}-\x{301F}\x{FF02}\x{FF07}]"),
    "terminal_punctuation": ("info", r"[!,.:;?\x{061B}\x{061F}\x{06D4}\x{0964}\x{0965}\x{203C}\x{203D}\x{2047}-\x{2049}\x{3001}\x{3002}\x{FF01}\x{FF0C}\x{FF0E}\x{FF1A}\x{FF1B}\x{FF1F}]"),
    "logical_order_exception": ("info", r"[\x{0E40}-\x{0E44}\x{0EC0}-\x{0EC4}\x{19B5}-\x{19B7}\x{19BA}\x{AAB5}\x{AAB6}\x{AAB9}\x{AABB}\x{AABC}]"),
    "bidi_paired_bracket": ("info", r"[()\[\]{}\x{0F3A}-\x{0F3D}\x{169B}\x{169C}\x{2045}\x{2046}\x{2308}-\x{230B}\x{2329}\x{232A}\x{3008}-\x{3011}\x{3014}-\x{301B}]"),
    "security_discouraged_block": ("warn", r"[\x{FF00}-\x{FFEF}\x{2460}-\x{24FF}\x{1D400}-\x{1D7FF}]"),
    "variation_selector": ("info", f"[{SELECTORS}]"),
    "emoji_modifier": ("info", f"[{SKIN}]"),
    "ivs_stego": ("warn", r"[\x{E0100}-\x{E01EF}]"),
    "unicode_tags": ("critical", f"[{TAGS}]"),
    "deceptive_newline": ("warn", r"[\x{2028}\x{2029}]"),
    "esc_terminal": ("critical", r"\x{001B}"),
    "interlinear": ("critical", r"[\x{FFF9}-\x{FFFB}]"),
    "zombie_controls": ("critical", r"[\x{206A}-\x{206F}]"),
    "version_drift": ("warn", r"[\x{F951}\x{2F868}\x{2F874}\x{2F91F}\x{2F95F}\x{2F9BF}]"),
    "private_use": ("warn", r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"),
    "controls": ("warn", r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"),
    "replacement": ("critical", r"\x{FFFD}"),
    "combining_mark": ("info", r"\p{M}"),
    "invisible_math": ("critical", r"[\x{2061}-\x{2064}]"),
    "vertical_forms": ("warn", r"[\x{FE10}-\x{FE1F}\x{FE30}-\x{FE4F}]"),
    "hangul_decomposed": ("warn", r"[\x{1100}-\x{11FF}]"),
    "radical_spoof": ("warn", r"[\x{2E80}-\x{2EF3}\x{2F00}-\x{2FD5}]"),
    "tofu_nushu": ("info", r"[\x{16FE1}\x{1B170}-\x{1B2FB}]"),
    "math_masquerade": ("warn", r"[\x{2190}-\x{22FF}]"),
    "any_invisible": ("warn", f"[{INVISIBLE}]"),
}
#: Flags of sequences, where only the count is given.
SEQUENCES = {
    "illformed_tag_seq": r"[\x{E0020}-\x{E007E}]+(?:[^\x{E0020}-\x{E007F}]|\z)",
    "broken_keycap": r"(?:^|[^0-9#*\x{FE0F}])\x{20E3}",
    "forced_text_presentation": f"[{PICTOGRAPHS}]" + r"\x{FE0E}",
    "forced_emoji_presentation": r"[0-9#*\x{00A9}\x{00AE}\x{2190}-\x{27BF}]\x{FE0F}",
    "standalone_component": rf"(?:^|[\s])[{SKIN}\x{{200D}}]",
    "vs_cluster": f"[{SELECTORS}]{{2,}}",
    "vs_flood": f"[{SELECTORS}]{{5,}}",
    "vs_bare": rf"(?:^|[\s])[{SELECTORS}]",
    "vs_on_syntax": r"[!-/:-@\[-\x{0060}\x{007B}-~][\x{FE00}-\x{FE0F}]",
    "repeated_mark": r"\p{M}{3,}",
    "invisible_run": f"[{INVISIBLE}]{{4,}}",
    "regional_pair": f"[{REGIONAL}][{REGIONAL}]",
    "overlay_confusable": r"\p{L}[\x{0334}-\x{0338}]",
}
