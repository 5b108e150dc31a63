"""Operators that are one projection or aggregation in SQL: name -> text for both engines (see plans.template)."""

from __future__ import annotations

from glyphlake.functions import chars

#: Words that lure, commands that inject, and markup that executes.
LURES = r"(?i)(?:^|[^\p{L}\p{N}_])(?:login|password|verify|account|secure|update|bank|signin)(?:[^\p{L}\p{N}_]|\z)|//"
INJECTIONS = r"(?i)(?:ignore|disregard|forget) (?:all |any |the )?(?:previous|prior|above|earlier) (?:instructions|rules|messages)|disregard the above|system prompt|prompt override|you are now|(?:search|look) for [^\x{000A}]{1,80} and (?:send|post|forward) (?:it |them )?to|\x{001B}\[|[\x{E0000}-\x{E007F}]"
WAF = r"(?i)<script|javascript:|onerror\s*=|union\s+select|or\s+1=1|\.\./|/etc/passwd"

#: ASCII punctuation and symbols, as patterns.
ASCII_SYMBOLS = [rf"\x{{{p:04X}}}" for p in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x5F), 0x60, *range(0x7B, 0x7F))]
#: Alphabets that stand in for ASCII letters, by their ranges.
ALPHABETS = {
    "math": r"\x{1D400}-\x{1D7FF}", "math_bold": r"\x{1D400}-\x{1D433}", "math_italic": r"\x{1D434}-\x{1D467}", "math_script": r"\x{1D49C}-\x{1D503}", "math_fraktur": r"\x{1D504}-\x{1D537}\x{1D56C}-\x{1D59F}",
    "math_double": r"\x{1D538}-\x{1D56B}", "math_sans": r"\x{1D5A0}-\x{1D66F}", "math_mono": r"\x{1D670}-\x{1D6A3}", "math_greek": r"\x{1D6A8}-\x{1D7CB}", "math_digits": r"\x{1D7CE}-\x{1D7FF}",
    "enclosed": r"\x{2460}-\x{24FF}", "enclosed_supplement": r"\x{1F100}-\x{1F1E5}", "letterlike": r"\x{2100}-\x{214F}", "number_forms": r"\x{2150}-\x{218F}", "superscripts": r"\x{2070}-\x{209F}", "phonetic": r"\x{1D00}-\x{1DBF}", "ipa": r"\x{0250}-\x{02AF}", "modifiers": r"\x{02B0}-\x{02FF}",
    "fullwidth": r"\x{FF21}-\x{FF5A}", "halfwidth": r"\x{FF61}-\x{FFDC}", "braille": r"\x{2800}-\x{28FF}", "cherokee": r"\x{13A0}-\x{13FF}\x{AB70}-\x{ABBF}", "regional": r"\x{1F1E6}-\x{1F1FF}", "tags": chars.TAGS,
}
#: An agent between two letters that parts a token: invisibles, tags, joiners and emoji; punctuation is none.
FRACTURE = "[A-Za-z][" + chars.INVISIBLE + chars.PICTOGRAPHS + "]+[A-Za-z]"


def _doc(columns: str) -> str:
    return f"SELECT doc_id, {columns} FROM pdocs"


def _share(pattern: str) -> str:
    return f"CASE WHEN length(text) > 0 THEN @count{{{pattern}}} / CAST(length(text) AS DOUBLE) ELSE 0.0 END"


#: What the small Latin letters and spaces, which most of a text is, add to a category; the rest of the text is counted by patterns.
_ADDED = {"L": "letters + ", "Ll": "letters + ", "Z": "spaces + ", "Zs": "spaces + "}


def _rest(columns: str) -> str:
    without = "SELECT doc_id, length(text) AS whole, @del{[a-z]+} AS text FROM pdocs"
    spaceless = f"SELECT doc_id, whole - length(text) AS letters, length(text) AS whole, @del{{ +}} AS text FROM ({without})"
    return f"SELECT doc_id, {columns} FROM (SELECT doc_id, letters, whole - length(text) AS spaces, text FROM ({spaceless}))"


CATALOG: dict[str, str] = {
    # decomposition
    "atoms_tokens_whitespace": "SELECT tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[^ \\x{0009}-\\x{000D}]+}) AS tok FROM pdocs) GROUP BY tok",
    "atoms_tokens_forensic": "SELECT tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[\\p{L}\\p{N}_\\-" + chars.INVISIBLE + "]+}) AS tok FROM pdocs) GROUP BY tok",
    "atoms_lines": "SELECT line, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@lines) AS line FROM pdocs) GROUP BY line",
    "atoms_line_numbers": "SELECT doc_id, CAST(i + 1 AS BIGINT) AS number, CAST(length(c) AS BIGINT) AS chars FROM @pos{@lines}",
    "atoms_utf16_units": _doc("CAST(length(text) + @count{[\\x{10000}-\\x{10FFFF}]} AS BIGINT) AS units, @count{[\\x{10000}-\\x{10FFFF}]} AS surrogate_overhead"),
    "atoms_encoding_stack": _doc("CAST(length(text) AS BIGINT) AS scalars, CAST(length(text) + @count{[\\x{10000}-\\x{10FFFF}]} AS BIGINT) AS utf16, @bytes AS utf8"),
    "atoms_find_first": _doc("CAST(instr(text, ' ') - 1 AS BIGINT) AS first_space, CAST(instr(text, 'а') - 1 AS BIGINT) AS first_cyrillic_a"),
    "atoms_word_sentence_counts": _doc("CASE WHEN text IS NULL THEN -1 ELSE @count{[\\p{L}\\p{N}_]+} END AS words, CASE WHEN text IS NULL THEN -1 ELSE @count{[.!?]+(?:[\\s\\x{00A0}]|\\z)} END AS sentences"),
    # profile
    "profile_core_counts": _doc("CAST(length(text) AS BIGINT) AS codepoints, @graphemes AS graphemes, @count{[\\s\\x{00A0}\\x{0085}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]} AS whitespace, @count{\\p{M}} AS marks, @count{[" + chars.PICTOGRAPHS + "]} AS emoji"),
    "profile_utf8": _doc("@bytes AS bytes, CASE WHEN length(text) > 0 THEN @bytes / CAST(length(text) AS DOUBLE) ELSE 0.0 END AS byte_density, " + _share("[\\x{0000}-\\x{007F}]") + " AS ascii_share"),
    "profile_mark_density": "SELECT doc_id, marks, mark_share, CASE WHEN graphemes > 0 THEN marks / CAST(graphemes AS DOUBLE) ELSE 0.0 END AS density, CASE WHEN marks = 0 THEN 'LOW' WHEN marks * 10 < graphemes THEN 'MED' ELSE 'HIGH' END AS verdict FROM (SELECT doc_id, @count{\\p{M}} AS marks, @graphemes AS graphemes, " + _share("\\p{M}") + " AS mark_share FROM pdocs)",
    "profile_major_category": _rest(", ".join(f"{_ADDED.get(c, '')}@count{{\\p{{{c}}}}} AS gc_{c.lower()}" for c in "LMNPSZ") + ", @count{[\\p{Cc}\\p{Cf}\\p{Co}]} AS gc_c"),
    "profile_minor_category": _rest(", ".join(f"{_ADDED.get(c, '')}@count{{\\p{{{c}}}}} AS gc_{c.lower()}" for c in ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Co"))),
    "profile_repertoire": "SELECT doc_id, ascii, latin1, bmp, supplementary, total, CASE WHEN total > 0 THEN 100.0D * ascii / total ELSE 0.0D END AS ascii_pct, CASE WHEN total > 0 THEN 100.0D * latin1 / total ELSE 0.0D END AS latin1_pct, CASE WHEN total > 0 THEN 100.0D * bmp / total ELSE 0.0D END AS bmp_pct, CASE WHEN total = 0 THEN 'Empty' WHEN ascii = total THEN 'Fully ASCII' WHEN latin1 = total THEN 'Fully Latin-1' WHEN bmp = total THEN 'Fully BMP' ELSE 'Supplementary' END AS fully FROM (SELECT doc_id, @count{[\\x{0000}-\\x{007F}]} AS ascii, @count{[\\x{0000}-\\x{00FF}]} AS latin1, @count{[\\x{0000}-\\x{FFFF}]} AS bmp, @count{[\\x{10000}-\\x{10FFFF}]} AS supplementary, CAST(length(text) AS BIGINT) AS total FROM pdocs)",
    "profile_volumetrics": _doc("@count{[\\p{L}\\p{N}]} / 5.0D AS units, @count{[\\p{L}\\p{N}]} / 100.0D AS blocks, @count{[.!?]+(?:[\\s\\x{00A0}]|\\z)} AS sentences"),
    "profile_tiers": _doc("CASE WHEN @has{[\\x{2E00}-\\x{2E7F}\\x{3000}-\\x{303F}]} THEN 'EXOTIC' WHEN @has{[\\x{2010}-\\x{203A}\\x{00AB}\\x{00BB}]} THEN 'TYPOGRAPHIC' ELSE 'ASCII' END AS delimiter_tier, CASE WHEN @has{[\\x{2190}-\\x{2BFF}]} THEN 'EXOTIC' WHEN @has{[\\x{00A1}-\\x{00BF}]} THEN 'EXTENDED' ELSE 'KEYBOARD' END AS symbol_tier"),
    "profile_frequency_fingerprint": _doc(", ".join(f"{_share(p)} AS {n}" for n, p in (("letters", "\\p{L}"), ("numbers", "\\p{N}"), ("symbols", "[\\p{P}\\p{S}]"), ("whitespace", "[\\s\\x{00A0}]")))),
    "profile_phonotactics": _doc("@count{[aeiouAEIOU]} AS vowels, @count{[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]} AS consonants, CASE WHEN @count{[A-Za-z]} > 0 THEN @count{[aeiouAEIOU]} / CAST(@count{[A-Za-z]} AS DOUBLE) ELSE 0.0 END AS ratio"),
    # shape
    "shape_runs_major": _doc("@count{\\p{L}+} AS letter_runs, @count{\\p{N}+} AS number_runs, @count{\\p{P}+} AS punctuation_runs, @count{\\p{S}+} AS symbol_runs, @count{\\p{Z}+} AS separator_runs, @count{\\p{M}+} AS mark_runs"),
    "shape_runs_minor": _doc("@count{\\p{Lu}+} AS lu_runs, @count{\\p{Ll}+} AS ll_runs, @count{\\p{Nd}+} AS nd_runs, @count{\\p{Po}+} AS po_runs, @count{\\p{Zs}+} AS zs_runs, @count{\\p{Cf}+} AS cf_runs"),
    "shape_script_runs": _doc("@count{\\p{Latin}+} AS latin, @count{\\p{Cyrillic}+} AS cyrillic, @count{\\p{Greek}+} AS greek, @count{\\p{Arabic}+} AS arabic, @count{\\p{Han}+} AS han"),
    "shape_line_endings": _doc("@count{\\x{000D}\\x{000A}} AS crlf, @count{\\x{000A}} AS lf, @count{\\x{000D}} AS cr, (@has{ } AND @has{\\x{00A0}}) AS mixed_spaces"),
    "shape_whitespace_runs": "SELECT doc_id, CAST(count(r) AS BIGINT) AS runs, CAST(coalesce(max(length(r)), 0) AS BIGINT) AS longest, avg(length(r)) AS mean, stddev_pop(length(r)) / avg(length(r)) AS cv FROM (SELECT doc_id, @outer{@all{[\\s\\x{00A0}]+}} AS r FROM pdocs) GROUP BY doc_id",
    "shape_smuggler": _doc("@count{\\p{L}[" + chars.SMUGGLED + "]\\p{L}|[\\p{Latin}\\p{Cyrillic}\\p{Greek}][" + chars.JOIN + "][\\p{Latin}\\p{Cyrillic}\\p{Greek}]} AS hits"),
    "shape_geometric_drift": _doc("@count{[A-Za-z][\\x{FF21}-\\x{FF5A}]|[\\x{FF21}-\\x{FF5A}][A-Za-z]} AS hits"),
    "shape_rhythm": _doc("@count{\\p{L}[\\p{N}\\p{S}]|[\\p{N}\\p{S}]\\p{L}} AS transitions"),
    # integrity
    "integrity_decode_health": _doc("@count{\\x{FFFD}} AS replacement, @count{\\x{0000}} AS nul, @count{.\\x{FEFF}} AS internal_bom, @count{[\\x{E000}-\\x{F8FF}]} AS pua, @count{[\\x{0001}-\\x{0008}\\x{000B}\\x{000C}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}]} AS controls, @count{[\\x{FDD0}-\\x{FDEF}]} AS nonchar, CASE WHEN @has{[\\x{FFFD}\\x{0000}\\x{FDD0}-\\x{FDEF}]} THEN 'Critical' WHEN @has{[\\x{E000}-\\x{F8FF}\\x{0001}-\\x{0008}\\x{000B}\\x{000C}\\x{000E}-\\x{001F}\\x{007F}-\\x{009F}]} THEN 'Warning' ELSE 'OK' END AS grade"),
    "integrity_mojibake": _doc("@count{\\x{00C3}[\\x{0080}-\\x{00BF}]} AS utf8_cp1252, @count{\\x{00E2}\\x{20AC}} AS quotes, @count{[\\x{00D0}\\x{00D1}][\\x{0080}-\\x{00BF}]} AS cyrillic, @count{\\x{00C3}\\x{0192}} AS double_encoded"),
    "integrity_blank": _doc("(length(text) > 0 AND NOT @has{[^\\s\\x{00A0}" + chars.INVISIBLE + "]}) AS blank"),
    "integrity_artifacts": _doc("@count{[A-Za-z]\\x{200B}} AS zwsp_in_latin"),
    "integrity_kryptonite": _doc("@count{\\x{2028}} AS ls, @count{\\x{2029}} AS ps, CASE WHEN @has{\\x{2029}} THEN 4 WHEN @has{\\x{2028}} THEN 3 ELSE 0 END AS severity"),
    "integrity_invisible_clusters": "SELECT doc_id, CAST(count(r) AS BIGINT) AS clusters, CAST(coalesce(max(length(r)), 0) AS BIGINT) AS longest, CAST(sum(CASE WHEN length(r) >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS huge FROM (SELECT doc_id, @outer{@all{[" + chars.INVISIBLE + "]+}} AS r FROM pdocs) GROUP BY doc_id",
    "integrity_nsm_tiers": _doc("@count{\\p{M}{3,5}} AS moderate, @count{\\p{M}{6,15}} AS heavy, @count{\\p{M}{16,}} AS extreme, @has{\\p{M}{3,}} AS flagged"),
    "integrity_bidi_balance": _doc("@count{[\\x{202A}\\x{202B}\\x{202D}\\x{202E}]} AS embeddings, @count{\\x{202C}} AS pops, @count{[\\x{2066}-\\x{2068}]} AS isolates, @count{\\x{2069}} AS isolate_pops, @count{[\\x{202A}\\x{202B}\\x{202D}\\x{202E}]} - @count{\\x{202C}} AS unclosed, @count{[(\\[]} - @count{[)\\]]} AS open_brackets"),
    "integrity_ghosts": _doc("@count{\\x{0008}} AS backspaces, @count{\\x{007F}} AS deletes, @count{\\x{000D}(?:[^\\x{000A}]|\\z)} AS lone_cr"),
    "integrity_terminal": _doc("@count{\\x{001B}\\[[0-9;]*m} AS benign, @count{\\x{001B}\\[(?:2J|K|\\?25l|[0-9;]*H)} AS malicious"),
    # provenance
    "provenance_scripts": _doc("@count{\\p{Latin}} AS latin, @count{\\p{Cyrillic}} AS cyrillic, @count{\\p{Greek}} AS greek, @count{\\p{Han}} AS han, @count{\\p{Arabic}} AS arabic, @count{\\p{Hebrew}} AS hebrew"),
    "provenance_mix_severity": _doc("CASE WHEN @has{\\p{Latin}} AND @has{\\p{Cyrillic}|\\p{Greek}} THEN 'CRITICAL Mixed' WHEN @has{[^\\x{0000}-\\x{007F}]} THEN 'Single-Script' ELSE 'ASCII-Only' END AS severity"),
    "provenance_blocks": _doc(", ".join(f"@count{{[\\x{{{a}}}-\\x{{{b}}}]}} AS {n}" for n, a, b in (("basic_latin", "0000", "007F"), ("latin1_supplement", "0080", "00FF"), ("cyrillic", "0400", "04FF"), ("general_punctuation", "2000", "206F"), ("combining", "0300", "036F"), ("tags", "E0000", "E007F")))),
    "provenance_digit_mass": "SELECT doc_id, CAST(coalesce(sum(CAST(d AS BIGINT)), 0) AS BIGINT) AS mass FROM (SELECT doc_id, @outer{@all{[0-9]}} AS d FROM pdocs) GROUP BY doc_id",
    "provenance_number_systems": _doc("(CASE WHEN @has{[0-9]} THEN 1 ELSE 0 END + CASE WHEN @has{[\\x{0660}-\\x{0669}]} THEN 1 ELSE 0 END + CASE WHEN @has{[\\x{0966}-\\x{096F}]} THEN 1 ELSE 0 END + CASE WHEN @has{[\\x{FF10}-\\x{FF19}]} THEN 1 ELSE 0 END) AS systems"),
    # emoji
    "emoji_counts": _doc("@count{[" + chars.PICTOGRAPHS + "]} AS pictographs, @count{[" + chars.REGIONAL + "][" + chars.REGIONAL + "]} AS flags, @count{[" + chars.SKIN + "]} AS skin_tones, @count{\\x{200D}} AS joiners, @count{\\x{FE0F}} AS presentation"),
    "emoji_valency": _doc("@count{\\x{200D}(?:[^" + chars.PICTOGRAPHS + "]|\\z)} AS dangling, (@count{[" + chars.REGIONAL + "]} % 2) AS odd_regional"),
    "emoji_ghost_tags": _doc("@count{[\\x{E0020}-\\x{E007E}]+(?:[^\\x{E0020}-\\x{E007F}]|\\z)} AS unterminated, @count{[^\\x{1F3F4}\\x{E0020}-\\x{E007F}][\\x{E0020}-\\x{E007F}]} AS wrong_base"),
    # adversarial tokens
    "token_fracture": _doc(f"@count{{{FRACTURE}}} AS hits, CASE WHEN @has{{{FRACTURE}}} THEN 99 ELSE 0 END AS risk, CASE WHEN @has{{{FRACTURE}}} THEN 'CRITICAL' ELSE 'NONE' END AS level"),
    "token_mixed_script": "SELECT doc_id, CAST(sum(CASE WHEN regexp_like(tok, @rx{[a-zA-Z]}) AND regexp_like(tok, @rx{[\\x{0400}-\\x{04FF}]}) THEN 1 ELSE 0 END) AS BIGINT) AS tokens FROM (SELECT doc_id, @outer{@all{[\\p{L}]+}} AS tok FROM pdocs) GROUP BY doc_id",
    "token_sore_thumb": "SELECT tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[A-Za-z0-9]+}) AS tok FROM pdocs) WHERE regexp_like(tok, @rx{^[A-Za-z]+[0-9][A-Za-z]*$}) GROUP BY tok",
    "token_lexical_stutter": "SELECT tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[A-Za-z]+}) AS tok FROM pdocs) WHERE length(tok) % 2 = 0 AND substr(tok, 1, CAST(length(tok) / 2 AS INT)) = substr(tok, CAST(length(tok) / 2 AS INT) + 1) GROUP BY tok",
    "token_skeleton_collisions": "SELECT skeleton, CAST(count(DISTINCT tok) AS BIGINT) AS forms, CAST(count(*) AS BIGINT) AS n FROM (SELECT tok, lower(translate(tok, 'аеорсх', 'aeopcx')) AS skeleton FROM (SELECT explode(@all{[\\p{L}]+}) AS tok FROM pdocs)) GROUP BY skeleton HAVING count(DISTINCT tok) > 1",
    "token_pseudo_delimiters": _doc("@count{[\\x{2024}\\x{FE52}\\x{FF0E}\\x{3002}]} AS dots, @count{[\\x{2044}\\x{2215}\\x{29F8}\\x{FF0F}]} AS slashes"),
    "token_extensions": _doc("@count{(?i)\\.(?:pdf|doc|jpg|txt)\\.(?:exe|bat|scr|js)} AS double_extension, @count{\\x{202E}[^ ]*\\.[A-Za-z]+} AS rtlo, @count{[\\x{2800}\\x{3164}\\x{00A0}]\\.[A-Za-z]{2,4}} AS masked"),
    "token_alphabets": _doc(", ".join(f"@count{{[{p}]}} AS {n}" for n, p in ALPHABETS.items())),
    "token_punctuation_skew": _doc("@count{[~^_]} AS charged, @count{[.,]} AS grammatical, CASE WHEN @count{[~^_.,]} > 0 AND @count{[~^_]} > 0.7D * @count{[~^_.,]} THEN TRUE ELSE FALSE END AS skewed"),
    "token_symbol_flood": _doc("(" + " + ".join(f"@count{{{p}{{9,}}}}" for p in ASCII_SYMBOLS) + ") AS floods"),
    "token_lures": _doc(f"@count{{{LURES}}} AS lures, @has{{!\\[[^\\]]*\\]\\(http}} AS image_exfil"),
    "token_injections": _doc(f"@count{{{INJECTIONS}}} AS injections"),
    "token_waf": _doc(f"@count{{{WAF}}} AS hits"),
    "token_comment_linebreak": _doc("@count{(?://|#)[^\\x{000A}]*[\\x{2028}\\x{2029}]} AS hits"),
    "token_code_masquerade": _doc("(@has{[{};=]} AND @has{[\\x{0400}-\\x{04FF}]}) AS masquerade"),
    "token_homoglyphs": _doc("@count{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}\\x{0391}-\\x{03A9}]} AS confusables, CASE WHEN length(text) > 0 THEN @count{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}\\x{0391}-\\x{03A9}]} / CAST(length(text) AS DOUBLE) ELSE 0.0 END AS density"),
    "token_payloads": "SELECT doc_id, CAST(count(r) AS BIGINT) AS runs, CAST(coalesce(max(length(r)), 0) AS BIGINT) AS longest FROM (SELECT doc_id, @outer{@all{[A-Za-z0-9+/=]{17,}}} AS r FROM pdocs) GROUP BY doc_id",
    # statistics
    "stats_line_lengths": "SELECT doc_id, CAST(count(l) AS BIGINT) AS lines, CAST(min(length(l)) AS BIGINT) AS shortest, avg(length(l)) AS mean, CAST(max(length(l)) AS BIGINT) AS longest, CAST(sum(CASE WHEN l = '' THEN 1 ELSE 0 END) AS BIGINT) AS empty FROM (SELECT doc_id, @outer{@lines} AS l FROM pdocs) GROUP BY doc_id",
    "stats_ttr": "SELECT doc_id, CAST(count(tok) AS BIGINT) AS tokens, CAST(count(DISTINCT lower(tok)) AS BIGINT) AS types, CASE WHEN count(tok) > 0 THEN count(DISTINCT lower(tok)) / CAST(count(tok) AS DOUBLE) ELSE 0.0 END AS ttr FROM (SELECT doc_id, @outer{@all{[a-zA-Z]+}} AS tok FROM pdocs) GROUP BY doc_id",
    "stats_index_of_coincidence": "SELECT doc_id, CASE WHEN sum(n) > 1 THEN 26.0D * sum(n * (n - 1)) / (CAST(sum(n) AS DOUBLE) * (sum(n) - 1)) ELSE 0.0 END AS ic FROM (SELECT doc_id, lower(c) AS l, count(*) AS n FROM (SELECT doc_id, explode(@all{[A-Za-z]}) AS c FROM pdocs) GROUP BY doc_id, lower(c)) GROUP BY doc_id",
    "stats_benford": "SELECT d, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(x, 1, 1) AS d FROM (SELECT explode(@all{[1-9][0-9]*}) AS x FROM pdocs)) GROUP BY d",
    "stats_zipf": "SELECT rank, n FROM (SELECT row_number() OVER (ORDER BY count(*) DESC, tok) AS rank, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[a-zA-Z]+}) AS tok FROM pdocs) GROUP BY tok) WHERE rank <= 1000",
    "stats_top_tokens": "SELECT lang, tok, n FROM (SELECT lang, tok, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS k FROM (SELECT lang, lower(tok) AS tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, explode(@all{[a-zA-Z]+}) AS tok FROM pdocs) GROUP BY lang, lower(tok))) WHERE k <= 20",
    "stats_ws_channel": "SELECT doc_id, sp, tab, nbsp, zwsp, ends AS trailing, CASE WHEN length > 0 THEN breaks / CAST(length AS DOUBLE) ELSE 0.0 END AS eol_density, CASE WHEN sp + tab + nbsp + zwsp > 0 THEN 0.0 - (" + " + ".join(f"CASE WHEN {c} > 0 THEN {c} / CAST(sp + tab + nbsp + zwsp AS DOUBLE) * log2({c} / CAST(sp + tab + nbsp + zwsp AS DOUBLE)) ELSE 0.0 END" for c in ("sp", "tab", "nbsp", "zwsp")) + ") ELSE 0.0 END AS entropy FROM (SELECT doc_id, length(text) AS length, @count{ } AS sp, @count{\\x{0009}} AS tab, @count{\\x{00A0}} AS nbsp, @count{\\x{200B}} AS zwsp, @count{[ \\x{0009}]\\x{000A}} AS ends, @count{\\x{000A}} AS breaks FROM pdocs)",
    "stats_stylometry": _doc("CASE WHEN @count{[\\p{L}\\p{N}]+} > 0 THEN @count{[\\p{L}\\p{N}]} / CAST(@count{[\\p{L}\\p{N}]+} AS DOUBLE) ELSE 0.0 END AS word_length, " + _share("\\p{P}") + " AS punctuation"),
    # lenses
    "lens_filesystem": _doc("@count{[\\x{0000}/\\\\]} AS critical, @count{[<>:|?*]} AS reserved, @has{(?i)(?:^|[^\\p{L}\\p{N}_])(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:[^\\p{L}\\p{N}_]|\\z)} AS reserved_name, @has{[. ]\\z} AS trailing"),
    "lens_source_code": _doc("@count{[" + chars.BIDI + "]} AS trojan, @count{[" + chars.INVISIBLE + "]} AS hidden, @count{[" + chars.SPACES + "]} AS odd_spaces"),
    "lens_restriction_level": _doc("CASE WHEN NOT @has{[^\\x{0000}-\\x{007F}]} THEN 'ASCII' WHEN NOT @has{\\p{Cyrillic}|\\p{Greek}} THEN 'Single' WHEN @has{\\p{Latin}} THEN 'Moderate' ELSE 'Single' END AS level"),
    "lens_domains": "SELECT host, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN host LIKE '%xn--%' THEN 1 ELSE 0 END) AS punycode FROM (SELECT regexp_extract(url, @rx{^[a-z]+://([^/?#]+)}, 1) AS host FROM pages) GROUP BY host",
    # remediation
    "remedy_middle_dot": _doc("replace(text, ' ', '·') AS revealed"),
    "remedy_skeleton": _doc("translate(@del{[" + chars.INVISIBLE + "]}, 'аеорсх ', 'aeopcx ') AS skeleton"),
    "remedy_drift": _doc("CAST(@count{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]} AS BIGINT) AS visual, @count{[" + chars.INVISIBLE + "]} AS structure, @count{[" + chars.SPACES + "]} AS format, CASE WHEN @has{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]} THEN 'CRITICAL' WHEN @has{[" + chars.INVISIBLE + "]} THEN 'HIGH' WHEN @has{[" + chars.SPACES + "]} THEN 'WARN' ELSE 'NONE' END AS drift"),
    "remedy_hash": _doc("@sha AS digest"),
    # scores
    "score_threat_v1": "SELECT doc_id, score, CASE WHEN score >= 10 THEN 'HIGH' WHEN score >= 5 THEN 'MED' ELSE 'LOW' END AS level FROM (SELECT doc_id, CAST(CASE WHEN @has{[\\x{FFFD}\\x{0000}]} THEN 4 ELSE 0 END + CASE WHEN @has{[" + chars.BIDI + "]} THEN 3 ELSE 0 END + CASE WHEN @has{[" + chars.INVISIBLE + "]{4,}} THEN 3 ELSE 0 END + CASE WHEN @has{[" + chars.TAGS + "]} THEN 3 ELSE 0 END + CASE WHEN @has{.\\x{FEFF}} THEN 2 ELSE 0 END + CASE WHEN @has{\\p{M}{3,}} THEN 2 ELSE 0 END AS BIGINT) AS score FROM pdocs)",
    "score_risk_matrix": "SELECT doc_id, risk, CASE WHEN bidi THEN greatest(CAST(4 AS BIGINT), level) ELSE level END AS level FROM (SELECT doc_id, risk, bidi, CAST(CASE WHEN risk >= 8 THEN 5 WHEN risk >= 4 THEN 4 WHEN risk >= 3 THEN 3 WHEN risk > 0 THEN 2 ELSE 1 END AS BIGINT) AS level FROM (SELECT doc_id, @has{[" + chars.BIDI + "]} AS bidi, CASE WHEN @has{[" + chars.BIDI + "]} THEN 4.0D ELSE 0.0D END + CASE WHEN @has{\\p{M}{3,}} THEN 3.0D ELSE 0.0D END + CASE WHEN @has{\\p{Latin}} AND @has{\\p{Cyrillic}} THEN 3.0D ELSE 0.0D END + CASE WHEN @has{[" + chars.INVISIBLE + "]} THEN 2.0D ELSE 0.0D END + CASE WHEN @has{[" + chars.SPACES + "]} THEN 1.5D ELSE 0.0D END AS risk FROM pdocs))",
    "score_quad_ledger": _doc("@count{[\\x{FFFD}\\x{0000}]} AS integrity, @count{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]} AS authenticity, @count{[" + chars.BIDI + chars.TAGS + "]} AS threat, @count{[" + chars.SPACES + "]} + @count{\\p{M}{3,}} AS anomaly"),
    # html
    "html_input_guard": "SELECT page_id, CAST(length(substr(coalesce(nullif(html, '<br>'), ''), 1, 100000)) AS BIGINT) AS used, (length(html) > 100000) AS truncated FROM pages",
    "html_css_signatures": "SELECT page_id, kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT page_id, CASE WHEN h LIKE '%display:none%' THEN 'layout' WHEN h LIKE '%opacity:0%' THEN 'photometric' WHEN h LIKE '%font-size:0%' THEN 'geometric' ELSE 'other' END AS kind FROM (SELECT page_id, replace(lower(concat(html, CASE page_id % 4 WHEN 0 THEN '<p style=\"display:none\">x</p>' WHEN 1 THEN '<i style=\"opacity:0\">y</i>' WHEN 2 THEN '<b style=\"font-size:0\">z</b>' ELSE '' END)), ' ', '') AS h FROM pages)) GROUP BY page_id, kind",
    # conversations, events
    "stream_turns": "SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
}
for _name, (_, _p) in chars.FLAGS.items():
    CATALOG[f"flag_{_name}"] = f"SELECT doc_id, '{_name}' AS flag, @count{{{_p}}} AS n FROM pdocs WHERE @has{{{_p}}}"
for _name, _p in chars.SEQUENCES.items():
    CATALOG[f"flag_{_name}"] = f"SELECT doc_id, '{_name}' AS flag, @count{{{_p}}} AS n FROM pdocs WHERE @has{{{_p}}}"
#: Tables other than the documents that an operator reads.
TABLES = {"lens_domains": ("pages",), "html_input_guard": ("pages",), "html_css_signatures": ("pages",), "stream_turns": ("conversations",)}
