"""Oracles for operators on the properties of characters, which the oracle's engine has no functions for.

The properties of the characters that the tables hold (Latin with its accents, marks, Cyrillic, punctuation, tags) are
written into the SQL as a table from the runtime's data, one row for each character; segmentation, counting, runs, joins and
digests are the engine's own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable

from glyphlake.functions import chars, normal, props, reveal
from glyphlake.operators import atoms, macro, profiles

_POINTS = [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x180), *range(0x300, 0x310), *range(0x400, 0x460), *range(0x2000, 0x2070), 0x20AC, *range(0xE0020, 0xE0080)]
CHARS = [chr(p) for p in _POINTS]


def quoted(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + str(x).replace("'", "''") + "'"


def table(of: Callable[[str], Iterable[tuple]]) -> str:
    """Rows (cp, ...) of the characters."""
    return "(VALUES " + ", ".join(f"({ord(c)}, {', '.join(map(quoted, row))})" for c in CHARS for row in of(c)) + ")"


def mapped(expression: str, of: Callable[[str], str]) -> str:
    """expression with each character that a mapping changes replaced."""
    for c in CHARS:
        if of(c) != c:
            expression = f"replace({expression}, {quoted(c)}, {quoted(of(c))})"
    return expression


_COUNTS = "c AS (SELECT doc_id, ord(ch) AS cp, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM pdocs WHERE text <> '') GROUP BY ALL)"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _labelled(of: Callable[[str], Iterable[str]], column: str) -> str:
    return f"f(cp, {column}) AS {table(lambda c: [(v,) for v in of(c)])}"


def runs(names: Iterable[str], only: str = "") -> str:
    """Runs of equal values: the text as letters of values, and their runs as matches."""
    parts = []
    for name in names:
        of = props.PROPERTIES[name]
        letter = dict(zip(sorted({of(c) for c in CHARS}), _LETTERS, strict=False))
        known = ", ".join(f"({quoted(x)}, {quoted(v)})" for v, x in letter.items())
        letters = f"translate(text, {quoted(''.join(CHARS))}, {quoted(''.join(letter[of(c)] for c in CHARS))})"
        parts.append(
            f"SELECT doc_id, '{name}' AS property, value, CAST(count(*) AS BIGINT) AS runs, CAST(max(len(r)) AS BIGINT) AS longest, CAST(sum(len(r)) AS BIGINT) AS chars "
            f"FROM (SELECT doc_id, unnest(regexp_extract_all({letters}, '{'|'.join(x + '+' for x in letter.values())}')) AS r FROM pdocs) "
            f"JOIN (VALUES {known}) AS k(x, value) ON x = r[1] GROUP BY ALL"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) {only}"


def _describe(c: str) -> list[tuple]:
    return [(unicodedata.name(c, None), unicodedata.category(c), unicodedata.bidirectional(c), unicodedata.combining(c), unicodedata.east_asian_width(c), props.script_of(c), bool(unicodedata.mirrored(c)), unicodedata.decomposition(c) or None, unicodedata.numeric(c, None), unicodedata.normalize("NFKC", c))]


NFKC = f"nfc_normalize({mapped('text', lambda c: unicodedata.normalize('NFKC', c))})"
NFD = mapped("nfc_normalize(text)", lambda c: unicodedata.normalize("NFD", c))


def _folded(expression: str) -> str:
    return f"lower({mapped(expression, lambda c: c.casefold() if c.casefold() != c.lower() else c)})"


def _skeleton(expression: str) -> str:
    plain = _folded(f"nfc_normalize({mapped(expression, lambda c: unicodedata.normalize('NFKC', c))})")
    return f"translate(regexp_replace({plain}, '\\p{{Cf}}', '', 'g'), '{''.join(normal.CONFUSABLES)}', '{''.join(normal.CONFUSABLES.values())}')"


_TOKEN = "tok AS (SELECT unnest(regexp_extract_all(text, '{p}')) AS token FROM pdocs)"
_GRAPHEMES = f"g AS (SELECT doc_id, text, regexp_extract_all(text, '{macro._GRAPHEME}') AS l FROM pdocs)"
_ASTRAL = "len(regexp_extract_all(g, '[\\x{10000}-\\x{10FFFF}]'))"
_ODD = "".join(c for c in CHARS if unicodedata.normalize("NFKC", c) != c)
_ENCODED = table(lambda c: [(e,) for e in atoms.ENCODINGS if atoms._encodes(c, e)])
_ADDED = "CASE page_id % 4 WHEN 0 THEN 'layout' WHEN 1 THEN 'photometric' WHEN 2 THEN 'geometric' END"
_HIDDEN = f"""h AS (SELECT page_id, {_ADDED} AS vector, CASE WHEN html LIKE '%</html>%' THEN '' ELSE 'html > body > ' END || CASE page_id % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'i' ELSE 'b' END AS lineage,
 CASE page_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS text FROM pages WHERE page_id % 4 < 3)"""


def _reduced(expression: str, times: int = 12) -> str:
    """Brackets that are left when matched pairs are taken out, from the inside."""
    out = f"regexp_replace({expression}, '[^()\\[\\]{{}}]', '', 'g')"
    for _ in range(times):
        out = f"regexp_replace({out}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"
    return out


def _opened(opening: str, closing: str) -> str:
    return f"len(regexp_extract_all(text, '[{opening}]')), len(regexp_extract_all(text, '[{closing}]'))"


ORACLES = {
    "flag_properties": f"WITH {_COUNTS}, {_labelled(props.flags_of, 'flag')} SELECT doc_id, flag, CAST(sum(n) AS BIGINT) AS n FROM c JOIN f USING (cp) GROUP BY ALL",
    "states_character_effects": f"WITH {_COUNTS}, {_labelled(props.effects_of, 'effect')} SELECT effect, chr(cp) AS ch, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM c JOIN f USING (cp) GROUP BY ALL",
    "atlas_characters": f"""WITH {_COUNTS}, f(cp, name, category, bidi, ccc, width, script, mirrored, decomposition, num, nfkc) AS {table(_describe)}
 SELECT CAST(cp AS BIGINT) AS cp, chr(cp) AS ch, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs, name, category, bidi, CAST(ccc AS INT) AS ccc, width, script, mirrored, decomposition, CAST(num AS DOUBLE) AS "numeric", nfkc,
 lower(hex(chr(cp))) AS utf8, '\\u{{' || upper(to_hex(cp)) || '}}' AS escape FROM c JOIN f USING (cp) GROUP BY cp, name, category, bidi, ccc, width, script, mirrored, decomposition, num, nfkc""",
    "shape_property_runs": runs(("linebreak", "bidi", "wordbreak", "sentencebreak", "graphemebreak", "eaw", "script")),
    "shape_combining_classes": runs(("ccc",), "WHERE value <> '0'"),
    "integrity_mark_structure": f"""WITH {_GRAPHEMES}, r AS (SELECT doc_id, l, regexp_extract_all(text, '\\p{{M}}{{2,}}') AS m FROM g)
 SELECT doc_id, CAST(len(list_filter(m, lambda x: len(x) > 30)) AS BIGINT) AS stream_unsafe, CAST(coalesce(list_sum(list_transform(m, lambda x: len(x) - 1)), 0) AS BIGINT) AS equal_class,
 CAST(coalesce(list_sum(list_transform(m, lambda x: len(x) - 1)), 0) AS BIGINT) AS repeated, CAST(len(list_filter(l, lambda x: nfc_normalize(x) <> x)) AS BIGINT) AS unstable_graphemes FROM r""",
    "provenance_numeric_mass": f"""WITH {_COUNTS}, f(cp, v, zero) AS {table(lambda c: [] if unicodedata.numeric(c, None) is None else [(unicodedata.numeric(c), ord(c) - unicodedata.decimal(c) if unicodedata.decimal(c, None) is not None else None)])},
 s AS (SELECT doc_id, sum(n * v) AS total, sum(CASE WHEN cp < 128 THEN n * v ELSE 0 END) AS "ascii", count(DISTINCT zero) AS systems FROM c JOIN f USING (cp) GROUP BY doc_id)
 SELECT doc_id, CAST(coalesce(total, 0) AS DOUBLE) AS total, CAST(coalesce("ascii", 0) AS BIGINT) AS "ascii", coalesce(systems, 0) AS systems, CAST(coalesce(total, 0) - coalesce("ascii", 0) AS DOUBLE) AS divergence FROM pdocs LEFT JOIN s USING (doc_id)""",
    "lens_identifier_policy": f"""WITH {_TOKEN.format(p='[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 'p{M}_]+')} SELECT token, count(*) AS n, CASE WHEN NOT regexp_full_match(token, '[\\p{{L}}\\p{{Nl}}_][\\p{{L}}\\p{{Nl}}\\p{{Mn}}\\p{{Mc}}\\p{{Nd}}_]*') THEN 'restricted'
 WHEN len(translate(token, {quoted(_ODD)}, '')) < len(token) OR nfc_normalize(token) <> token THEN 'restricted' WHEN regexp_matches(token, '\\p{{Latin}}') AND regexp_matches(token, '\\p{{Cyrillic}}') THEN 'restricted' ELSE 'allowed' END AS policy FROM tok GROUP BY token""",
    "atoms_graphemes": f"""WITH {_GRAPHEMES}, x AS (SELECT doc_id, unnest(l) AS g, generate_subscripts(l, 1) - 1 AS i FROM g), y AS (SELECT doc_id, i, length(g) AS n, length(g) + {_ASTRAL} AS u FROM x),
 z AS (SELECT doc_id, i, n, u, coalesce(sum(n) OVER w, 0) AS cp, coalesce(sum(u) OVER w, 0) AS unit FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT doc_id, count(*) AS graphemes, CAST(sum(n) AS BIGINT) AS cp_end, CAST(sum(u) AS BIGINT) AS unit_end, sha256(string_agg(cp || ':' || unit, ',' ORDER BY i)) AS places FROM z GROUP BY doc_id""",
    "profile_graphemes": f"""WITH {_GRAPHEMES} SELECT doc_id, CAST(len(l) AS BIGINT) AS graphemes, CAST(len(list_filter(l, lambda x: length(x) = 1)) AS BIGINT) AS single, CAST(len(list_filter(l, lambda x: length(x) > 1)) AS BIGINT) AS multi,
 CAST(len(regexp_extract_all(text, '\\p{{M}}')) AS BIGINT) AS marks, CAST(coalesce(list_max(list_transform(l, lambda x: len(regexp_extract_all(x, '\\p{{M}}')))), 0) AS BIGINT) AS most_marks,
 CASE WHEN len(l) > 0 THEN len(regexp_extract_all(text, '\\p{{M}}')) / CAST(len(l) AS DOUBLE) ELSE 0 END AS average_marks FROM g""",
    "profile_encodings": f"""WITH {_COUNTS}, f(cp, encoding) AS {_ENCODED}, t AS (SELECT doc_id, sum(n) AS t, sum(CASE WHEN cp > 127 THEN n ELSE 0 END) AS u FROM c GROUP BY doc_id), e AS (SELECT DISTINCT encoding FROM f),
 s AS (SELECT doc_id, encoding, sum(n) AS a, sum(CASE WHEN cp > 127 THEN n ELSE 0 END) AS b FROM c JOIN f USING (cp) GROUP BY ALL)
 SELECT doc_id, encoding, coalesce(a, 0) / CAST(t AS DOUBLE) AS all_share, CASE WHEN u > 0 THEN coalesce(b, 0) / CAST(u AS DOUBLE) END AS signal_share FROM t CROSS JOIN e LEFT JOIN s USING (doc_id, encoding)""",
    "profile_encoding_evidence": f"""WITH {_COUNTS}, f(cp, encoding) AS {_ENCODED}, k AS (SELECT cp, count(*) AS k, min(encoding) AS one FROM f GROUP BY cp)
 SELECT doc_id, max(cp) < 128 AS pure_ascii, CAST(sum(CASE WHEN k = 1 THEN n ELSE 0 END) AS BIGINT) AS sole, CAST(sum(CASE WHEN k IS NULL THEN n ELSE 0 END) AS BIGINT) AS nowhere,
 coalesce(string_agg(DISTINCT CASE WHEN k = 1 THEN one END, ',' ORDER BY CASE WHEN k = 1 THEN one END), '') AS explained_by FROM c LEFT JOIN k USING (cp) GROUP BY doc_id""",
    "states_forms": f"""SELECT doc_id, sha256(nfc) AS nfc_sha256, sha256(nfd) AS nfd_sha256, sha256(nfkc) AS nfkc_sha256, CASE WHEN length(nfkc) < length(nfc) THEN 'STRIPPED' WHEN nfkc <> nfc THEN 'MUTATION' WHEN nfc <> text THEN 'EQUIVALENCE' ELSE 'STABLE' END AS kind
 FROM (SELECT doc_id, text, nfc_normalize(text) AS nfc, {NFD} AS nfd, {NFKC} AS nfkc FROM pdocs)""",
    "states_quad": f"SELECT doc_id, sha256(text) AS raw_sha256, sha256({NFKC}) AS nfkc_sha256, sha256({_folded(NFKC)}) AS casefold_sha256, sha256({_skeleton('text')}) AS skeleton_sha256 FROM pdocs",
    "states_inflation": f"SELECT doc_id, length({NFKC}) / CAST(greatest(length(text), 1) AS DOUBLE) AS inflation, nfc_normalize(text) <> text AS not_nfc FROM pdocs",
    "states_collisions": f"""WITH {_TOKEN.format(p=chr(92) + 'p{L}+')}, s AS (SELECT DISTINCT token, {_skeleton('token')} AS skeleton FROM tok)
 SELECT skeleton, string_agg(token, ',' ORDER BY token) AS forms FROM s GROUP BY skeleton HAVING count(*) > 1""",
    "sequential_bidi": f"""SELECT doc_id, CAST(greatest(a[1] - a[2], 0) AS BIGINT) AS unclosed_embeddings, CAST(greatest(b[1] - b[2], 0) AS BIGINT) AS unclosed_isolates, CAST(greatest(a[2] - a[1], 0) AS BIGINT) AS unmatched_pdf,
 CAST(greatest(b[2] - b[1], 0) AS BIGINT) AS unmatched_pdi, CAST(length({_reduced('text')}) AS BIGINT) AS unbalanced_brackets
 FROM (SELECT doc_id, text, [{_opened(chr(92) + 'x{202A}' + chr(92) + 'x{202B}' + chr(92) + 'x{202D}' + chr(92) + 'x{202E}', chr(92) + 'x{202C}')}] AS a, [{_opened(chr(92) + 'x{2066}-' + chr(92) + 'x{2068}', chr(92) + 'x{2069}')}] AS b FROM pdocs)""",
    "html_hidden_text": f"WITH {_HIDDEN} SELECT * FROM h",
    "html_ghost_text": f"WITH {_HIDDEN} SELECT page_id, '[' || vector || ': ' || lineage || '] ' || text AS ghosts, CAST(1 AS BIGINT) AS n FROM h",
    "html_fis": f"WITH {_HIDDEN} SELECT page_id, CAST(CASE vector WHEN 'layout' THEN 3 WHEN 'photometric' THEN 2 ELSE 1 END AS BIGINT) AS fis FROM h",
    "lens_punycode": "SELECT host, count(*) AS n, replace(host, 'xn--bcher-kva.', 'bücher.') AS decoded FROM (SELECT CASE WHEN page_id % 5 = 0 THEN 'xn--bcher-kva.' ELSE '' END || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host FROM pages WHERE regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1) <> '') GROUP BY host",
}

_PLACES = "p AS (SELECT doc_id, ord(ch) AS cp, ch, i FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM pdocs WHERE text <> ''))"
for _name, _of in (("provenance_script_places", lambda c: [(props.script_of(c),)]), ("provenance_script_extensions", lambda c: [(s,) for s in props.extensions_of(c)])):
    ORACLES[_name] = f"WITH {_PLACES}, f(cp, script) AS {table(_of)} SELECT doc_id, script, count(*) AS n, min(i) AS first FROM p JOIN f USING (cp) GROUP BY ALL"
ORACLES["atlas_components"] = f"""WITH {profiles._G}, p AS (SELECT g, n, unnest(string_split(g, '')) AS c, generate_subscripts(string_split(g, ''), 1) - 1 AS k FROM g WHERE length(g) > 1),
 f(cp, name, category, bidi, ccc, width, script, mirrored, decomposition, num, nfkc) AS {table(_describe)} SELECT g, n, CAST(k AS INT) AS k, 'U+' || printf('%04X', ord(c)) AS cp, category, CAST(ccc AS INT) AS ccc, name FROM p JOIN f ON ord(c) = f.cp"""
ORACLES["atoms_encoding_stacks"], ORACLES["token_payload_entropy"] = profiles.ENCODING_STACKS, profiles.PAYLOADS
STRICT = "[" + chars.INVISIBLE + chars.SPACES + "\\x{E000}-\\x{F8FF}]"
ORACLES["remedy_strict"] = f"SELECT doc_id, nfc_normalize(regexp_replace(text, '{STRICT}', '', 'g')) AS clean FROM pdocs"
_NAMED = macro.any_of(tuple(k for k, (severity, _) in chars.FLAGS.items() if severity != "info"))
ORACLES["macro_snapshot_threats"] = f"""WITH g AS (SELECT doc_id, regexp_extract_all(text, '{macro._GRAPHEME}') AS l FROM pdocs),
 x AS (SELECT doc_id, len(l) AS t, unnest(l) AS g, generate_subscripts(l, 1) - 1 AS i FROM g WHERE len(l) > 0),
 y AS (SELECT doc_id, ((i + 1) * least(10, t) - 1) // t AS seg, i, length(g) AS n, len(regexp_extract_all(g, '{_NAMED}')) AS f, len(regexp_extract_all(g, '{macro.any_of(macro.CRITICAL)}')) AS f2 FROM x),
 z AS (SELECT doc_id, seg, sum(n) AS n, sum(f) AS f, sum(f2) AS f2 FROM y GROUP BY ALL)
 SELECT doc_id, seg, CAST(sum(n) OVER w - n AS BIGINT) AS cp_start, CAST(sum(n) OVER w AS BIGINT) AS cp_end, CAST(f AS BIGINT) AS threats_all, CAST(f2 AS BIGINT) AS threats_critical FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY seg)"""
ORACLES["report_segments_json"] = f"""WITH {macro.SQL_METRICS} SELECT doc_id, CAST(to_json(list({{'segment_id': concat(seg + 1, ' / ', n_seg), 'start_grapheme_index': start, 'end_grapheme_index': "end",
 'metrics': {{'volume': volume, 'content_volume': content_volume, 'run_count': run_count, 'max_run': CAST(max_run AS BIGINT), 'space_runs': space_runs, 'line_breaks': line_breaks, 'bidi_atoms': bidi_atoms, 'join_atoms': join_atoms, 'other_invisibles': other_invisibles, 'threats_all': threats_all, 'threats_critical': threats_critical}}}} ORDER BY seg)) AS VARCHAR) AS report FROM m GROUP BY doc_id"""
ORACLES["remedy_reveal"] = f"WITH {_PLACES}, f(cp, mark) AS (VALUES {', '.join(f'({ord(c)}, {quoted(m)})' for c, m in reveal.marks().items())}) SELECT doc_id, coalesce(string_agg(coalesce(mark, ch), '' ORDER BY i), '') AS revealed FROM pdocs LEFT JOIN p USING (doc_id) LEFT JOIN f USING (cp) GROUP BY doc_id"

# Views that hold what the documents don't, and what is expected of them.

#: A delimited text for each customer: order, price, status; some lines have a cell more, some cells aren't of their column's type.
DELIMITED = """SELECT o_custkey AS doc_id, o_orderkey AS k, concat_ws(',', CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 37 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END,
 CASE WHEN o_orderkey % 11 = 0 THEN '=A1' ELSE o_orderstatus END, CASE WHEN o_orderkey % 13 = 0 THEN 'more' END) AS line FROM orders"""
_LINES = f"""d AS ({DELIMITED.replace('STRING', 'VARCHAR')}), x AS (SELECT doc_id, string_split(line, ',') AS cells, line FROM d), n AS (SELECT doc_id, len(cells) AS w, count(*) AS k FROM x GROUP BY ALL)"""
ORACLES |= {
    "sequential_topology": f"""WITH {_LINES}, m AS (SELECT doc_id, arg_max(w, (k, w)) AS columns, sum(k) - max(k) AS ragged FROM n GROUP BY doc_id),
 i AS (SELECT doc_id, sum(CASE WHEN c[1] IN ('=', '@', '+', '-') THEN 1 ELSE 0 END) AS injections FROM (SELECT doc_id, unnest(cells) AS c FROM x) GROUP BY doc_id)
 SELECT doc_id, ',' AS delimiter, CAST(columns AS BIGINT) AS columns, CAST(ragged AS BIGINT) AS ragged, CAST(injections AS BIGINT) AS injections FROM m JOIN i USING (doc_id)""",
    "sequential_type_drift": f"""WITH {_LINES}, c AS (SELECT doc_id, unnest(cells) AS c, generate_subscripts(cells, 1) - 1 AS col FROM x), k AS (SELECT doc_id, col, CASE WHEN TRY_CAST(c AS DOUBLE) IS NOT NULL THEN 'number' WHEN c = '' THEN 'empty' ELSE 'text' END AS type, count(*) AS k FROM c GROUP BY ALL),
 m AS (SELECT doc_id, col, arg_max(type, k) AS type, max(k) AS most, sum(k) AS total FROM k GROUP BY doc_id, col) SELECT doc_id, col, type, CAST(total - most AS BIGINT) AS exceptions FROM m WHERE 0.9 * total <= most AND most < total""",
}
#: Forms of emoji, one added to each document, and what is said of each: kind, parts, points, bytes, qualification, diagnosis.
EMOJI = (
    ("\U0001f468‍\U0001f469‍\U0001f467", "sequence", "BASE + ZWJ + BASE + ZWJ + BASE", 5, 18, "fully", None, False),
    ("1️⃣", "sequence", "BASE + VS16 + KEYCAP", 3, 7, "fully", None, False),
    ("\U0001f1fa\U0001f1f8", "sequence", "RI + RI", 2, 8, "fully", None, False),
    ("©", "atomic", "BASE", 1, 2, "unqualified", None, False),
    (" \U0001f3fb", "sequence", "BASE + TONE", 2, 5, "unqualified", "orphan", False),
    ("\U0001f3f4\U000e0067\U000e0062", "sequence", "BASE + TAG + TAG", 3, 12, "fully", "shattered", False),
    ("\U0001f600︎", "sequence", "BASE + VS15", 2, 7, "fully", None, True),
)
ADD_EMOJI = "concat(text, ' ', CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{e[0].strip()}'" for i, e in enumerate(EMOJI)) + " END)"
ORACLES["emoji_forms"] = (
    "WITH e(k, seq, kind, parts, points, bytes, qualification, diagnosis, forced_text) AS (VALUES " + ", ".join(f"({i}, {', '.join(map(quoted, e))})" for i, e in enumerate(EMOJI)) + ")"
    " SELECT doc_id, seq, kind, parts, CAST(points AS BIGINT) AS points, CAST(bytes AS BIGINT) AS bytes, qualification, diagnosis, forced_text, CAST(1 AS BIGINT) AS n FROM documents JOIN e ON doc_id % 7 = k"
)
#: The same forms with loose joiners and selectors beside them.
ADD_LOOSE = "concat(text, 'a\u200db\ufe0f \u200d ', " + ADD_EMOJI.removeprefix("concat(text, ' ', ")
ORACLES["remedy_smart"] = profiles.SMART.replace("{text}", ADD_LOOSE).replace("{{", "{").replace("}}", "}")
ORACLES["profile_partition"] = "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\p{S}')) AS BIGINT) AS text_symbols, CAST(CASE WHEN doc_id % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS hybrids, CAST(CASE WHEN doc_id % 7 = 3 THEN 0 ELSE 1 END AS BIGINT) AS emoji FROM documents"
#: Documents (without ampersands, which could start an entity) in one layer: blanks as in URLs, entities, escapes, or all of it in Base64.
LAYERED = """CASE doc_id % 4 WHEN 0 THEN replace(replace(text, '%', '%25'), ' ', '%20') WHEN 1 THEN replace(text, 'a', '&#97;') WHEN 2 THEN replace(text, 'e', '\\u0065') ELSE {b} END"""
ORACLES["sequential_deobfuscate"] = "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN replace(text, chr(10), ' ') ELSE text END AS plain, CASE WHEN doc_id % 4 = 0 AND regexp_matches(text, '[ %]') THEN 'url' WHEN doc_id % 4 = 1 AND text LIKE '%a%' THEN 'html' WHEN doc_id % 4 = 2 AND text LIKE '%e%' THEN 'escape' WHEN doc_id % 4 = 3 AND strlen(text) > 12 THEN 'base64' ELSE '' END AS layers FROM (SELECT doc_id, replace(text, '&', '+') AS text FROM documents)"
