"""Measures, ledgers and atlases in SQL that both engines share (see plans.template); a second part of the catalog."""

from __future__ import annotations

from glyphlake.functions import chars

# Relative frequencies of English letters in percent, and common English trigrams.
ENGLISH = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074), strict=True))
TRIGRAMS = "the and ing ion tio ent ati for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess".split()
#: Our constants: the risk of a token for each vector.
VECTORS = {
    "fracture": (99, "[A-Za-z][" + chars.INVISIBLE + chars.PICTOGRAPHS + "]+[A-Za-z]"),
    "bidi": (90, "[" + chars.BIDI + "]"),
    "tags": (85, "[" + chars.TAGS + "]"),
    "mixed_script": (80, "[A-Za-z].*[\\x{0400}-\\x{04FF}]|[\\x{0400}-\\x{04FF}].*[A-Za-z]"),
    "confusable": (60, "[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]"),
    "marks": (50, "\\p{M}{3,}"),
    "sore_thumb": (40, "^[A-Za-z]+[0-9][A-Za-z]*$"),
}
PILLAR = {"fracture": "obfuscation", "bidi": "execution", "tags": "execution", "mixed_script": "spoofing", "confusable": "spoofing", "marks": "obfuscation", "sore_thumb": "spoofing"}

_TOKEN = "[\\p{L}\\p{N}\\p{M}_\\-" + chars.INVISIBLE + chars.PICTOGRAPHS + "]+"
_TOKENS = f"SELECT doc_id, tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, explode(@all{{{_TOKEN}}}) AS tok FROM pdocs) GROUP BY doc_id, tok"
# Each distinct token of a document is held against all vectors in one pass.
_FOUND = ", ".join(f"CASE WHEN regexp_like(tok, @rx{{{p}}}) THEN '{k}' END" for k, (_, p) in VECTORS.items())
_RISK = " ".join(f"WHEN '{k}' THEN {r}" for k, (r, _) in VECTORS.items())
_PILLAR = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PILLAR.items())
_HITS = f"SELECT doc_id, tok, n, vector, CASE vector {_PILLAR} END AS pillar, CAST(CASE vector {_RISK} END AS BIGINT) AS risk FROM (SELECT doc_id, tok, n, explode(@array({_FOUND})) AS vector FROM t) WHERE vector IS NOT NULL"
_LEDGER = f"WITH t AS ({_TOKENS}), h AS ({_HITS})"
_RANK = "CASE WHEN max(risk) >= 85 THEN 'CRIT' WHEN max(risk) >= 60 THEN 'HIGH' ELSE 'MED' END"
_BAND = "CASE WHEN entropy < 3 THEN 'low' WHEN entropy <= 4.5 THEN 'text' WHEN entropy <= 6.5 THEN 'mixed' ELSE 'high' END"
_LETTERS = "SELECT doc_id, l, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, lower(c) AS l, count(*) AS n FROM (SELECT doc_id, explode(@all{[A-Za-z]}) AS c FROM pdocs) GROUP BY doc_id, lower(c))"
_ENGLISH = "CASE l " + " ".join(f"WHEN '{c}' THEN {v / 100:.5f}D" for c, v in ENGLISH.items()) + " END"
_TWO = "@count{[" + chars.BIDI + "\\x{001B}]}"
#: Places of hits with their priority; other characters are dropped before any window.
_HIT_PLACES = "SELECT doc_id, i, CASE WHEN regexp_like(c, @rx{[" + chars.BIDI + chars.TAGS + "]}) THEN '1 execution' WHEN regexp_like(c, @rx{[" + chars.SPACES + chars.INVISIBLE + "]}) THEN '2 obfuscation' ELSE '3 spoofing' END AS kind FROM @pos{@chars} WHERE regexp_like(c, @rx{[" + chars.INVISIBLE + chars.SPACES + "\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]})"
#: Buckets of hits.
BUCKETS = {"bidi": chars.BIDI, "join": chars.JOIN, "tags": chars.TAGS, "spaces": chars.SPACES, "ignorable": chars.IGNORABLE}

MEASURES: dict[str, str] = {
    "stats_byte_entropy": f"SELECT doc_id, entropy, entropy / 8.0D AS saturation, min_entropy, renyi2, n, ic, {_BAND} AS band, (n >= 256) AS confident FROM (SELECT doc_id, -sum(p * log2(p)) AS entropy, -log2(max(p)) AS min_entropy, -log2(sum(p * p)) AS renyi2, CAST(sum(k) AS BIGINT) AS n, CASE WHEN sum(k) > 1 THEN 256.0D * sum(CAST(k AS DOUBLE) * (k - 1)) / (CAST(sum(k) AS DOUBLE) * (sum(k) - 1)) ELSE 0.0D END AS ic FROM (SELECT doc_id, k, CAST(k AS DOUBLE) / sum(k) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, b, count(*) AS k FROM (SELECT doc_id, explode(@pairs) AS b FROM pdocs) GROUP BY doc_id, b)) GROUP BY doc_id)",
    "stats_benford_deviation": "SELECT d, n, n / CAST(sum(n) OVER () AS DOUBLE) AS share, log10(1 + 1 / CAST(d AS DOUBLE)) AS expected FROM (SELECT d, CAST(count(*) AS BIGINT) AS n FROM (SELECT substr(x, 1, 1) AS d FROM (SELECT explode(@all{[1-9][0-9]*}) AS x FROM pdocs)) GROUP BY d)",
    "stats_kld": f"SELECT doc_id, sum(p * log2(p / ({_ENGLISH}))) AS english, sum(p * log2(p * 26)) AS uniform FROM ({_LETTERS}) GROUP BY doc_id",
    "stats_line_quantiles": "SELECT doc_id, CAST(min(length(l)) AS BIGINT) AS shortest, percentile(length(l), 0.25) AS p25, percentile(length(l), 0.5) AS middle, avg(length(l)) AS mean, percentile(length(l), 0.75) AS p75, percentile(length(l), 0.9) AS p90, CAST(max(length(l)) AS BIGINT) AS longest FROM (SELECT doc_id, @outer{@lines} AS l FROM pdocs) GROUP BY doc_id",
    "stats_base64_phase": "SELECT phase, c, CAST(count(*) AS BIGINT) AS n FROM (SELECT i % 4 AS phase, c FROM @pos{@all{[A-Za-z0-9+/=]}}) GROUP BY phase, c",
    "stats_word_shape": "SELECT doc_id, CASE WHEN w > 0 THEN a / CAST(w AS DOUBLE) ELSE 0.0D END AS word_length, CASE WHEN s > 0 THEN w / CAST(s AS DOUBLE) ELSE CAST(w AS DOUBLE) END AS sentence_length FROM (SELECT doc_id, @count{[\\p{L}\\p{N}]} AS a, @count{[\\p{L}\\p{N}]+} AS w, @count{[.!?]+(?:[\\s\\x{00A0}]|\\z)} AS s FROM pdocs)",
    # tokens: one row of each vector, each token, each document, and each pillar
    "token_ledger": f"{_LEDGER} SELECT doc_id, tok, max(n) AS n, CAST(count(*) AS BIGINT) AS vectors, max(risk) AS risk, {_RANK} AS level FROM h GROUP BY doc_id, tok",
    "token_threat_stack": f"{_LEDGER} SELECT vector, pillar, max(risk) AS risk, {_RANK} AS level, CAST(count(DISTINCT tok) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY vector, pillar",
    "token_paranoia_peak": f"{_LEDGER} SELECT doc_id, tok, risk, vector FROM (SELECT doc_id, tok, risk, vector, row_number() OVER (PARTITION BY doc_id ORDER BY risk DESC, tok, vector) AS k FROM h) WHERE k = 1",
    "token_pillar_counts": f"{_LEDGER} SELECT doc_id, pillar, CAST(count(DISTINCT tok) AS BIGINT) AS tokens FROM h GROUP BY doc_id, pillar",
    "token_signals": f"{_LEDGER} SELECT DISTINCT vector, tok, risk FROM h",
    "token_deep_fragmentation": "SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, translate(lower(m), ' ._-', '') AS word FROM (SELECT doc_id, explode(@all{(?:[A-Za-z]{1,3}[ ._\\-]){3,}[A-Za-z]{1,3}}) AS m FROM pdocs)) GROUP BY doc_id, word",
    "token_binary_signatures": "SELECT doc_id, @count{TVqQ|JVBERi|UEsDB|iVBORw0KGgo|R0lGOD|f0VMR} AS base64_magic, @count{(?i)4d5a9000|25504446|504b0304|89504e47|7f454c46} AS hex_magic, @count{\\x{007B}\\x{007B}[^\\x{007D}]*\\x{007D}\\x{007D}|<%=|\\x{0024}\\x{007B}} AS templates FROM pdocs",
    "token_plausible_domains": "SELECT tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[^\\s\\x{00A0}]+}) AS tok FROM pdocs) WHERE (tok LIKE '%.%' OR tok LIKE '%xn--%') AND NOT regexp_like(tok, @rx{[\\x{0000}\\x{FFFD}" + chars.NONCHARACTERS + "]}) GROUP BY tok",
    "lens_domain_structure": "SELECT host, CAST(length(host) - length(replace(host, '.', '')) + 1 AS BIGINT) AS labels, regexp_like(host, @rx{[\\x{2024}\\x{FF0E}\\x{3002}]}) AS pseudo, regexp_like(host, @rx{(?:^|\\.)xn--}) AS punycode, (regexp_like(host, @rx{[a-z]}) AND regexp_like(host, @rx{[\\x{0400}-\\x{04FF}]})) AS mixed, lower(translate(host, 'аеорсх', 'aeopcx')) AS skeleton FROM (SELECT DISTINCT regexp_extract(url, @rx{^[a-z]+://([^/?#]+)}, 1) AS host FROM pages) WHERE host <> ''",
    "lens_dns": "SELECT doc_id, @count{[A-Za-z0-9\\-.]} AS allowed, CAST(length(text) AS BIGINT) - @count{[A-Za-z0-9\\-.]} AS refused FROM pdocs",
    "lens_text": "SELECT doc_id, @count{[" + chars.INVISIBLE + "]} AS hidden, @count{[" + chars.SPACES + "]} AS odd_spaces, @count{[\\x{E000}-\\x{F8FF}]} AS private_use, @count{[\\x{2028}\\x{2029}]} AS odd_breaks FROM pdocs",
    # atlas
    "atlas_invisibles": "SELECT CAST(ascii(c) AS BIGINT) AS cp, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS docs, max(CASE WHEN regexp_like(c, @rx{[" + chars.BIDI + chars.TAGS + "]}) THEN 'BLOCK' WHEN regexp_like(c, @rx{[" + chars.JOIN + chars.SELECTORS + "]}) THEN 'REVIEW' WHEN regexp_like(c, @rx{[" + chars.SPACES + "]}) THEN 'NORM' ELSE 'REVIEW' END) AS policy FROM (SELECT doc_id, explode(@all{[" + chars.INVISIBLE + chars.SPACES + "]}) AS c FROM pdocs) GROUP BY CAST(ascii(c) AS BIGINT)",
    "provenance_severity_totals": "SELECT severity, CAST(count(*) AS BIGINT) AS docs FROM (SELECT CASE WHEN @has{\\p{Latin}} AND @has{\\p{Cyrillic}|\\p{Greek}} THEN 'CRITICAL Mixed' WHEN @has{[^\\x{0000}-\\x{007F}]} THEN 'Single-Script' ELSE 'ASCII-Only' END AS severity FROM pdocs) GROUP BY severity",
    # scores, with constants of our own where the documentation gives none
    "score_integrity": "SELECT doc_id, score, CASE WHEN score = 0 THEN 'HEALTHY' WHEN score < 40 THEN 'WORN' WHEN score < 100 THEN 'DAMAGED' ELSE 'CORRUPT' END AS state FROM (SELECT doc_id, CASE WHEN @has{[\\x{FFFD}\\x{0000}]} THEN 40 + 2 * @count{[\\x{FFFD}\\x{0000}]} ELSE 0 END + CASE WHEN @has{[\\x{E000}-\\x{F8FF}]} THEN 10 + @count{[\\x{E000}-\\x{F8FF}]} ELSE 0 END + CASE WHEN @has{\\p{M}{3,}} THEN 40 ELSE 0 END + CASE WHEN @has{[" + chars.TAGS + "]} THEN 20 + @count{[" + chars.TAGS + "]} ELSE 0 END AS score FROM pdocs)",
    "score_threat_tiers": "SELECT doc_id, execution, spoofing, obfuscation, CASE WHEN execution > 0 THEN 1 WHEN spoofing > 0 THEN 2 WHEN obfuscation > 0 THEN 3 ELSE 0 END AS tier, CASE WHEN (CASE WHEN execution > 0 THEN 1 ELSE 0 END + CASE WHEN spoofing > 0 THEN 1 ELSE 0 END + CASE WHEN obfuscation > 0 THEN 1 ELSE 0 END) > 1 THEN 10 ELSE 0 END AS bonus FROM (SELECT doc_id, " + _TWO + " AS execution, @count{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]} AS spoofing, @count{[" + chars.JOIN + chars.TAGS + chars.IGNORABLE + "]} AS obfuscation FROM pdocs)",
    "score_exploit_vs_complexity": "SELECT doc_id, 40 * @count{[" + chars.BIDI + "]} + 25 * @count{[\\x{0430}\\x{0435}\\x{043E}\\x{0440}\\x{0441}\\x{0445}]} + 15 * @count{[" + chars.TAGS + "]} AS exploit, @count{[0-9]+} + 2 * @count{\\p{M}} + @count{[^\\x{0000}-\\x{007F}]} AS complexity FROM pdocs",
    "score_sensors": "SELECT doc_id, CASE WHEN @has{[\\x{202E}]} THEN 'high' WHEN @has{[\\x{FE10}-\\x{FE1F}\\x{FE30}-\\x{FE4F}]} THEN 'warn' ELSE 'none' END AS geometry, CASE WHEN @has{[" + chars.NONCHARACTERS + "\\x{FFFD}]} THEN 'warn' ELSE 'none' END AS cosmology, CASE WHEN @has{[\\x{20A0}-\\x{20CF}]} THEN 'warn' ELSE 'none' END AS financials FROM pdocs",
    "score_hud_step": "SELECT doc_id, CAST(coalesce(min(CASE WHEN i >= 100 THEN i END), min(i)) AS BIGINT) AS next FROM (" + _HIT_PLACES + ") GROUP BY doc_id",
    "remedy_xray": "SELECT doc_id, CAST(min(i) AS BIGINT) AS first, CAST(max(i) AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS hits, min(kind) AS priority FROM (SELECT doc_id, i, kind, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS zone FROM (SELECT doc_id, i, kind, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 40 THEN 0 ELSE 1 END AS fresh FROM (" + _HIT_PLACES + "))) GROUP BY doc_id, zone",
    # Ranks go by the number of forms of each frequency, of which there are few; forms of one frequency take its ranks in any order.
    "stats_zipf_mse": "SELECT CAST(count(*) AS BIGINT) AS forms, avg((n / CAST(top AS DOUBLE) - 1 / CAST(rank AS DOUBLE)) * (n / CAST(top AS DOUBLE) - 1 / CAST(rank AS DOUBLE))) AS mse FROM (SELECT n, top, explode(sequence(before + 1, before + k)) AS rank FROM (SELECT n, k, CAST(sum(k) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) - k AS BIGINT) AS before, max(n) OVER () AS top FROM (SELECT n, CAST(count(*) AS BIGINT) AS k FROM (SELECT tok, CAST(count(*) AS BIGINT) AS n FROM (SELECT explode(@all{[a-zA-Z]+}) AS tok FROM pdocs) GROUP BY tok) GROUP BY n)))",
    "report_narrative": "SELECT doc_id, concat(CASE WHEN @has{[" + chars.BIDI + chars.TAGS + "]} THEN 'Execution risk: remove bidirectional and tag controls.' WHEN @has{\\p{Latin}} AND @has{\\p{Cyrillic}|\\p{Greek}} THEN 'Spoofing risk: compare skeletons.' WHEN @has{[" + chars.INVISIBLE + chars.SPACES + "]} THEN 'Obfuscation: normalise spaces and invisibles.' ELSE 'No finding.' END, ' ', CAST(length(text) AS STRING), ' code points.') AS narrative FROM pdocs",
    "score_hud_registry": "SELECT doc_id, bucket, n FROM (SELECT doc_id, bucket, CASE bucket " + " ".join(f"WHEN '{b}' THEN n_{b}" for b in BUCKETS) + " END AS n FROM (SELECT *, explode(@array(" + ", ".join(f"'{b}'" for b in BUCKETS) + ")) AS bucket FROM (SELECT doc_id, " + ", ".join(f"@count{{[{p}]}} AS n_{b}" for b, p in BUCKETS.items()) + " FROM pdocs))) WHERE n > 0",
}
TABLES = {"lens_domain_structure": ("pages",)}
