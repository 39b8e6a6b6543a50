"""DuckDB SQL of the registered queries.

Written apart from the column expressions: mostly by splitting texts at white space and
judging whole tokens, instead of searching with boundaries.
"""

from __future__ import annotations

from html.entities import html5

from ..functions import lists as L
from .queries import BASE, DOMAIN_CASES, HARD_HTML, LATER, LATEST, NOW, SHOP_SQL, SUFFIX_SQL, cased
from .reports import IOCS, LISTS, text_sql

HEX = "0-9a-fA-F"
#: Digits of x as text: every byte ASCII and more than half of them shown.
ASCII_HEX = "regexp_full_match(x, '([0-7][0-9a-fA-F])+') AND 4 * len(list_filter(regexp_extract_all(lower(x), '..'), lambda p: p BETWEEN '20' AND '7e' OR p IN ('09', '0a', '0d'))) > len(x)"
GOOD_HASH = f"len(list_distinct(string_split(lower(x), ''))) >= 4 AND NOT regexp_matches(lower(x), '0123456789|abcdef|fedcba|9876543210') AND NOT (len(x) >= 64 AND len(x) % 2 = 0 AND (regexp_matches(lower(x), '^(4d5a|504b|377a|89504e47|ffd8ff)') OR {ASCII_HEX}))"
DOTS = "replace(replace(replace(x, '[.]', '.'), '(.)', '.'), '{.}', '.')"
FANG = "replace({}, '.', '[.]')"
URL_FANG = "replace(replace(replace(x, 'http://', 'hxxp://'), 'https://', 'hxxps://'), '.', '[.]')"
DOMAIN_TOKEN = f"regexp_full_match({DOTS}, '([a-z0-9-]+\\.)+(com|net|org)') AND NOT contains({DOTS}, 'document') AND (NOT regexp_matches({DOTS}, '(^|\\.)google\\.com$') OR starts_with({DOTS}, 'bad.'))"
MAIL = r"regexp_extract(x, '([A-Za-z0-9][A-Za-z0-9._-]*@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,})', 1)"

#: By type: what a whole token must be, and the value it gives.
TOKENS = {
    "md5": (f"regexp_full_match(x, '[{HEX}]{{32}}') AND {GOOD_HASH}", "x"),
    "sha1": (f"regexp_full_match(x, '[{HEX}]{{40}}') AND {GOOD_HASH}", "x"),
    "sha256": (f"regexp_full_match(x, '[{HEX}]{{64}}') AND {GOOD_HASH}", "x"),
    "sha512": (f"regexp_full_match(rtrim(x, '.'), '[{HEX}]{{64}}[{HEX}]{{64}}') AND {GOOD_HASH}", "rtrim(x, '.')"),
    "ssdeep": ("regexp_full_match(x, '[0-9]{2,}:[A-Za-z0-9/+]{3,}:[A-Za-z0-9/+]{3,}')", "x"),
    "domains": (DOMAIN_TOKEN, FANG.format(DOTS)),
    "ips": (f"regexp_full_match({DOTS}, '((0|[1-9][0-9]{{0,2}})\\.){{3}}(0|[1-9][0-9]{{0,2}})') AND list_max(list_transform(string_split({DOTS}, '.'), lambda p: try_cast(p AS INT))) <= 255", FANG.format(DOTS)),
    "ipv6": ("regexp_full_match(x, '([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|[0-9a-f]{1,4}::[0-9a-f]{1,4}')", "x"),
    "urls": ("contains(x, '://') AND NOT contains(x, 'readme') AND NOT contains(x, 'docs.python.org') AND NOT contains(x, '://example.')", URL_FANG),
    "emails": (f"{MAIL} <> ''", f"replace(replace({MAIL}, '@', '[@]'), '.', '[.]')"),
    "bitcoin": (f"regexp_full_match(x, 'bc1[a-zA-HJ-NP-Z0-9]{{39,59}}|[13][a-zA-HJ-NP-Z0-9]{{25,34}}') AND NOT regexp_full_match(x, '[{HEX}]+')", "x"),
    "ethereum": (f"regexp_full_match(x, '0x[{HEX}]{{40}}')", "x"),
    "monero": ("regexp_full_match(x, '4[0-9AB][a-zA-Z0-9]{93}')", "x"),
    "cves": ("regexp_full_match(x, '(?i)cve-[0-9]{4}-[0-9]{4,7}')", "x"),
    "mitre_attack": (r"regexp_full_match(x, 'T[0-9]{4}(\.[0-9]{3})?')", "x"),
    "registry": (r"regexp_full_match(x, '(HKLM|HKCU)\\[A-Za-z0-9\\_-]+')", "x"),
    "mutex": (r"regexp_full_match(x, '((Global|Local)\\)?[A-Za-z0-9][A-Za-z0-9_-]{2,}(Mutex|MUTEX)|Mutex:[A-Za-z0-9_-]+')", "x"),
    "service_names": ("regexp_full_match(x, 'Svc[0-9]+|Update[0-9]+Service')", "regexp_replace(x, 'Service$', '')"),
    "named_pipes": (r"regexp_full_match(x, '\\\\\.\\pipe\\[A-Za-z0-9_-]+')", "x"),
    "filenames": (r"regexp_full_match(x, '(?i)[a-z0-9][a-z0-9_.-]{2,}\.(pdf|exe|js|com|html|htm)') AND lower(x) <> 'cmd.exe'", "x"),
    "filepaths": (r"regexp_full_match(x, 'C:\\.*|/tmp/.*|%APPDATA%.*')", "x"),
    "mac_addresses": (r"regexp_full_match(x, '([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}|([0-9a-f]{4}\.){2}[0-9a-f]{4}')", r"CASE WHEN contains(x, '.') THEN rtrim(regexp_replace(replace(x, '.', ''), '(..)', '\1:', 'g'), ':') ELSE x END"),
    "asn": ("regexp_full_match(x, 'AS[0-9]{1,10}')", "x"),
    "jwt": (r"regexp_full_match(x, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+')", "x"),
    "cert_serials": ("regexp_full_match(x, '[0-9a-f]{20}|([0-9A-F]{2}:){7}[0-9A-F]{2}')", r"lower(CASE WHEN contains(x, ':') THEN x ELSE rtrim(regexp_replace(x, '(..)', '\1:', 'g'), ':') END)"),
    "hosts": (rf"({DOMAIN_TOKEN} AND NOT contains(x, 'the')) OR regexp_full_match(x, '\\\\\\\\PCHOST[0-9]+\\\\')", rf"CASE WHEN contains(x, 'PCHOST') THEN regexp_extract(x, '(PCHOST[0-9]+)', 1) ELSE {FANG.format(DOTS)} END"),
}


def tokens_sql(ioc_type: str, frm: str, key: str, text: str, head: str = "") -> str:
    """SELECT of key, [head,] value for the distinct tokens of a type in a text."""
    cond, value = TOKENS[ioc_type]
    return f"SELECT {key}, {head}unnest(list_distinct(list_transform(list_filter(regexp_split_to_array({text}, '\\s+'), lambda x: {cond}), lambda x: {value}))) AS value FROM {frm}"


def extract_sql(ioc_type: str) -> str:
    text = text_sql(ioc_type, "duckdb")
    if ioc_type == "user_agents":
        return f"SELECT o_orderkey, regexp_extract({text}, 'User-Agent: ([^\\n]*)', 1) AS value FROM orders"
    if ioc_type == "yara":
        return f"SELECT o_orderkey, regexp_extract({text}, '(rule R[0-9]+ .*\\}}) tail', 1) AS value FROM orders"
    return tokens_sql(ioc_type, "orders", "o_orderkey", text)


def base_cte(head: str = "o_custkey::VARCHAR AS source_value, o_orderkey") -> str:
    return "base AS (" + " UNION ALL ".join(tokens_sql(t, "orders", head, text_sql(t, "duckdb"), f"'{t}' AS ioc_type, ") for t in BASE) + ")"


CLASSED = base_cte() + """, c AS (
  SELECT DISTINCT source_value, ioc_type, value, (ioc_type = 'cves' AND regexp_matches(lower(value), '^cve-20[0-9][02468]')) AS w FROM base)"""

#: What (?U)\\s has.
WHITE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"

#: A text as ASCII: white space as blanks, letters, digits and marks of other scripts as chr(1), what else is not ASCII as chr(2).
ASCII_TEXT = f"regexp_replace(regexp_replace(regexp_replace(text, '[{WHITE}]', ' ', 'g'), '[^\\x00-\\x7F\\p{{L}}\\p{{Nd}}\\p{{Mn}}]', chr(2), 'g'), '[^\\x00-\\x7F]', chr(1), 'g')"
#: Values are ASCII and go from one word boundary to another, so no word with a letter of another script is part of one.
WHOLE_WORDS = r"regexp_replace(a, '[A-Za-z0-9_]*\x01[A-Za-z0-9_\x01]*', chr(2), 'g')"


def listed(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def holds(c: str, words: list[str]) -> str:
    """Whether a text contains one of the words."""
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


ENDINGS = "|".join(d.replace(".", r"\.") for d in L.LEGITIMATE_DOMAINS)
BEFORE_ENDING = rf"regexp_extract(lower(x), '^(.*?)\.(?:{ENDINGS})$', 1)"
#: A real top-level domain, no label of code, not well known; below a well-known domain a suspicious word is needed.
REAL_DOMAIN = f"""list_last(string_split(lower(x), '.')) IN {listed(L.TLDS)} AND list_last(string_split(lower(x), '.')) NOT IN {listed(L.FILE_EXTENSIONS)}
  AND NOT list_has_any(string_split(lower(x), '.'), [{listed(L.CODE_WORDS)[1:-1]}]) AND lower(x) NOT IN {listed([*L.LEGITIMATE_DOMAINS, *L.LEGITIMATE_HOSTS])}
  AND CASE WHEN {BEFORE_ENDING} <> '' THEN {holds(BEFORE_ENDING, L.SUSPICIOUS_LABELS)} ELSE len(x) <= 253 AND list_max(list_transform(string_split(x, '.'), lambda p: len(p))) <= 63 END"""
FILE_ENDINGS = "exe|dll|bat|sys|htm|html|js|jar|jpg|png|vb|scr|pif|chm|zip|rar|cab|pdf|doc|docx|ppt|pptx|xls|xlsx|swf|gif|ps1|vbs|wsf|hta|cmd|com|lnk|ini|inf|reg"


def document_rows(frm: str = "documents", key: str = "doc_id") -> str:
    """E-mails, addresses, SHA-1, domains, file names and hosts of the documents, anywhere in them and in any case; they hold no URLs and no other types."""
    label = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    found = lambda regex, text="t", group=0: f"regexp_extract_all({text}, '{regex}', {group})"
    mails = found(r"\b[a-zA-Z0-9][a-zA-Z0-9._-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,63}\b")
    addresses = found(r"\b[0-9]{1,3}(?:[\[({]?\.[\])}]?[0-9]{1,3}){3}\b")
    plain_address = r"regexp_replace(x, '[\[({]\.[\])}]', '.', 'g')"
    ip = f"regexp_full_match({plain_address}, '((0|[1-9][0-9]{{0,2}})\\.){{3}}(0|[1-9][0-9]{{0,2}})') AND list_max(list_transform(string_split({plain_address}, '.'), lambda p: try_cast(p AS INT))) <= 255"
    digests = f"list_concat({found(f'(?:SHA-1|SHA1|sha1) *:? *([{HEX}]{{40}})', 'a', 1)}, {found(f'{chr(92)}b[{HEX}]{{40}}{chr(92)}b')})"
    dotted = found(rf"\b(?:{label}\.)+[a-zA-Z]{{2,63}}\b|\b(?:{label}(?:\[\.\]|\(\.\)|\{{\.\}}|\.))+[a-zA-Z]{{2,63}}\b")
    files = found(rf"(?i)\b[a-z0-9][a-z0-9_.-]{{2,}}\.(?:{FILE_ENDINGS})\b")
    part = lambda t, source, cond, value: f"SELECT {key}, '{t}' AS ioc_type, unnest(list_distinct(list_transform(list_filter({source}, lambda x: {cond}), lambda x: {value}))) AS value FROM d"
    domains = f"list_filter(list_transform({dotted}, lambda x: {DOTS}), lambda x: {REAL_DOMAIN})"
    return f"w AS (SELECT {key}, {ASCII_TEXT} AS a FROM {frm}), d AS MATERIALIZED (SELECT *, {domains} AS domains FROM (SELECT {key}, a, {WHOLE_WORDS} AS t FROM w)), r AS (" + " UNION ALL ".join([
        part("emails", mails, "true", "replace(replace(x, '@', '[@]'), '.', '[.]')"),
        part("ips", addresses, ip, f"replace({plain_address}, '.', '[.]')"), part("sha1", digests, GOOD_HASH, "x"),
        part("domains", "domains", "true", FANG.format("x")), part("hosts", "domains", f"NOT {holds('lower(' + FANG.format('x') + ')', L.HOST_STOPS)}", FANG.format("x")),
        part("filenames", files, f"len(x) > 4 AND lower(x) NOT IN {listed(L.SYSTEM_FILES)}", "x"),
    ]) + ")"


CLEAN = "value"
for _old, _new in L.REFANG:
    CLEAN = f"replace({CLEAN}, '{_old}', '{_new}')"

#: Conditions of the warning lists of the queries, by list, on the refanged value v and the type t.
NAMES = {r[0]: (r[1], r[2] or "") for r in LISTS}
WL = f"""
i AS ({IOCS}),
v AS (SELECT ioc_type, value, {CLEAN} AS v, lower({CLEAN}) AS l FROM i),
ip AS (SELECT *, CASE WHEN regexp_full_match(v, '([0-9]+\\.){{3}}[0-9]+') THEN list_reduce(list_transform(string_split(v, '.'), lambda p: p::BIGINT), lambda a, b: a * 256 + b) END AS n FROM v),
s AS (
  SELECT *, CASE WHEN ioc_type = 'domains' AND l IN ('google.com', 'facebook.com', 'youtube.com') THEN 'Alexa Top'
                 WHEN ioc_type = 'ips' AND l IN ('8.8.8.8', '8.8.4.4', '1.1.1.1') THEN 'Public DNS' END AS str,
    CASE WHEN ioc_type IN ('domains', 'emails', 'md5') AND regexp_matches(l, '^dyn[0-9]+\\.') THEN 'Dynamic DNS' END AS rex,
    CASE WHEN ioc_type = 'ips' AND (n // 256 = 526344 OR n // 131072 = 18301) THEN 'Google ranges'
         WHEN ioc_type = 'ips' AND (n // 16777216 = 10 OR n // 65536 = 49320) THEN 'Private ranges'
         WHEN ioc_type = 'ipv6' AND regexp_matches(l, '^2001:db8::') THEN 'Documentation v6' END AS cid,
    CASE WHEN ioc_type IN ('domains', 'urls') AND (contains(l, 'virustotal') OR contains(l, 'kaspersky') OR contains('virustotal', l) OR contains('kaspersky', l)) THEN 'Security vendors' END AS sub
  FROM ip),
m AS (SELECT *, coalesce(str, rex, cid, sub) AS hit FROM s)"""
DESCRIPTION = "CASE hit " + " ".join(f"WHEN '{n}' THEN '{d}'" for n, d in NAMES.values() if n) + " END"
DROPPED = "ioc_type = 'emails' AND (regexp_matches(l, '@.*(virustotal|kaspersky)') OR split_part(l, '@', 2) IN ('google.com', 'facebook.com', 'youtube.com'))"


def stage_sql(column: str) -> str:
    return f"WITH {WL} SELECT DISTINCT ioc_type, value, {column} AS warning_list FROM m WHERE {column} IS NOT NULL"


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def html_sql() -> str:
    """Comments and what is not shown, then tags, whose quoted values may hold their end, then references, each read once by the HTML standard's table."""
    attributes = r'''(?:[^>=]+|=\s*(?:"[^"]*"|''[^'']*''|))*'''
    e = f"regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|" + "|".join(f"<{t}\\b{attributes}>.*?(?:</{t}\\s*>|\\z)" for t in ("script", "style")) + "', ' ', 'g')"
    for tag in ("noscript", "head"):
        e = f"regexp_replace({e}, '(?is)<{tag}\\b{attributes}>.*?(?:</{tag}\\s*>|\\z)', ' ', 'g')"
    e = f"regexp_replace({e}, '(?s)<[!/a-zA-Z?]{attributes}(?:>|\\z)', ' ', 'g')"
    names = ", ".join(f"({sql_text('&' + n)}, {sql_text(c)})" for n, c in html5.items())
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
    western = ", ".join(f"({n}, {sql_text(c)})" for n in range(0x80, 0xA0) if (c := bytes([n]).decode("cp1252", "ignore")))
    digits = "ltrim(regexp_replace(piece, '[&#;xX]', '', 'g'), '0')"
    number = f"CASE WHEN NOT starts_with(piece, '&#') OR len({digits}) NOT BETWEEN 1 AND 8 THEN NULL ELSE list_reduce(list_transform(string_split(lower({digits}), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * CASE WHEN regexp_matches(piece, '^&#[xX]') THEN 16 ELSE 10 END + b) END"
    return f"""
WITH names(name, chars) AS (VALUES {names}), western(w, chars) AS (VALUES {western}),
bare AS (SELECT row_number() OVER () AS r, page_id, html, regexp_replace(html, '^[{WHITE}]+|[{WHITE}]+$', '', 'g') AS bare, {e} AS shown FROM pages),
lines AS (SELECT *, regexp_matches(bare, '^(https?|hxxps?)://') AND len(regexp_split_to_array(bare, '\\r\\n|\\n|\\r')) < 5 AS address, regexp_extract_all(shown, '&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&') AS pieces FROM bare),
parts AS (SELECT r, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pos FROM lines),
read AS (SELECT *, {number} AS n, regexp_extract(piece, '^&({old})') AS old FROM parts),
said AS (
  SELECT r, pos, CASE WHEN starts_with(piece, '&#') THEN CASE WHEN w.chars IS NOT NULL THEN w.chars WHEN n BETWEEN 1 AND 55295 OR n BETWEEN 57344 AND 1114111 THEN chr(n::INT) ELSE chr(65533) END
    WHEN right(piece, 1) = ';' AND whole.chars IS NOT NULL THEN whole.chars WHEN old <> '' THEN part.chars || substr(piece, len(old) + 1) ELSE piece END AS chars
  FROM read LEFT JOIN names AS whole ON whole.name = piece LEFT JOIN names AS part ON part.name = old LEFT JOIN western AS w ON w.w = n),
joined AS (SELECT r, string_agg(chars, '' ORDER BY pos) AS text FROM said GROUP BY r)
SELECT page_id, CASE WHEN address THEN bare WHEN html IS NOT NULL THEN regexp_replace(regexp_replace(coalesce(text, ''), '[{WHITE}]+', ' ', 'g'), '^ | $', '', 'g') END AS text FROM lines LEFT JOIN joined USING (r)"""


HOST, PATH = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)", "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
LAST = f"list_last(string_split(regexp_replace({PATH}, '^/+|/+$', '', 'g'), '/'))"


def stix_sql() -> str:
    return f"""
WITH {CLASSED}, u AS (
  SELECT source_value, ioc_type, w,
    CASE ioc_type WHEN 'emails' THEN '[email-addr:value = ''' ELSE '[vulnerability:name = ''' END || replace(replace(value, '[@]', '@'), '[.]', '.') || ''']' AS pattern
  FROM c WHERE ioc_type <> 'asn')
SELECT DISTINCT source_value, pattern, ioc_type || ' indicator' AS name, w AS is_warning,
  CASE WHEN w THEN 'Even ''years''' ELSE '' END AS warning_list, '' AS description FROM u"""


def json_sql() -> str:
    return f"""
WITH {CLASSED},
n AS (SELECT source_value, ioc_type, '"' || ioc_type || '":[' || string_agg('"' || value || '"', ',' ORDER BY value) || ']' AS j FROM c WHERE NOT w GROUP BY source_value, ioc_type),
x AS (SELECT source_value, 'warning_list_matches' AS ioc_type, '"warning_list_matches":{{"cves":[' || string_agg('{{"description":"","value":"' || value || '","warning_list":"Even ''years''"}}', ',' ORDER BY value) || ']}}' AS j FROM c WHERE w GROUP BY source_value)
SELECT source_value, '{{' || string_agg(j, ',' ORDER BY ioc_type) || '}}' AS json FROM (SELECT * FROM n UNION ALL SELECT * FROM x) GROUP BY source_value"""


def text_report_sql() -> str:
    order = "CASE ioc_type WHEN 'emails' THEN 1 WHEN 'cves' THEN 2 ELSE 3 END"
    title = "CASE ioc_type WHEN 'emails' THEN 'Email Addresses' WHEN 'cves' THEN 'Vulnerabilities (CVEs)' ELSE 'AS Numbers' END"
    nl = "chr(10)"
    return f"""
WITH {CLASSED},
n AS (SELECT source_value, {order} AS o, {nl} || '## ' || {title} || {nl} || {nl} || string_agg(value, {nl} ORDER BY value) AS t FROM c WHERE NOT w GROUP BY source_value, ioc_type),
x AS (SELECT source_value, {nl} || '# Warning List Matches' || {nl} || {nl} || 'The following indicators were found in warning lists and might be false positives:' || {nl} || {nl} || {nl}
        || '## Vulnerabilities (CVEs) in Warning Lists' || {nl} || {nl} || string_agg(value || ' - *Even ''years''*', {nl} ORDER BY value) AS t FROM c WHERE w GROUP BY source_value)
SELECT source_value, '# Indicators of Compromise (IOCs) Extracted' || {nl} || {nl} || string_agg(t, {nl} ORDER BY o) AS report
FROM (SELECT source_value, o, t FROM n UNION ALL SELECT source_value, 9, t FROM x) GROUP BY source_value"""


def oracle_sql() -> dict[str, str]:
    orders = lambda value: f"SELECT o_orderkey, {value.replace('STRING', 'VARCHAR')} AS value FROM orders"
    hash_case = "CASE o_orderkey % 4 WHEN 0 THEN md5(CAST(o_orderkey AS STRING)) WHEN 1 THEN repeat('ab', 16) WHEN 2 THEN sha256(CAST(o_orderkey AS STRING)) ELSE repeat('41', 32) || '5A5B5C5D' END"
    verdicts = "[true, false, true, false, false, false, false, false, true, false, false, true, false]"
    odd = "source_value::BIGINT % 2 = 1"
    out = {f"extract_{t}": extract_sql(t) for t in [*TOKENS, "user_agents", "yara"]}
    out |= {
        "extract_all_counts": f"WITH {document_rows()} SELECT ioc_type, count(*)::BIGINT AS n FROM r GROUP BY ioc_type",
        "extract_documents": f"WITH {document_rows()} SELECT doc_id, ioc_type, value FROM r WHERE ioc_type IN ('emails', 'ips', 'sha1')",
        "extract_fanged": f"SELECT o_orderkey, 'urls' AS ioc_type, unnest(list_filter(string_split({text_sql('urls', 'duckdb')}, ' '), lambda x: {TOKENS['urls'][0]})) AS value FROM orders UNION ALL SELECT o_orderkey, 'emails', unnest(list_transform(list_filter(string_split({text_sql('emails', 'duckdb')}, ' '), lambda x: {MAIL} <> ''), lambda x: {MAIL})) FROM orders",
        "extract_wide_counts": f"WITH {base_cte('o_orderkey')} SELECT o_orderkey, count(*) FILTER (ioc_type = 'emails')::BIGINT AS n_emails, count(*) FILTER (ioc_type = 'asn')::BIGINT AS n_asn, count(*) FILTER (ioc_type = 'cves')::BIGINT AS n_cves FROM base GROUP BY o_orderkey",
        "extract_pages": r"""
            SELECT page_id, 'urls' AS ioc_type, replace(replace(replace(regexp_extract(url, '^[a-z]+://[^/?#]+(/[-a-zA-Z0-9()@:%_+.~#?&/=]*)?'), 'http://', 'hxxp://'), 'https://', 'hxxps://'), '.', '[.]') AS value FROM pages
            UNION ALL SELECT page_id, 'filenames', unnest(list_distinct(list_filter(regexp_split_to_array(url, '[^A-Za-z0-9_.-]+'), lambda x: regexp_full_match(x, '(?i)[a-z0-9][a-z0-9_.-]{2,}\.(com|html|htm|js|pdf)')))) FROM pages""",
        "hash_validity": f"WITH o AS ({orders(hash_case)}) SELECT o_orderkey, value, {GOOD_HASH} AS valid FROM (SELECT *, value AS x FROM o)",
        "domain_validity": f"WITH o AS ({orders(cased(DOMAIN_CASES, 'o_orderkey'))}) SELECT o_orderkey, value, {verdicts}[o_orderkey % {len(DOMAIN_CASES)} + 1] AS valid FROM o",
        "defang_values": f"SELECT page_id, replace(regexp_replace(url, '^http', 'hxxp'), '.', '[.]') AS url_defanged, replace({HOST}, '.', '[.]') AS host_defanged, 'x[@]' || replace({HOST}, '.', '[.]') AS email_defanged FROM pages",
        "refang_values": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'http://a' || c_custkey || '.com' WHEN 1 THEN 'https://b.org/x' WHEN 2 THEN 'u@mail.net' WHEN 3 THEN 'http://c:80//d' WHEN 4 THEN 'v@w@x@y' ELSE 'plain' || c_custkey END AS clean FROM customer",
        "html_to_text": html_sql(),
        "detect_file_type": "SELECT o_orderkey, ['pdf', 'html', 'html', 'text', ['pdf', 'html', 'html', 'text', 'text', 'text', 'text'][o_orderkey % 7 + 1]][o_orderkey % 5 + 1] AS by_mime, ['pdf', 'html', 'html', 'text', 'text', 'text', 'text'][o_orderkey % 7 + 1] AS by_path, CASE o_orderkey % 7 WHEN 1 THEN 'html' WHEN 6 THEN 'pdf' END AS parser FROM orders",
        "url_parts": f"SELECT page_id, {HOST} AS host, {PATH} AS path, contains(url, '://') AS valid, CASE WHEN {LAST} = '' THEN replace({HOST}, '.', '_') ELSE {LAST} END || CASE WHEN regexp_matches({LAST}, '\\.html?$') THEN '' ELSE '.html' END AS temp_name FROM pages",
        "output_filename": f"SELECT page_id, left(regexp_replace({HOST} || CASE WHEN {LAST} <> '' THEN '_' || {LAST} ELSE '' END, '[^A-Za-z0-9_.-]', '_', 'g'), 50) || '_iocs.json' AS of_url, 'report.' || page_id || '_iocs.stix.json' AS of_file FROM pages",
        "table_text": "SELECT n_nationkey, n_name || ' ' || n_regionkey || chr(10) || n_name || chr(10) AS text FROM nation",
        "wl_string_join": stage_sql("str"), "wl_regex_join": stage_sql("rex"), "wl_cidr_join": stage_sql("cid"), "wl_substring_join": stage_sql("sub"),
        "wl_classify": f"WITH {WL} SELECT ioc_type, value, hit IS NOT NULL AS is_warning, hit AS warning_list, {DESCRIPTION} AS description FROM m WHERE NOT ({DROPPED})",
        "wl_warnings_only": f"WITH {WL} SELECT ioc_type, hit AS warning_list, count(*)::BIGINT AS n FROM m WHERE hit IS NOT NULL GROUP BY ALL",
        "wl_email_drop": f"WITH {WL} SELECT DISTINCT ioc_type, value FROM m WHERE {DROPPED}",
        "wl_categories": "SELECT lower(split_part(r_name, ' ', 1)) AS category, count(*)::BIGINT AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) GROUP BY category",
        "wl_diagnose": "WITH n AS (SELECT n_regionkey, '10.' || lpad(n_nationkey::VARCHAR, 2, '1') || '.0.0/16' AS net FROM nation) SELECT 'r' || n_regionkey AS list_id, any_value(r_name) || ' IP ranges' AS name, 'cidr' AS type, count(*)::BIGINT AS n_values, bool_or(net = '10.17.0.0/16') AS matched, array_to_string(list_sort(list(net))[1:3], ',') AS sample FROM n JOIN region ON r_regionkey = n_regionkey GROUP BY n_regionkey",
        "wl_explain": f"""
            WITH {WL}, d AS (SELECT DISTINCT ioc_type, value, str, rex, cid, sub, hit FROM m),
            u AS (SELECT ioc_type, value, hit, unnest([{{'s': 'string', 'l': str}}, {{'s': 'regex', 'l': rex}}, {{'s': 'cidr', 'l': cid}}, {{'s': 'substring', 'l': sub}}]) AS e FROM d)
            SELECT ioc_type, value, e.s AS stage, e.l AS warning_list, e.l = hit AS wins, true AS is_warning FROM u WHERE e.l IS NOT NULL
            UNION ALL SELECT ioc_type, value, NULL, NULL, false, false FROM d WHERE hit IS NULL""",
        "dedup_ordered": f"WITH {base_cte()} SELECT ioc_type, value, min(o_orderkey)::BIGINT AS o_orderkey FROM base GROUP BY ioc_type, value",
        "dedup_incremental_anti": f"WITH {base_cte()} SELECT ioc_type, value FROM base WHERE {odd} EXCEPT SELECT ioc_type, value FROM base WHERE NOT {odd}",
        "multi_source_union": f"WITH {base_cte()} SELECT ioc_type, value FROM base UNION SELECT ioc_type, value FROM base",
        "counts_with_total": f"WITH {base_cte()} SELECT ioc_type, count(*)::BIGINT AS n FROM base GROUP BY ROLLUP (ioc_type)",
        "json_rows": json_sql(), "text_sections": text_report_sql(), "stix_patterns": stix_sql(),
        "written_reports": f"SELECT source_value || '_iocs.txt' AS file, report || chr(10) AS report FROM ({text_report_sql()})",
        "stix_bundle_sizes": f"SELECT source_value, count(*)::BIGINT AS n_objects FROM ({stix_sql()}) GROUP BY source_value",
        "persist_sources": f"SELECT 'file' AS kind, o_custkey::VARCHAR AS value, '{NOW[:10]}' AS first_seen, CASE WHEN count(*) FILTER (o_orderkey % 3 = 0) > 0 THEN '{LATER[:10]}' ELSE '{NOW[:10]}' END AS last_seen FROM orders GROUP BY o_custkey",
        "persist_iocs": f"WITH {CLASSED}, k AS (SELECT source_value, ioc_type, value, w AS is_warning, CASE WHEN w THEN 'Even ''years''' ELSE '' END AS warning_list, '' AS warning_description FROM c) SELECT * EXCLUDE source_value FROM k WHERE {odd} EXCEPT SELECT * EXCLUDE source_value FROM k WHERE NOT {odd}",
        "persist_run_iocs": f"WITH {CLASSED} SELECT source_value, count(*)::BIGINT AS n_iocs, count(*) FILTER (w)::BIGINT AS n_warnings FROM c GROUP BY source_value",
        "shared_iocs_topk": f"WITH {base_cte()} SELECT ioc_type, value, count(DISTINCT source_value)::BIGINT AS n_sources FROM base GROUP BY ALL ORDER BY n_sources DESC, ioc_type, value LIMIT 20",
        "chunked_extract": f"WITH {document_rows()} SELECT doc_id, ioc_type, value FROM r WHERE ioc_type IN ('emails', 'ips', 'sha1')",
        "chunk_sizes": "SELECT doc_id, ceil(length(text) / 1000)::BIGINT AS n_chunks, (length(text) + 100 * (ceil(length(text) / 1000) - 1))::BIGINT AS n_chars FROM documents WHERE length(text) > 0",
        "stream_extract": f"WITH {document_rows()} SELECT doc_id, ioc_type, value FROM r WHERE ioc_type IN ('emails', 'ips', 'sha1')",
    }
    plain = lambda cases: cased([f"'{c}'" for c in cases], "o_orderkey").replace("STRING", "VARCHAR")
    nation = "CASE WHEN n_nationkey = 3 OR n_nationkey % 6 = 4 THEN '' WHEN n_nationkey % 2 = 0 THEN n_name WHEN n_nationkey % 6 IN (1, 3, 5) THEN '<' || n_name END"
    out |= {
        "extract_page_texts": f"WITH {document_rows(f'({html_sql()})', 'page_id')} SELECT page_id, ioc_type, value FROM r WHERE ioc_type IN ('emails', 'ips', 'sha1')",
        "extract_url_domains": "SELECT o_orderkey, 'domains' AS ioc_type, unnest(['evil' || o_orderkey % 50 || '[.]com', 'c2-[.]evil' || o_orderkey % 50 || '[.]com']) AS value FROM orders",
        "extract_registered": "SELECT o_orderkey, 'ticket' AS ioc_type, 'TCK-' || o_orderkey AS value FROM orders WHERE length('TCK-' || o_orderkey) > 5",
        "html_hard_cases": f"SELECT o_orderkey, {plain([t for _, t in HARD_HTML.values()])} AS text FROM orders",
        "wl_regex_backrefs": "SELECT value, CASE WHEN word IN ('abab', 'zz') THEN 'Doubled' ELSE 'Named' END AS warning_list FROM (SELECT ['abab', 'abac', 'zz', 'pqpqx', 'rs-rs', 'rs-pq'][c_custkey % 6 + 1] AS word, word || '.org' || c_custkey AS value FROM customer) WHERE word IN ('abab', 'zz', 'pqpqx', 'rs-rs')",
        "wl_substring_many": "WITH c AS (SELECT DISTINCT CASE WHEN c_custkey % 7 = 0 THEN 'vend' || c_custkey ELSE 'x-vend' || c_custkey * 17 % 20000 || '.com' END AS value FROM customer), e AS (SELECT '-vend' || k || '.co' AS e FROM range(10000) AS t(k)) SELECT DISTINCT value, 'Many' AS warning_list FROM c JOIN e ON contains(value, e) OR contains(e, value)",
        "wl_substring_suffixes": f"WITH c AS (SELECT DISTINCT {SUFFIX_SQL.replace('STRING', 'VARCHAR')} AS value FROM customer), e AS (SELECT 'cdn' || k || '.cloudfront.net' AS e FROM range(10000) AS t(k)) SELECT DISTINCT value, 'Many' AS warning_list FROM c JOIN e ON contains(lower(value), e) OR contains(e, lower(value))",
        "wl_regex_many": f"WITH c AS (SELECT {SHOP_SQL.replace('STRING', 'VARCHAR')} AS value, c_custkey FROM customer), n AS (SELECT *, regexp_extract(lower(value), 'shop([0-9]+)x', 1) AS n FROM c) SELECT value, 'Many' AS warning_list FROM n WHERE c_custkey % 5 IN (0, 1) AND n::INT < 50000 AND n::INT % 10000 NOT IN (1, 2) OR c_custkey % 5 = 4 AND c_custkey % 10000 = 1 AND c_custkey < 50000",
        "chunked_small": f"WITH {document_rows()} SELECT doc_id, ioc_type, value FROM r WHERE ioc_type = 'sha1'",
        "chunked_ahead": f"WITH {document_rows()} SELECT doc_id, ioc_type, value FROM r WHERE ioc_type = 'sha1'",
        "warning_lines": f"WITH {CLASSED} SELECT source_value, 'cves ' || value || ' (Even ''years'')' AS line FROM c WHERE w",
        "hashes_section": "SELECT CASE WHEN n_nationkey % 3 > 0 THEN 'md5' ELSE 'unknown' END AS type, CASE WHEN n_nationkey % 5 > 0 THEN md5(n_name) ELSE '' END AS value FROM nation",
        "store_round_trip": f"WITH {CLASSED} SELECT source_value, started, count(*)::BIGINT AS n_iocs, count(*) FILTER (w)::BIGINT AS n_warnings FROM c JOIN (VALUES ('{NOW[:10]}'), ('{LATER[:10]}')) AS t(started) ON started = '{NOW[:10]}' OR {odd} GROUP BY ALL",
        "store_replaced_and_concurrent": f"""
            WITH {CLASSED}, k AS (
              SELECT *, '{NOW[:10]}' AS started, 'a' AS run FROM c UNION ALL SELECT *, '{LATER[:10]}', ioc_type FROM c WHERE ioc_type IN ('cves', 'emails')
              UNION ALL SELECT *, '{LATEST[:10]}', 'odd' FROM c WHERE {odd} UNION ALL SELECT *, '{LATEST[:10]}', 'third' FROM c WHERE source_value::BIGINT % 3 = 0)
            SELECT coalesce(source_value, 'all') AS source_value, coalesce(started, 'all') AS started, count(DISTINCT source_value || started || run)::BIGINT AS n_runs,
              count(*)::BIGINT AS n_links, count(DISTINCT ioc_type || value)::BIGINT AS n_iocs
            FROM k GROUP BY GROUPING SETS ((source_value, started), ())""",
        "read_files_once": """
            WITH f AS (SELECT n_nationkey, n_name, ['text', 'html', 'text', 'html', 'pdf', 'html'][n_nationkey % 6 + 1] AS kind, n_nationkey = 3 AS large, n_nationkey % 6 = 4 AND left(n_name, 1) IN ('A', 'E', 'I', 'O', 'U') AS bad FROM nation)
            SELECT n_nationkey, kind, CASE WHEN large OR bad THEN NULL WHEN n_nationkey % 2 = 0 THEN n_name ELSE '<' || n_name END AS text,
              CASE WHEN large THEN 'size' WHEN bad THEN 'pdf' END AS stage, CASE WHEN large THEN 'file too large: 5001 bytes' WHEN bad THEN 'bad header ' || left(n_name, 1) END AS error FROM f""",
        "read_files": f"SELECT n_nationkey, {nation} AS text FROM nation",
    }
    held = "ioc_type IN ('emails', 'ips', 'sha1')"
    observed = f"WITH {document_rows()} SELECT 'rows' AS metric, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'bytes', coalesce(sum(strlen(text)), 0)::BIGINT FROM documents UNION ALL SELECT t, count(r.value)::BIGINT FROM (VALUES ('emails'), ('ips'), ('sha1')) AS k(t) LEFT JOIN r ON r.ioc_type = t GROUP BY t"
    out |= {
        "range_extract": f"WITH {document_rows()} SELECT DISTINCT size::INT AS size, ioc_type, value FROM r, (VALUES (3000), (65536)) AS t(size) WHERE {held}",
        "range_bytes": "SELECT size::INT AS size, (SELECT sum(strlen(coalesce(text, '')) + 1) FROM documents)::BIGINT AS n_bytes, true AS bounded FROM (VALUES (3000), (65536)) AS t(size)",
        "stream_by_source": f"WITH {document_rows()} SELECT doc_id, ioc_type, value FROM r WHERE {held}",
        "observed_totals": observed, "stream_progress": observed,
    }
    fetches = """
        f AS (SELECT n_nationkey AS k, n_name, v, ['2024-01-01', '2024-01-31', CASE WHEN n_nationkey % 5 = 0 THEN '2024-03-01' ELSE '2024-02-01' END][v + 1] AS fetched,
            CASE WHEN v = 1 AND n_nationkey % 3 = 0 THEN 'unreadable' WHEN v = 2 AND n_nationkey % 4 = 0 THEN 'no content' WHEN v = 0 AND n_nationkey % 6 = 1 THEN 'no list' WHEN v = 2 AND n_nationkey % 7 = 2 THEN 'no content' END AS problem
          FROM nation, range(3) AS t(v))"""
    out |= {
        "wl_as_of": f"WITH {fetches}, g AS (SELECT k, max(v) AS v FROM f WHERE problem IS NULL AND fetched < '2024-02-02' GROUP BY k) SELECT 'n' || k AS list_id, any_value(n_name) || ' v' || any_value(g.v) AS name, any_value(g.v + 1)::BIGINT AS n_values, any_value(fetched) FILTER (f.v = g.v) AS fetched, any_value(g.v) = 0 AS stale, (count(*) FILTER (problem IS NOT NULL AND f.v > g.v AND fetched < '2024-02-02'))::BIGINT AS n_passed FROM f JOIN g USING (k) GROUP BY k",
        "wl_quarantine": f"WITH {fetches} SELECT 'n' || k AS list_id, fetched, problem, CASE problem WHEN 'unreadable' THEN 20 WHEN 'no list' THEN 19 WHEN 'no content' THEN CASE WHEN k % 4 = 0 THEN 0 END END::BIGINT AS n_chars FROM f WHERE problem IS NOT NULL",
    }
    title = "'# Indicators of Compromise (IOCs) Extracted' || chr(10) || chr(10)"
    warned = "'# Warning List Matches' || chr(10) || chr(10) || 'The following indicators were found in warning lists and might be false positives:' || chr(10) || chr(10) || chr(10) || '## Tickets in Warning Lists' || chr(10) || chr(10) || 'TCK-' || t || ' - *Old tickets*'"
    plain = "chr(10) || '## Tickets' || chr(10) || chr(10)"
    out["registered_reports"] = f"""
        WITH n AS (SELECT *, n_nationkey < 20 AS old, n_nationkey + 100 AS t FROM nation),
        r AS (SELECT *, {title} || CASE WHEN old THEN chr(10) || {warned} ELSE {plain} || 'TCK-' || t END AS report FROM n)
        SELECT n_name AS source_value, report, '[x-ticket:value = ' || chr(39) || 'TCK-' || t || chr(39) || ']' AS pattern, old AS is_warning FROM r"""
    out["command_line"] = "SELECT n_nationkey || '_iocs.json' AS file, '10[.]' || n_nationkey || '[.]3[.]4' AS ips, 'u' || n_nationkey || '[@]mail[.]org' AS emails, 'none' AS cves FROM nation"
    return out
