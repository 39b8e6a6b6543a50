"""Report texts made from order keys by SQL that Spark and DuckDB both understand.

``TEXTS`` holds, for each indicator type, a text with values to be found and near misses;
S is the key as a string, K the key, HASH256(x) a SHA-256 in hex.
"""

from __future__ import annotations

import re

B = "chr(92)"
S = "CAST(o_orderkey AS STRING)"


def mod(n: int) -> str:
    return f"CAST(o_orderkey % {n} AS STRING)"


LONG = "HASH256(S) || HASH256(S || 'x')"
TEXTS = {
    "md5": "'MD5: ' || md5(S) || ' and ' || CASE WHEN K % 5 = 0 THEN 'aaaaaaaaaaaaaaaabbbbbbbbbbbbbbbb' WHEN K % 7 = 0 THEN 'x' || md5(S) WHEN K % 11 = 0 THEN 'abcdef' || substr(md5(S), 1, 26) ELSE md5(S || 'b') END",
    "sha1": "'SHA1 ' || sha1(S) || ' or ' || upper(sha1(S || 'y')) || ' not ' || substr(sha1(S), 2)",
    "sha256": "'sha256: ' || HASH256(S) || ' x ' || CASE WHEN K % 3 = 0 THEN '4142434445464748494a4b4c4d4e4f505152535455565758595a313233343536' WHEN K % 3 = 1 THEN '4d5a' || substr(HASH256(S), 5) ELSE substr(HASH256(S), 1, 63) END",
    "sha512": f"'SHA512: ' || {LONG} || '. then ' || CASE WHEN K % 2 = 0 THEN HASH256(S || 'c') || HASH256(S || 'd') ELSE substr({LONG}, 1, 127) END || ' end'",
    "ssdeep": "'96:' || substr(md5(S), 1, 12) || ':' || substr(md5(S), 13, 10) || ' 9:abcd:efgh 12:ab:cdef'",
    "domains": f"'host' || {mod(97)} || '.evil' || {mod(13)} || '.com and www.google.com plus bad.google.com or file' || {mod(9)} || '.exe x.document.com sub[.]mal' || {mod(5)} || '(.)net google.com'",
    "ips": f"'10.' || {mod(256)} || '.' || {mod(300)} || '.7 and 192[.]168[.]' || {mod(9)} || '[.]0' || {mod(10)} || ' x 8(.)8.4.' || {mod(256)}",
    "ipv6": "'2001:db8:85a3:0:0:8a2e:370:' || substr(md5(S), 1, 4) || ' fe80::' || substr(md5(S), 5, 3) || ' 1:2:3 end'",
    "urls": f"'https://site' || {mod(50)} || '.org/a?q=' || S || ' http://github.com/x/' || CASE WHEN K % 2 = 0 THEN 'exploit' ELSE 'readme' END || ' ftp://docs.python.org/lib http://example.com/x hxxp://pastebin.com/raw' || {mod(7)}",
    "emails": f"'a' || S || '.b@mail' || {mod(9)} || '.org also x+y' || {mod(4)} || '@z.net bad@nodot'",
    "bitcoin": "'1' || substr(md5(S), 1, 20) || 'XyZxyz 3' || substr(md5(S), 1, 31) || ' bc1q' || substr(sha1(S), 1, 38)",
    "ethereum": "'0x' || sha1(S) || ' 0x' || md5(S)",
    "monero": f"'4' || CASE WHEN K % 3 = 0 THEN 'C' ELSE 'A' END || substr({LONG}, 1, 93)",
    "cves": f"'CVE-20' || lpad({mod(25)}, 2, '0') || '-' || CAST(K % 90000 + 1000 AS STRING) || ' cve-2020-12 cve-2019-00' || lpad({mod(77)}, 2, '0')",
    "mitre_attack": f"'T' || lpad({mod(10000)}, 4, '0') || ' T1566.00' || {mod(10)} || ' T12345'",
    "registry": f"'HKLM' || {B} || 'Software' || {B} || 'Run' || {mod(50)} || ' HKCU' || {B} || 'x.y end'",
    "mutex": f"'Global' || {B} || 'App' || {mod(40)} || 'Mutex Mutex:m_' || {mod(9)} || ' xMutexY'",
    "service_names": f"'Service: Svc' || {mod(30)} || ' Update' || {mod(20)} || 'Service short'",
    "named_pipes": f"{B} || {B} || '.' || {B} || 'pipe' || {B} || 'p' || {mod(77)} || ' pipe'",
    "filenames": f"'doc' || {mod(60)} || '.pdf cmd.exe ab.js tool_' || {mod(5)} || '.EXE note.txt'",
    "filepaths": f"'C:' || {B} || 'Temp' || {B} || 'f' || {mod(30)} || '.exe /tmp/x' || {mod(20)} || '/run.sh /usr/a %APPDATA%' || {B} || 'm' || {mod(9)} || '.dll'",
    "mac_addresses": "'00:1B:44:' || upper(substr(md5(S), 1, 2)) || ':3A:B7 aabb.ccdd.' || substr(md5(S), 3, 4) || ' 00:11:22'",
    "user_agents": f"'User-Agent: Bot/' || {mod(40)} || ' (X; y)' || chr(10) || 'Mozilla/5.0 (W) z'",
    "yara": f"'text rule R' || {mod(20)} || ' {{ strings: a = {{ 01 }} condition: b }} tail rule x'",
    "asn": "'AS' || S || ' ASX AS12345678901'",
    "jwt": "'eyJ' || substr(md5(S), 1, 10) || '.eyJ' || md5(S) || '.' || sha1(S) || ' eyJbad'",
    "cert_serials": "'serial: ' || substr(sha1(S), 1, CASE WHEN K % 2 = 0 THEN 20 ELSE 21 END) || ' AA:BB:CC:DD:EE:FF:00:' || upper(substr(md5(S), 1, 2)) || ' 00:11:22:33:44:55'",
    "hosts": f"'c2' || {mod(30)} || '.evil.net theater.org ' || {B} || {B} || {B} || {B} || 'PCHOST' || {mod(9)} || {B} || {B} || ' x.example.org'",
}
TEXTS = {t: e.replace("{{", "{").replace("}}", "}") for t, e in TEXTS.items()}


def text_sql(ioc_type: str, engine: str, key: str = "o_orderkey") -> str:
    """The text expression of a type in one engine's SQL."""
    e = re.sub(r"\bS\b(?!')", S, re.sub(r"\bK\b", "o_orderkey", TEXTS[ioc_type])).replace("o_orderkey", key)
    return nested_hash(e) if engine == "spark" else e.replace("HASH256", "sha256")


def nested_hash(e: str) -> str:
    """HASH256(x) as sha2(x, 256), whatever brackets x has."""
    while (at := e.find("HASH256(")) >= 0:
        depth, i = 1, at + 8
        while depth:
            depth += {"(": 1, ")": -1}.get(e[i], 0)
            i += 1
        e = f"{e[:at]}sha2({e[at + 8 : i - 1]}, 256){e[i:]}"
    return e


#: Warning lists of the classification queries: (id, name, description, type, attributes, values).
LISTS = [
    ("alexa", "Alexa Top", "popular domains", "string", ["domain", "hostname"], ["google.com", "facebook.com", "youtube.com"]),
    ("dns", "Public DNS", "public resolvers", "string", ["ip-src", "ip-dst", "ip"], ["8.8.8.8", "8.8.4.4", "1.1.1.1"]),
    ("dyn", "Dynamic DNS", "dynamic names", "regex", ["domain"], [r"^dyn[0-9]+\.", "(broken["]),
    ("google-cidr", "Google ranges", None, "cidr", ["ip-src", "ip-dst"], ["8.8.8.0/24", "142.250.0.0/15", "9.9.9.9"]),
    ("private", "Private ranges", "RFC 1918", "cidr", ["ip-src", "ip-dst"], ["10.0.0.0/8", "192.168.1.1/16"]),
    ("security", "Security vendors", "vendor words", "substring", ["domain", "hostname", "url"], ["virustotal", "Kaspersky"]),
    ("v6", "Documentation v6", "RFC 3849", "cidr", ["ipv6"], ["2001:db8::/64"]),
    ("unnamed", None, None, "hostname", ["other"], []),
]

#: Indicators of the classification queries, from customer keys.
IOCS = """
SELECT 'ips' AS ioc_type, '8.8.' || CAST(c_custkey % 9 AS STRING) || '[.]' || CAST(c_custkey % 16 AS STRING) AS value FROM customer
UNION ALL SELECT 'ips', CAST(10 + c_custkey % 5 AS STRING) || '.1.2.3' FROM customer
UNION ALL SELECT 'ips', CASE WHEN c_custkey % 2 = 0 THEN '142.251.0.' || CAST(c_custkey % 256 AS STRING) ELSE '9.9.9.9' END FROM customer
UNION ALL SELECT 'domains', CASE c_custkey % 6 WHEN 0 THEN 'Google[.]com' WHEN 1 THEN 'my.virustotal.io' WHEN 2 THEN 'dyn' || CAST(c_custkey AS STRING) || '.org' WHEN 3 THEN 'kasper' WHEN 4 THEN 'youtube.com' ELSE 'x' || CAST(c_custkey AS STRING) || '.org' END FROM customer
UNION ALL SELECT 'urls', CASE c_custkey % 3 WHEN 0 THEN 'hxxp://google[.]com:80/' || CAST(c_custkey AS STRING) WHEN 1 THEN 'https://www.kaspersky.com/' || CAST(c_custkey AS STRING) ELSE 'http://ok.org/' || CAST(c_custkey AS STRING) END FROM customer
UNION ALL SELECT 'emails', 'u' || CAST(c_custkey AS STRING) || CASE c_custkey % 3 WHEN 0 THEN '[@]kaspersky[.]com' WHEN 1 THEN '@youtube.com' ELSE '@fine.org' END FROM customer
UNION ALL SELECT 'ipv6', CASE WHEN c_custkey % 2 = 0 THEN '2001:db8::' ELSE '2001:DB8:0:1::' END || CAST(c_custkey % 100 AS STRING) FROM customer
UNION ALL SELECT 'md5', md5(CAST(c_custkey AS STRING)) FROM customer"""
