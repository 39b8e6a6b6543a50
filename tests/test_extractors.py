"""Extraction of every type: golden report, valid and invalid snippets, policies."""

import pytest
from pyspark.sql import functions as F

from indicant.functions import extractors
from indicant.functions import text as T
from indicant.functions.patterns import Pattern
from indicant.operators.extract import counts_by_type, extract_all, extract_wide

REPORT = r"""INCIDENT NOTES
   - Lure sent from attacker@malicious-domain.com
   - Attachment: invoice_2024.pdf (SHA256: e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855)
   - Dropper MD5: 5f4dcc3b5aa765d61d8327deb882cf99
   - C2 server: 185.220.101.45, evil-command.net (at 192.168.1.100), backup.malware-c2.org
   - https://evil-command.net/beacon.php
   - mutex: Global\SystemUpdateMutex
   - service: MalwareUpdateService
   - C:\Windows\Temp\update.exe
   - /tmp/.hidden/backdoor.sh
   - HKLM\Software\Microsoft\Windows\CurrentVersion\Run
   - User-Agent: Mozilla/5.0 (Windows NT 10.0; Win64; x64) BotClient/1.0
   - IPv6 C2: 2001:0db8:85a3:0000:0000:8a2e:0370:7334
   - MAC: 00:1B:44:11:3A:B7, AS13335
   - CVE-2021-44228, T1055, T1566.001
   - 1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa 0x742d35Cc6634C0532925a3b844Bc9e7595f0bEb4
   - SHA1: 356a192b7913b04c54574d18c28d46e6395428ab
   - \\.\pipe\MalwarePipe
rule MalwareDetection {
    strings:
        $b = { 01 02 }
    condition:
        any of them
}
"""

GOLDEN = {
    "md5": {"5f4dcc3b5aa765d61d8327deb882cf99"}, "sha1": {"356a192b7913b04c54574d18c28d46e6395428ab"},
    "sha256": {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"},
    "ssdeep": {"2001:0db8:85a3", "0000:0000:8a2e"},
    "domains": {"malicious-domain[.]com", "evil-command[.]net", "backup[.]malware-c2[.]org"}, "hosts": {"malicious-domain[.]com", "backup[.]malware-c2[.]org"},
    "ips": {"185[.]220[.]101[.]45", "192[.]168[.]1[.]100"}, "ipv6": {"2001:0db8:85a3:0000:0000:8a2e:0370:7334"},
    "urls": {"hxxps://evil-command[.]net/beacon[.]php"}, "emails": {"attacker[@]malicious-domain[.]com"},
    "bitcoin": {"1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"}, "ethereum": {"0x742d35Cc6634C0532925a3b844Bc9e7595f0bEb4"},
    "cves": {"CVE-2021-44228"}, "mitre_attack": {"T1055", "T1566.001"}, "registry": {r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run"},
    "mutex": {r"Global\SystemUpdateMutex"}, "service_names": {"MalwareUpdate"}, "named_pipes": {r"\\.\pipe\MalwarePipe"},
    "filenames": {"malicious-domain.com", "invoice_2024.pdf", "update.exe"}, "filepaths": {r"C:\Windows\Temp\update.exe", "/tmp/.hidden/backdoor.sh"},
    "mac_addresses": {"00:1B:44:11:3A:B7"}, "user_agents": {"Mozilla/5.0 (Windows NT 10.0; Win64; x64) BotClient/1.0"}, "asn": {"AS13335"},
    "yara": {"rule MalwareDetection {\n    strings:\n        $b = { 01 02 }\n    condition:\n        any of them\n}"},
}


def values(spark, ioc_type, text, defang=False):
    row = spark.createDataFrame([(text,)], "text string").select(extractors.EXTRACTORS[ioc_type](F.col("text"), defang).alias("v")).first()
    return set(row.v)


def test_golden_report(spark):
    df = spark.createDataFrame([(1, REPORT), (2, None), (3, "nothing here")], "id int, text string")
    found = {}
    for r in extract_all(df).collect():
        assert r.id == 1
        found.setdefault(r.ioc_type, set()).add(r.value)
    assert found == GOLDEN
    wide = {r.id: r.iocs for r in extract_wide(df).collect()}
    assert {k: set(v) for k, v in wide[1].items()} == GOLDEN and wide[2] == {} and wide[3] == {}
    assert counts_by_type(extract_all(df), total=True).filter("ioc_type IS NULL").first().n == sum(map(len, GOLDEN.values()))


HEX = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"


@pytest.mark.parametrize(("ioc_type", "text", "expected"), [
    ("md5", f"MD5: {HEX}x and x{HEX}", {HEX}),
    ("md5", f"MD5: {HEX}0", {HEX}),
    ("md5", "a" * 32 + " " + "ab" * 16 + " 0123456789" + HEX[:22], set()),
    ("md5", f"é{HEX} {HEX.upper()}", {HEX.upper()}),
    ("sha1", f"SHA1:{HEX}01234567", {HEX + "01234567"}),
    ("sha512", f"{HEX * 4} {HEX[1:] * 4}0123", {HEX * 4}),
    ("sha256", "41" * 20 + "42434445464748494a4b4c4d", set()),
    ("sha256", "4d5a" + HEX + HEX[:28], set()),
    ("domains", "a.evil.com sub.evil[.]com b(.)evil.org www.google.com x.exe", {"a.evil.com", "b.evil.org"}),
    ("domains", "evil.google.com badminton.google.com mail.google.com learn.microsoft.com", {"evil.google.com", "badminton.google.com"}),
    ("domains", "hxxp://c2.bad-host.net:8080/x", {"c2.bad-host.net"}),
    ("ips", "1.2.3.4.5 256.1.1.1 01.2.3.4 10[.]0[.]0[.]1 9(.)9(.)9(.)9", {"1.2.3.4", "10.0.0.1", "9.9.9.9"}),
    ("ipv6", "fe80::1 ::1 x::1 2001:db8:0:0:0:0:0:1, ::ffff:1.2.3.4", {"fe80::1", "::1", "::ffff:1.2.3.4"}),
    ("urls", "https://github.com/a/readme https://github.com/a/exploit https://xbox.com/y", {"https://github.com/a/exploit", "https://xbox.com/y"}),
    ("urls", "https://docs.python.org/3 https://docs.python.org/cve-1 http://localhost/x http://example.com http://www.example.com/a.png", {"https://docs.python.org/cve-1", "http://www.example.com/a.png"}),
    ("urls", "hxxp://evil[.]com/x https://a.b/p?q=1", {"hxxp://evil", "https://a.b/p?q=1"}),
    ("emails", "x+y@a.org A.b-c@d-e.co.uk @z.net q@nodot", {"y@a.org", "A.b-c@d-e.co.uk"}),
    ("bitcoin", "bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq 3" + HEX[:31], {"bc1qar0srrr7xfkvy5l643lydnw9re59gtzzwf5mdq"}),
    ("cves", "cve-2020-1234 CVE-2020-123 CVE-2020-12345678", {"cve-2020-1234"}),
    ("mutex", r"Local\abcMUTEX Mutex:x_1 aMutex", {r"Local\abcMUTEX", "Mutex:x_1"}),
    ("service_names", "Service: abc_1 BadSvc", {"abc_1", "Bad"}),
    ("filenames", "svchost.exe ab.exe abc.EXE report.tar.zip", {"abc.EXE", "report.tar.zip"}),
    ("filepaths", '"C:\\Temp\\a b\\x.exe" %APPDATA%\\evil.dll, /usr/bin/python3; /tmp/a', {"%APPDATA%\\evil.dll", "/usr/bin/python3"}),
    ("mac_addresses", "00-1b-44-11-3a-b7 aabb.ccdd.eeff 00:11", {"00-1b-44-11-3a-b7", "aa:bb:cc:dd:ee:ff"}),
    ("user_agents", "User-Agent: curl/7\nMozilla/5.0 (X) y", {"curl/7"}),
    ("yara", "rule a { x } rule b { meta: y } rule c : t { meta: z } rule d {", {"rule b { meta: y }"}),
    ("cert_serials", "serial: 0A1B2C3D4E5F6071 serial: 0A1B2C3D4E5F60718 01:02:03:04:05:06", {"0a:1b:2c:3d:4e:5f:60:71"}),
    ("hosts", "the.evil.com up.evil.com \\\\\\\\SRV-01\\\\ \\\\\\\\users\\\\", {"up.evil.com", "SRV-01"}),
    ("jwt", "eyJa.eyJb.c-_ eyJa.b.c", {"eyJa.eyJb.c-_"}),
    ("monero", "4" + "A" * 94, {"4" + "A" * 94}),
    ("ssdeep", "96:abc/+d:efg+ 9:abcd:abcd 12:ab:abc 96:abc:ef+", {"96:abc/+d:efg"}),
])
def test_types(spark, ioc_type, text, expected):
    assert values(spark, ioc_type, text) == expected


def test_defanging(spark):
    text = "https://a.evil.net/x.php u.v@w.org 1.2.3.4"
    assert values(spark, "urls", text, True) == {"hxxps://a[.]evil[.]net/x[.]php"}
    assert values(spark, "emails", text, True) == {"u[.]v[@]w[.]org"}
    assert values(spark, "ips", text, True) == {"1[.]2[.]3[.]4"}


def test_long_bodies_do_not_exhaust_the_stack(spark):
    body = "rule big { meta: " + "x {y} " * 20000
    assert values(spark, "yara", body + "}") == set() and values(spark, "yara", body) == set()


def test_addresses(spark):
    cases = {"1.2.3.4": "401020304", "256.0.0.1": None, "01.2.3.4": None, "::": "6" + "0" * 32, "::1": "6" + "0" * 31 + "1", "2001:DB8::5": "620010db8" + "0" * 23 + "5", "1:2:3:4:5:6:7:8": "600010002000300040005000600070008", "1:2:3:4:5:6:7": None, "1::2::3": None, ":::": None, "::ffff:1.2.3.4": "6" + "0" * 20 + "ffff01020304", "x": None, "12345::": None, "1:2:3:4:5:6:7:8::": None}
    rows = spark.createDataFrame([(k,) for k in cases], "a string").select("a", T.address_hex(F.col("a")).alias("h")).collect()
    assert {r.a: r.h for r in rows} == cases


def test_registered_types(spark):
    extractors.register("ticket", Pattern(r"\bINC-([0-9]+)\b", (1,), "INC-"), lambda v: F.length(v) > 2)
    try:
        assert values(spark, "ticket", "INC-12 INC-1234 INC-1234") == {"1234"}
    finally:
        del extractors.EXTRACTORS["ticket"]
    with pytest.raises(ValueError, match="unknown"):
        extract_all(spark.createDataFrame([(1, "x")], "id int, text string"), types=["nope"])
