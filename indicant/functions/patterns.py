r"""Search patterns of the indicator types.

Each pattern runs on java.util.regex: (?U) where \w, \d or \s have to know Unicode, (?d)
where $ must match before a final line feed only, possessive loops where backtracking could
exhaust the stack without changing what matches.  \b has to know Unicode everywhere: up to Java
18 it does by itself, from 19 on only under (?U), which ``portable`` adds there.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    regex: str
    groups: tuple[int, ...] = (0,)  # the first of these that took part is the value
    gate: str = ""  # what every match contains, as a cheap regular expression


def portable(regex: str, java: int) -> str:
    """The pattern for a Java version."""
    return f"(?U){regex}" if java >= 19 and r"\b" in regex else regex


#: One gate for all hashes: planned once and shared.  Gates start with something rare, so that a scan passes over most places at once.
HEX_RUN = "[a-fA-F0-9]{32}"

# The expressions that decide what counts as an indicator.
PATTERNS = {
    "md5": Pattern(r"(?U)(?:MD5|md5)\s*:?\s*([a-fA-F0-9]{32})|\b([a-fA-F0-9]{32})\b", (1, 2), HEX_RUN),
    "sha1": Pattern(r"(?U)(?:SHA-1|SHA1|sha1)\s*:?\s*([a-fA-F0-9]{40})|\b([a-fA-F0-9]{40})\b", (1, 2), HEX_RUN),
    "sha256": Pattern(r"(?U)(?:SHA-256|SHA256|sha256)\s*:?\s*([a-fA-F0-9]{64})|\b([a-fA-F0-9]{64})\b", (1, 2), HEX_RUN),
    "sha512": Pattern(r"(?Ud)(?:SHA-512|SHA512|sha512)\s*:?\s*([a-fA-F0-9]{128})|(?:^|\s)([a-fA-F0-9]{128})(?:\s|$)", (1, 2), HEX_RUN),
    "ssdeep": Pattern(r"(?U)\b\d{2,}:[A-Za-z0-9/+]{3,}:[A-Za-z0-9/+]{3,}\b", gate=r":[A-Za-z0-9/+]{3,}:"),
    "domains": Pattern(
        r"\b((?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,63})\b"
        r"|\b((?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(?:\[\.\]|\(\.\)|\{\.\}|\.)){1,}[a-zA-Z]{2,63})\b",
        gate=r"[.\])}][a-zA-Z]{2}",
    ),
    "ips": Pattern(r"(?U)\b\d{1,3}(?:[\[\(\{]?\.[\]\)\}]?\d{1,3}){3}\b", gate=r"\.[\])}]?[0-9]"),
    "ipv6": Pattern(
        r"(?Ud)(?:^|(?<=\s))(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?=\s|$)"
        r"|(?:^|(?<=\s))(?:[0-9a-fA-F]{1,4}:){1,7}:(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}(?=\s|$)"
        r"|(?:^|(?<=\s))(?:[0-9a-fA-F]{1,4}:){1,6}::[0-9a-fA-F]{1,4}(?=\s|$)"
        r"|(?:^|(?<=\s))(?:[0-9a-fA-F]{1,4}:)+::(?=\s|$)"
        r"|(?:^|(?<=\s))::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}(?=\s|$)"
        r"|(?:^|(?<=\s))::1(?=\s|$)|(?:^|(?<=\s))::(?=\s|$)"
        r"|(?:^|(?<=\s))::ffff:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?=\s|$)",
        gate=":[0-9a-fA-F:]",
    ),
    "urls": Pattern(
        r"\b(?:https?|hxxps?|h\[\.\]ttps?|s?ftp)://(?!DOMAIN_NAME|IP:|\*\.|localhost|example\.)"
        r"[a-zA-Z0-9][-a-zA-Z0-9.]*[a-zA-Z0-9](?:\.[a-zA-Z]{2,63})?(?::[0-9]{1,5})?(?:/[-a-zA-Z0-9()@:%_\+.~#?&/=]*)?",
        gate="://",
    ),
    "mac_addresses": Pattern(r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b|\b(?:[0-9a-fA-F]{4}\.){2}[0-9a-fA-F]{4}\b", gate="[:.-][0-9a-fA-F]{2}"),
    "bitcoin": Pattern(r"\b(bc1[a-zA-HJ-NP-Z0-9]{39,59}|[13][a-zA-HJ-NP-Z0-9]{25,34})\b", (1,), "(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25}"),
    "ethereum": Pattern(r"\b0x[a-fA-F0-9]{40}\b", gate="0x"),
    "monero": Pattern(r"\b4[0-9AB][a-zA-Z0-9]{93}\b", gate="4[0-9AB][a-zA-Z0-9]{93}"),
    "emails": Pattern(r"\b[a-zA-Z0-9][a-zA-Z0-9._-]*@[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,63}\b", gate="@"),
    "cves": Pattern(r"(?i)\b(CVE-[0-9]{4}-[0-9]{4,7})\b", (1,), "(?i)cve-"),
    "mitre_attack": Pattern(r"\b(T[0-9]{4}(?:\.[0-9]{3})?)\b", (1,), "T[0-9]{4}"),
    "registry": Pattern(
        r"(?Ud)\b((?:HKEY_LOCAL_MACHINE|HKLM|HKEY_CURRENT_USER|HKCU|HKEY_CLASSES_ROOT|HKCR|HKEY_USERS|HKU|HKEY_CURRENT_CONFIG|HKCC)"
        r"\\[\\A-Za-z0-9-_\s]+?)(?=\s|$)",
        (1,), "HK",
    ),
    "mutex": Pattern(r"\b(?:Global\\|Local\\)?[A-Za-z0-9][A-Za-z0-9_\-]{2,}(?:Mutex|MUTEX)\b|\bMutex:[A-Za-z0-9_\-]+\b", gate="M(?:utex|UTEX)"),
    "service_names": Pattern(r"(?U)\b(?:Service|SERVICE):\s*([A-Za-z0-9][A-Za-z0-9_\-]{2,})\b|\b([A-Za-z0-9][A-Za-z0-9_\-]{2,})(?:Service|Svc)\b", (1, 2), "S(?:ervice|ERVICE|vc)"),
    "named_pipes": Pattern(r"\\\\\.\\pipe\\[A-Za-z0-9_\-]+", gate=r"\\pipe\\"),
    "filenames": Pattern(
        r"(?i)\b([A-Za-z0-9][A-Za-z0-9-_\.]{2,}\.(?:exe|dll|bat|sys|htm|html|js|jar|jpg|png|vb|scr|pif|chm|zip|rar|cab|pdf|doc|docx|ppt|pptx"
        r"|xls|xlsx|swf|gif|ps1|vbs|wsf|hta|cmd|com|lnk|ini|inf|reg))\b",
        (1,), r"\.[A-Za-z][A-Za-z0-9]",
    ),
    "filepaths": Pattern(
        r"""(?iUd)(?:(?:%[A-Z_]+%\\|[A-Za-z]:\\)(?:[^\s<>:"/|?*\r\n\\]+\\)*[^\s<>:"/|?*\r\n\\]+(?:\.[A-Za-z0-9]{1,10})?(?=[\s"“”,;]|$)"""
        r"""|/(?:usr|bin|etc|var|tmp|home|opt|proc|sys|lib|dev)/(?:[A-Za-z0-9-_\.]+/)*[A-Za-z0-9-_\.]+(?=[\s"“”,;]|$))""",
        gate=r"(?i)[%:]\\|/(?:usr|bin|etc|var|tmp|home|opt|proc|sys|lib|dev)/",
    ),
    "user_agents": Pattern(r"(?U)User-Agent:\s*([^\r\n]+)|Mozilla/[0-9\.]+\s+\([^)]+\)[^\r\n]*", (1,), "User-Agent:"),
    "yara": Pattern(r"(?U)rule\s+\w+\s*\{(?:[^{}]++|\{[^}]*\})*+\}", gate="rule"),
    "asn": Pattern(r"\bAS[0-9]{1,10}\b", gate="AS[0-9]"),
    "jwt": Pattern(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", gate="eyJ"),
    "cert_serials": Pattern(
        r"(?U)\b([a-fA-F0-9]{2}(?::[a-fA-F0-9]{2}){7,31})\b|(?:serial|certificate|cert|thumbprint)[\s:]+([a-fA-F0-9]{16,64})\b",
        (1, 2), ":[a-fA-F0-9]{2}|serial|cert|thumbprint",
    ),
    "unc_hosts": Pattern(r"(?iU)\\\\\\\\([A-Z][A-Z0-9\-]{2,14})(?:\\\\|\s)", (1,), r"\\\\\\\\"),
}
