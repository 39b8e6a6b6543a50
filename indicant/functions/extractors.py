"""Extractors: text column to an array of distinct values, one function a type.

All are plain column expressions.  A gate, something that every match of the type contains,
is looked for first, so that most texts never meet the costly pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import lists
from . import text as T
from .patterns import PATTERNS, Pattern, portable

NONE = "array<string>"


def java_version() -> int:
    """Java's feature release in the running session."""
    return int(SparkSession.active()._jvm.java.lang.System.getProperty("java.specification.version").rpartition(".")[2])


def found(c: Column, pattern: str | Pattern) -> Column:
    """Distinct non-empty values of a pattern: of each match, the first group that took part."""
    p = PATTERNS[pattern] if isinstance(pattern, str) else pattern
    every = [F.regexp_extract_all(c, F.lit(portable(p.regex, java_version())), F.lit(g)) for g in p.groups]
    one = every[0] if len(every) == 1 else F.zip_with(*every, lambda a, b: F.when(a != "", a).otherwise(b))
    kept = F.array_distinct(F.filter(one, lambda v: v != ""))
    return F.when(c.rlike(p.gate), kept).otherwise(F.array().cast(NONE)) if p.gate else kept


def hashes(kind: str) -> Callable[..., Column]:
    return lambda c, defang=True: F.filter(found(c, kind), T.is_valid_hash)


def plain(kind: str) -> Callable[..., Column]:
    return lambda c, defang=True: found(c, kind)


def mapped(values: Column, change: Callable[[Column], Column], on: bool = True) -> Column:
    return F.array_distinct(F.transform(values, change)) if on else values


def domains_of(c: Column, found_urls: Column, defang: bool = True) -> Column:
    """Domains of the text and of its URLs, as found, that are valid."""
    from_urls = F.transform(found_urls, lambda u: T.without_port(T.url_host(F.replace(F.replace(u, F.lit("[.]"), F.lit(".")), F.lit("hxxp"), F.lit("http")))))
    every = F.array_union(F.transform(found(c, "domains"), T.plain_dots), F.transform(from_urls, T.plain_dots))
    return mapped(F.filter(every, T.is_valid_domain), T.defang_dotted, defang)


def domains(c: Column, defang: bool = True) -> Column:
    return domains_of(c, found(c, "urls"), defang)


def hosts_of(c: Column, found_domains: Column) -> Column:
    """Hosts among domains as extract gives them, and UNC machine names."""
    parts = lambda d: F.forall(F.split(d, r"\."), lambda p: p != "")
    named = F.filter(found_domains, lambda d: ~T.any_of(F.lower(d), lists.HOST_STOPS) & parts(d))
    machines = F.filter(found(c, "unc_hosts"), lambda m: (F.length(m) > 3) & ~T.one_of(F.lower(m), lists.UNC_STOPS))
    return F.array_union(named, machines)


def hosts(c: Column, defang: bool = True) -> Column:
    return hosts_of(c, domains(c, defang))


def ips(c: Column, defang: bool = True) -> Column:
    clean = F.transform(found(c, "ips"), lambda v: F.regexp_replace(v, r"[\[\(\{]\.[\]\)\}]", "."))
    return mapped(F.array_distinct(F.filter(clean, T.is_valid_ipv4)), T.defang_dotted, defang)


def urls_of(found_urls: Column, defang: bool = True) -> Column:
    return mapped(F.filter(found_urls, T.is_kept_url), T.defang_url, defang)


def urls(c: Column, defang: bool = True) -> Column:
    return urls_of(found(c, "urls"), defang)


def emails(c: Column, defang: bool = True) -> Column:
    return mapped(found(c, "emails"), T.defang_email, defang)


def mac_addresses(c: Column, defang: bool = True) -> Column:
    """Dotted addresses in colon form, others as they are."""
    colons = lambda v: F.when(F.contains(v, F.lit(".")), F.regexp_replace(F.replace(v, F.lit("."), F.lit("")), "(..)(?=.)", "$1:")).otherwise(v)
    return mapped(found(c, "mac_addresses"), colons)


def cert_serials(c: Column, defang: bool = True) -> Column:
    """Serial numbers of 8 to 32 bytes in lower-case colon form."""
    colons = lambda v: F.lower(F.when(F.contains(v, F.lit(":")), v).otherwise(F.regexp_replace(v, "(..)(?=.)", "$1:")))
    return F.filter(mapped(found(c, "cert_serials"), colons), lambda v: v.rlike("^[0-9a-f]{2}(?::[0-9a-f]{2}){7,31}$"))


def bitcoin(c: Column, defang: bool = True) -> Column:
    return F.filter(found(c, "bitcoin"), lambda v: (F.length(v) >= 26) & ~v.rlike("^[0-9a-fA-F]+$"))


def filenames(c: Column, defang: bool = True) -> Column:
    return F.filter(found(c, "filenames"), lambda v: (F.length(v) > 4) & ~T.one_of(F.lower(v), lists.SYSTEM_FILES))


def filepaths(c: Column, defang: bool = True) -> Column:
    stripped = F.filter(F.transform(found(c, "filepaths"), F.trim), lambda v: F.length(v).between(10, 299) & ~T.any_of(F.lower(v), lists.PATH_PHRASES))
    bare = mapped(stripped, lambda v: F.trim(F.rtrim(v, F.lit("\",;'"))))
    return F.filter(bare, lambda v: F.contains(v, F.lit(":\\")) | v.startswith("%") | (v.startswith("/") & (F.length(v) > 5)))


def yara(c: Column, defang: bool = True) -> Column:
    return F.filter(found(c, "yara"), lambda v: (F.length(v) < 3000) & F.contains(v, F.lit("rule ")) & T.any_of(v, ["strings:", "condition:", "meta:"]))


#: Every extractor in the order of a full extraction.
EXTRACTORS: dict[str, Callable[..., Column]] = {
    "md5": hashes("md5"), "sha1": hashes("sha1"), "sha256": hashes("sha256"), "sha512": hashes("sha512"), "ssdeep": plain("ssdeep"),
    "domains": domains, "ips": ips, "ipv6": plain("ipv6"), "urls": urls, "emails": emails,
    "bitcoin": bitcoin, "ethereum": plain("ethereum"), "monero": plain("monero"),
    "cves": plain("cves"), "mitre_attack": plain("mitre_attack"), "registry": plain("registry"), "mutex": plain("mutex"),
    "service_names": plain("service_names"), "named_pipes": plain("named_pipes"), "filenames": filenames, "filepaths": filepaths,
    "mac_addresses": mac_addresses, "user_agents": plain("user_agents"), "yara": yara, "asn": plain("asn"), "jwt": plain("jwt"),
    "cert_serials": cert_serials, "hosts": hosts,
}


#: Section titles and STIX patterns of registered types.
TITLES: dict[str, str] = {}
STIX_PATTERNS: dict[str, str] = {}


def extractor(pattern: Pattern, validator: Callable[[Column], Column] | None = None) -> Callable[..., Column]:
    """An extractor of one's own: a pattern and, if wanted, a Column -> Column check."""
    return lambda c, defang=True: F.filter(found(c, pattern), validator) if validator else found(c, pattern)


def register(ioc_type: str, pattern: Pattern, validator: Callable[[Column], Column] | None = None, title: str | None = None, stix: str | None = None) -> None:
    """Add an indicator type for every later extraction, classification and report.

    title heads its section of text reports (else made of its name), stix is its pattern with
    {value} (else it is no part of bundles).  A registry of one's own, for one extraction only,
    is the ``registry`` argument of extract_all.
    """
    EXTRACTORS[ioc_type] = extractor(pattern, validator)
    TITLES[ioc_type] = title or ioc_type.replace("_", " ").title()
    if stix:
        STIX_PATTERNS[ioc_type] = stix


def unregister(ioc_type: str) -> None:
    """Take a registered type away again; others stay."""
    if ioc_type in TITLES:
        for known in (EXTRACTORS, TITLES, STIX_PATTERNS):
            known.pop(ioc_type, None)
