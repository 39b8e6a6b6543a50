"""Column functions for single values: defanging, refanging, validation, URLs, addresses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists

DOT, BRACKETED = ".", "[.]"


def quoted(words: list[str]) -> str:
    """Literal alternation of words: one expression, where a list of literals would be one for each."""
    return "|".join(r"\Q" + w.replace(r"\E", r"\E\\E\Q") + r"\E" for w in words)


def any_of(c: Column, needles: list[str]) -> Column:
    """True where the value contains one of the needles."""
    return c.rlike(quoted(needles)) if needles else F.lit(False)


def one_of(c: Column, words: list[str]) -> Column:
    """True where the value is one of the words."""
    return c.rlike(rf"\A(?:{quoted(words)})\z")


def replaced(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda v, p: F.replace(v, F.lit(p[0]), F.lit(p[1])), pairs, c)


def defang_dotted(c: Column) -> Column:
    return F.replace(c, F.lit(DOT), F.lit(BRACKETED))


def defang_url(c: Column) -> Column:
    """Schemes to hxxp, then every dot of the URL bracketed."""
    return defang_dotted(replaced(c, [("http://", "hxxp://"), ("https://", "hxxps://")]))


def defang_email(c: Column) -> Column:
    return defang_dotted(F.replace(c, F.lit("@"), F.lit("[@]")))


def plain_dots(c: Column) -> Column:
    """Bracketed dots of the three common kinds made plain."""
    return replaced(c, [("[.]", "."), ("(.)", "."), ("{.}", ".")])


def refang(c: Column) -> Column:
    """The full chain of refanging replacements, in its fixed order."""
    return replaced(c, lists.REFANG)


def url_host(c: Column) -> Column:
    """Network location of a URL, port included; empty without one."""
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_port(host: Column) -> Column:
    return F.substring_index(host, ":", 1)


def is_valid_hash(c: Column) -> Column:
    """Not trivial, not a counting run and, from 64 digits on, not an encoded file or text."""
    low = F.lower(c)
    varied = F.size(F.array_distinct(F.split(low, ""))) >= 4
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1, F.lit(2)), lambda i: F.conv(F.substr(low, i, F.lit(2)), 16, 10).cast("int"))
    shown = F.size(F.filter(pairs, lambda b: b.between(32, 126) | b.isin(9, 10, 13)))
    ascii_text = F.forall(pairs, lambda b: b < 128) & (shown * 2 > F.size(pairs))
    signature = reduce(lambda a, b: a | b, [low.startswith(s) for s in lists.HASH_SIGNATURES])
    decodes = (F.length(c) >= 64) & (F.length(c) % 2 == 0)
    return varied & ~any_of(low, lists.HASH_RUNS) & ~F.when(decodes, signature | ascii_text).otherwise(F.lit(False))


def is_valid_domain(c: Column) -> Column:
    """A plausible domain that is not well known, or a suspicious subdomain of a well-known one."""
    low = F.lower(c)
    labels = F.split(low, r"\.")
    tld = F.substring_index(low, ".", -1)
    real = one_of(tld, lists.TLDS) & ~one_of(tld, lists.FILE_EXTENSIONS)
    code = F.exists(labels, lambda x: one_of(x, lists.CODE_WORDS))
    known = one_of(low, lists.LEGITIMATE_DOMAINS + lists.LEGITIMATE_HOSTS)
    endings = "|".join(d.replace(".", r"\.") for d in sorted(lists.LEGITIMATE_DOMAINS, key=len, reverse=True))
    prefix = F.regexp_extract(low, rf"^(.*?)\.(?:{endings})$", 1)
    sized = (F.length(c) <= 253) & F.forall(labels, lambda x: F.length(x) <= 63)
    verdict = F.when(prefix != "", any_of(prefix, lists.SUSPICIOUS_LABELS)).otherwise(sized)
    return F.contains(c, F.lit(".")) & real & ~code & ~known & verdict


def is_valid_ipv4(c: Column) -> Column:
    """Four octets of 0 to 255 without leading zeros."""
    return c.rlike(r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.(?!$)|$)){4}$")


def is_kept_url(url: Column) -> Column:
    """The URL policy: file sharing, suspicious paths on code hosts, documentation, then anything with a host."""
    parsed = F.replace(plain_dots(url), F.lit("hxxp"), F.lit("http"))
    host, path = F.lower(url_host(parsed)), F.lower(url_path(parsed))
    code_host = any_of(host, lists.CODE_HOSTS)
    manual = any_of(host, lists.DOCUMENTATION) & ~any_of(path, lists.DOCUMENTATION_EXCEPTIONS)
    asset = reduce(lambda a, b: a | b, [host.endswith(e) for e in lists.ASSET_ENDINGS])
    return (
        F.when(any_of(host, lists.FILE_SHARING), True)
        .when(code_host, any_of(path, lists.SUSPICIOUS_PATHS))
        .when(manual, False)
        .otherwise((host != "") & ~asset)
    )


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(c), body), 0)


def ipv4_number(c: Column) -> Column:
    """The address as a number; null for anything else."""
    octets = lambda p: F.aggregate(p, F.lit(0).cast("bigint"), lambda n, x: n * 256 + x.cast("bigint"))
    return let(c, lambda v: F.when(is_valid_ipv4(v), octets(F.split(v, r"\."))))


def ipv6_hex(c: Column) -> Column:
    """The address as 32 lower-case hex digits; null for anything else.  An IPv4 tail is understood."""
    word = lambda n: F.lpad(F.lower(F.hex(n)), 4, "0")
    words = lambda tail: let(ipv4_number(tail), lambda n: F.concat(word(F.shiftright(n, 16)), F.lit(":"), word(n.bitwiseAND(F.lit(65535)))))
    parts = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))

    def flat(low: Column) -> Column:
        split_tail = lambda tail: F.when(tail == "", low).otherwise(F.concat(F.substr(low, F.lit(1), F.length(low) - F.length(tail)), words(tail)))
        return let(F.regexp_extract(low, r"^(.*:)([0-9]{1,3}(?:\.[0-9]{1,3}){3})$", 2), split_tail)

    def groups(f: Column) -> Column:
        filled = lambda p: F.when(F.size(p.a) + F.size(p.b) < 8, F.concat(p.a, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(p.a) - F.size(p.b), F.lit(0))), p.b))
        short = let(F.struct(parts(F.substring_index(f, "::", 1)).alias("a"), parts(F.substring_index(f, "::", -1)).alias("b")), filled)
        return F.when(f.rlike("::.*::|:::"), F.lit(None)).when(F.contains(f, F.lit("::")), short).otherwise(F.split(f, ":"))

    good = lambda g: F.when((F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""))
    return let(let(let(F.lower(c), flat), groups), good)


def address_hex(c: Column) -> Column:
    """'4' or '6' and the address in hex digits, comparable within a family; null if it is none."""
    four = lambda n: F.concat(F.lit("4"), F.lpad(F.lower(F.hex(n)), 8, "0"))
    return F.when(F.contains(c, F.lit(":")), F.concat(F.lit("6"), ipv6_hex(c))).otherwise(let(ipv4_number(c), four))
