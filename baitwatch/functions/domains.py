"""Host name -> subdomain, registrable domain and public suffix.

No public-suffix download is possible here, so suffixes follow a rule: every
last label is a suffix, and under the country codes below the listed second
labels belong to it. A full list can be passed as ``suffixes`` instead; then
only listed suffixes count, tested by hash-set lookups. Either way no join and
no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Second-level registrations under country codes.
SECOND_LEVEL = {
    "in": "ac co edu firm gen gov ind mil net nic org res",
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "au": "asn com edu gov id net org",
    "nz": "ac co geek gen govt iwi mil net org school",
    "za": "ac co edu gov law mil net nom org web",
    "jp": "ac ad co ed go gr lg ne or",
    "kr": "ac co go ne or pe re",
    "br": "art com edu gov mil net org",
    "cn": "ac com edu gov mil net org",
    "hk": "com edu gov idv net org",
    "sg": "com edu gov net org per",
    "my": "com edu gov mil net org",
    "tw": "com edu gov idv mil net org",
    "th": "ac co go in mi net or",
    "id": "ac co go mil net or sch web",
    "il": "ac co gov k12 muni net org",
    "tr": "bel com edu gov mil net org",
    "mx": "com edu gob net org",
    "ar": "com edu gob gov int mil net org",
    "lk": "ac com edu gov net org",
}


def rule_suffixes() -> list[str]:
    return [f"{second}.{cc}" for cc, seconds in SECOND_LEVEL.items() for second in seconds.split()]


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

Getter = Callable[[str], Column]


def host_of(url: Column) -> Column:
    """Host of a URL or bare domain: no scheme, user info, port or trailing dots."""
    host = F.regexp_extract(
        url, r"^(?:(?:[A-Za-z0-9+.\-]+:)?//)?(?:[^/?#]*@)?([^/?#:]*)", 1
    )
    return F.lower(F.rtrim(F.trim(host), F.lit(".")))


# Suffix by rule, as the tail after a dot: listed second level, else a last
# label that is no number. The leftmost match is the longest suffix. Possessive
# and anchored so that a hostile host of any length takes linear time.
_SECONDS = "|".join(rf"(?:{names.replace(' ', '|')})\.{cc}" for cc, names in SECOND_LEVEL.items())
_SUFFIX = rf"(?:{_SECONDS}|(?![0-9]*+\z)[^.]++)"


def public_suffix(host: Column, suffixes: Iterable[str] | None = None) -> Column:
    """Longest public suffix of a lowered host, '' if none; not for addresses."""
    if suffixes is None:
        lone_country = F.when(host.rlike("^[a-z]{2}$"), host)
        return F.coalesce(lone_country, F.regexp_extract(host, rf"\.({_SUFFIX})\z", 1))
    listed: dict[int, list[str]] = {}
    for s in suffixes:
        listed.setdefault(s.count(".") + 1, []).append(s)
    out = F.when(F.lit(False), F.lit(""))
    for n, names in sorted(listed.items(), reverse=True):
        out = out.when(F.substring_index(host, ".", -n).isin(*names), F.substring_index(host, ".", -n))
    return out.otherwise(F.lit(""))


def suffix_stages(suffixes: Iterable[str] | None = None,
                  prefix: str = "") -> list[Callable[[Getter], dict[str, Column]]]:
    """Stages that turn ``host`` into ``subdomain``, ``domain``, ``suffix`` and
    ``full_domain`` (all names prefixed). Each stage reads only columns of
    earlier ones, so as projections they stay linear in size."""
    p = prefix

    def suffix(get: Getter) -> dict[str, Column]:
        host = get(f"{p}host")
        is_ip = host.rlike(IPV4)
        return {f"{p}is_ip_address": is_ip,
                f"{p}suffix": F.when(is_ip, F.lit("")).otherwise(public_suffix(host, suffixes))}

    def rest(get: Getter) -> dict[str, Column]:
        host, sfx = get(f"{p}host"), get(f"{p}suffix")
        return {f"{p}rest": F.when(sfx == "", host).otherwise(
            F.left(host, F.greatest(F.length(host) - F.length(sfx) - 1, F.lit(0))))}

    def domain(get: Getter) -> dict[str, Column]:
        r = get(f"{p}rest")
        return {f"{p}domain": F.when(get(f"{p}is_ip_address"), r).otherwise(F.substring_index(r, ".", -1))}

    def subdomain(get: Getter) -> dict[str, Column]:
        r, d = get(f"{p}rest"), get(f"{p}domain")
        return {
            f"{p}subdomain": F.left(r, F.greatest(F.length(r) - F.length(d) - 1, F.lit(0))),
            f"{p}full_domain": F.concat(d, F.lit("."), get(f"{p}suffix")),
        }

    return [suffix, rest, domain, subdomain]


def registrable(host: Column) -> Column:
    """``domain.suffix`` of one host by the default rule, in a single regular
    expression: for callers that need nothing but the registrable domain."""
    found = F.regexp_extract(host, rf"(?:^|(?<=\.))([^.]*+\.{_SUFFIX})\z", 1)
    return (
        F.when(found != "", found)
        .when(host.rlike(IPV4), F.concat(host, F.lit(".")))
        .when(host.rlike("^[a-z]{2}$"), F.concat(F.lit("."), host))
        .otherwise(F.concat(F.substring_index(host, ".", -1), F.lit(".")))
    )
