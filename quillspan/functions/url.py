"""URLs as column expressions; templates such as ``/users/{id}`` are as good as any other path."""

from __future__ import annotations

import functools
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.rows import let

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
#: Addresses that are admissible beyond doubt, which most are: one pattern instead of a look at each part.
_PLAIN = r"\Ahttps?://[A-Za-z0-9.\-]+(?::[0-9]*)?(?:[/?][A-Za-z0-9/_.{}~=&?,;:\-]*)?\z"
_HOST = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:\[\]]*)(?::([0-9]*))?\z"


def _part(url: Column, group: int) -> Column:
    """One of the five parts. All come from one array, which Spark computes once for all accessors of a projection."""
    return F.element_at(F.split(F.regexp_replace(url, _URL, "$1\u0001$2\u0001$3\u0001$4\u0001$5"), "\u0001", -1), group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    return _part(url, 2)


def raw_path(url: Column) -> Column:
    return _part(url, 3)


def raw_query(url: Column) -> Column:
    return _part(url, 4)


def unescape(text: Column) -> Column:
    """Percent-decoding alone: a plus sign stays one. Null if an escape is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def path(url: Column) -> Column:
    """The decoded path; null for a malformed URL."""
    return F.when(is_valid(url), unescape(raw_path(url)))


def is_valid(url: Column) -> Column:
    fine = unescape(raw_path(url)).isNotNull() & ~url.rlike(r"[\x00-\x1f\x7f]") & ((authority(url) == "") | authority(url).rlike(_HOST))
    return url.isNotNull() & fine


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(authority(url), _HOST, 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), _HOST, 2)


def is_absolute_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")


def is_admissible(url: Column) -> Column:
    """http(s), with a host and without user information."""
    return F.when(url.rlike(_PLAIN), True).otherwise(is_valid(url) & scheme(url).isin("http", "https") & (host(url) != "") & ~authority(url).contains("@"))


def root(url: Column) -> Column:
    """scheme://authority, the scheme in lower case."""
    return F.when(url.rlike(r"\Ahttps?://"), F.regexp_extract(url, r"\Ahttps?://[^/?#]*", 0)).otherwise(F.concat(scheme(url), F.lit("://"), authority(url)))


def origin(url: Column) -> Column:
    """scheme://host and the port if one is written; empty if there is no single host."""
    p = port(url)
    whole = F.concat(scheme(url), F.lit("://"), host(url), F.when(p == "", "").otherwise(F.concat(F.lit(":"), p)))
    return F.when(is_valid(url) & (scheme(url) != "") & (host(url) != "") & ~host(url).contains("%"), whole).otherwise("")


def canonical_origin(url: Column) -> Column:
    """The origin of an http(s) URL without its default port."""
    o = origin(url)
    plain = F.when(scheme(url) == "https", F.regexp_replace(o, r":443\z", "")).otherwise(F.regexp_replace(o, r":80\z", ""))
    return F.when(scheme(url).isin("http", "https"), plain).otherwise("")


def same_origin(a: Column, b: Column) -> Column:
    return (origin(a) != "") & (origin(a) == origin(b))


def normalized(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no default port."""
    q = raw_query(url)
    tail = F.concat(F.when(raw_path(url) == "", "").otherwise(raw_path(url)), F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.concat(canonical_origin(url), tail)


def query_pairs(url: Column) -> Column:
    """The query as an array of (name, value), decoded, malformed pairs left out."""
    part = F.filter(F.split(raw_query(url), "&"), lambda p: (p != "") & ~p.contains(";"))
    pair = lambda p: F.struct(F.try_url_decode(F.substring_index(p, "=", 1)).alias("name"), F.when(p.contains("="), F.try_url_decode(F.regexp_replace(p, r"(?s)^[^=]*=", ""))).otherwise("").alias("value"))
    return F.filter(F.transform(part, pair), lambda p: p["name"].isNotNull() & p["value"].isNotNull())


def query_params(url: Column, max_values: int = 256, max_keys: int = 512) -> Column:
    """map(name, values in order) of an absolute URL: the first values of each name, the first names in order."""

    def grouped(pairs: Column) -> Column:
        names = F.slice(F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"]))), 1, max_keys)
        values = lambda n: F.slice(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["value"]), 1, max_values)
        return F.map_from_entries(F.transform(names, lambda n: F.struct(n, values(n))))

    none = F.create_map().cast("map<string,array<string>>")
    return F.when(scheme(url) != "", F.when(raw_query(url) == "", none).otherwise(let(query_pairs(url), grouped)))


# Networks that are nobody's in public, as first and last address of four bytes, and what stands for an address with credentials.
PRIVATE_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::1/128", "fe80::/10", "fc00::/7", "2002::/16", "64:ff9b::/96",
)
REDACTED = "[redacted]"


def is_private_ip(address: Column) -> Column:
    """Is a literal address unspecified, empty or of a private network? Null for what is no address."""
    octet = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    value = F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda total, o: total * 256 + o.cast("long"))
    v4 = [n for n in map(ipaddress.ip_network, PRIVATE_NETWORKS) if n.version == 4]
    inside = functools.reduce(lambda a, b: a | b, [value.between(int(n.network_address), int(n.broadcast_address)) for n in v4])

    @F.pandas_udf("boolean")
    def of_six(addresses: pd.Series) -> pd.Series:
        return addresses.map(_is_private_six)

    return F.when(F.coalesce(address, F.lit("")) == "", True).when(address.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z"), inside).when(address.contains(":"), of_six(address))


def _is_private_six(address: str | None) -> bool | None:
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return int(ip) == 0 or any(ip in n for n in map(ipaddress.ip_network, PRIVATE_NETWORKS) if n.version == ip.version)


def redact(url: Column) -> Column:
    """A URL without user information; a placeholder if an ``@`` is left anywhere."""
    bare = F.when(is_valid(url), F.regexp_replace(url, r"\A([A-Za-z][A-Za-z0-9+.\-]*://)[^/?#]*@", "$1")).otherwise(url)
    return F.when(bare.contains("@"), REDACTED).otherwise(bare)
