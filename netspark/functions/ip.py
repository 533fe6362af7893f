"""Address predicates and conversions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Eight groups; or one ``::`` with at most seven groups around it.
IPV6_PATTERN = (
    rf"^(?:(?:{_GROUP}:){{7}}{_GROUP}"
    rf"|(?!.*::.*::)(?!.*:::)(?=(?:[^:]*:){{2,7}}[^:]*$|::(?:[^:]+:){{6}}[^:]+$|(?:[^:]+:){{7}}:$)(?:{_GROUP}(?::{_GROUP})*)?::(?:{_GROUP}(?::{_GROUP})*)?)$"
)
#: An IPv4 end, which stands for two groups.
IPV4_TAIL = rf"(?<=:){_OCTET}(\.{_OCTET}){{3}}$"
#: Unspecified, loopback, link-local, unique local and documentation addresses.
PRIVATE_IPV6 = r"(?i)^(::1?$|fe[89ab][0-9a-f]:|f[cd][0-9a-f]{2}:|2001:db8:)"

# ---- fixed values: IPv4 blocks with a special meaning (first address, last address)
PRIVATE_BLOCKS = [
    ("0.0.0.0", "0.255.255.255"),
    ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
]
MULTICAST_BLOCK = ("224.0.0.0", "239.255.255.255")
LOOPBACK_BLOCK = ("127.0.0.0", "127.255.255.255")
BROADCAST = "255.255.255.255"
# ---------------------------------------------------------------------------------


def to_number(text: str) -> int:
    a, b, c, d = (int(part) for part in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """IPv6 text: eight groups, or fewer with one ``::``; the last two may be written as IPv4."""
    return F.coalesce(F.regexp_replace(ip, IPV4_TAIL, "0:0").rlike(IPV6_PATTERN), F.lit(False))


def is_address(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ip_number(ip: Column) -> Column:
    """IPv4 text as a long, null when it is not a valid address."""
    parts = F.split(ip, r"\.")

    def octet(i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("bigint")

    value = ((octet(0) * 256 + octet(1)) * 256 + octet(2)) * 256 + octet(3)
    return F.when(is_ipv4(ip), value)


def _within(number: Column, blocks: list[tuple[str, str]]) -> Column:
    """Is the number in one of the blocks? It is bound once, in an array of one, instead of standing in every comparison."""

    def test(n: Column) -> Column:
        found = F.lit(False)
        for first, last in blocks:
            found = found | n.between(to_number(first), to_number(last))
        return found

    return F.coalesce(F.get(F.transform(F.array(number), test), F.lit(0)), F.lit(False))


def is_multicast_or_broadcast(ip: Column) -> Column:
    return _within(ip_number(ip), [MULTICAST_BLOCK, (BROADCAST, BROADCAST)])


def is_private(ip: Column) -> Column:
    return _within(ip_number(ip), PRIVATE_BLOCKS) | F.coalesce(ip.rlike(PRIVATE_IPV6), F.lit(False))


def is_loopback(ip: Column) -> Column:
    return _within(ip_number(ip), [LOOPBACK_BLOCK]) | F.coalesce(ip == "::1", F.lit(False))


def is_local_or_reserved(ip: Column) -> Column:
    """Private, loopback, link-local, reserved or multicast: never looked up by location."""
    return _within(ip_number(ip), [*PRIVATE_BLOCKS, MULTICAST_BLOCK])
