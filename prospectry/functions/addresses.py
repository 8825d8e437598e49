"""IP addresses as fixed-width hex strings, so that network blocks are string ranges."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import any_of, let, strip

# Address blocks that are not globally routable, and the exceptions inside them.
NON_GLOBAL_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
GLOBAL_EXCEPTIONS = (
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32",
    "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)


def _range(block: str) -> tuple[str, str]:
    net = ip_network(block)
    width = net.max_prefixlen // 4
    return tuple(f"{int(a):0{width}x}" for a in (net.network_address, net.broadcast_address))


def address_hex(ip: Column) -> Column:
    """8 hex digits for IPv4, 32 for IPv6, null for anything else."""
    return let(F.lower(F.substring_index(strip(ip), "%", 1)), _hex)


def _hex(ip: Column) -> Column:
    octets = F.split(ip, r"\.")
    v4 = F.when(
        ip.rlike(r"\A(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!\z)|\z)){4}"),
        F.concat(*[
            F.lpad(F.lower(F.hex(F.get(octets, F.lit(i)).try_cast("bigint"))), 2, "0")
            for i in range(4)
        ]),
    )
    groups = [
        F.filter(F.split(side, ":"), lambda g: g != "")
        for side in (F.substring_index(ip, "::", 1), F.get(F.split(ip, "::"), F.lit(1)))
    ]
    left, right = groups[0], F.coalesce(groups[1], F.array().cast("array<string>"))
    gap = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), right)
    shaped = ip.rlike(r"\A[0-9a-f:]+\z") & ip.contains(":") & ~ip.rlike(r":::|::.*::|[0-9a-f]{5}")
    whole = F.when(ip.contains("::"), gap >= 1).otherwise(
        (gap == 0) & ~ip.startswith(":") & ~ip.endswith(":")
    )
    v6 = F.when(
        shaped & whole,
        F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""),
    )
    return F.coalesce(v4, v6)


def is_global_address(ip: Column) -> Column:
    """True for globally routable addresses; false for all others, malformed ones included."""
    def judge(h: Column) -> Column:
        def within(blocks: tuple[str, ...]) -> Column:
            return any_of(
                (F.length(h) == len(lo)) & h.between(lo, hi) for lo, hi in map(_range, blocks))

        return ~within(NON_GLOBAL_BLOCKS) | within(GLOBAL_EXCEPTIONS)

    return F.coalesce(let(address_hex(ip), judge), F.lit(False))
