"""IP address functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"

# Special-purpose IPv4 blocks of the public IANA registry that are not public addresses, as text
# prefixes of a valid dotted quad (0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24 but two anycast addresses,
# 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 224/4, 240/4). One pattern keeps the test cheap.
NON_PUBLIC_V4 = (
    r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|^192\.0\.0\.(?!(?:9|10)$)|^192\.0\.2\.|^192\.168\."
    r"|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\."
)


def is_ipv4(column: Column) -> Column:
    return F.coalesce(column.rlike(IPV4_PATTERN), F.lit(False))


def ipv4_to_long(column: Column) -> Column:
    """Unsigned 32-bit value of a dotted quad; null when the text is not one."""
    part = F.split(column, r"\.")
    number = sum((F.try_element_at(part, F.lit(i + 1)).try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)),
                 F.try_element_at(part, F.lit(1)).try_cast("bigint") * 256 ** 3)
    return F.when(is_ipv4(column), number)


def ipv6_to_hex(column: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in any notation without a dotted part; null when the text is none."""
    text = F.lower(column)
    halves = F.split(text, "::")
    none = F.array().cast("array<string>")
    groups = lambda half: F.when(F.coalesce(half, F.lit("")) == "", none).otherwise(F.split(half, ":"))
    head, tail = groups(halves[0]), groups(F.try_element_at(halves, F.lit(2)))
    gap = F.when(F.contains(text, F.lit("::")), F.greatest(F.lit(0), 8 - F.size(head) - F.size(tail))).otherwise(0)
    full = F.concat(head, F.array_repeat(F.lit("0"), gap), tail)
    valid = text.rlike(r"^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(halves) <= 2) & (F.size(full) == 8) & F.forall(full, lambda g: F.length(g).between(1, 4))
    return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def _public_v6(column: Column) -> Column:
    """Global unicast 2000::/3 minus the special-purpose blocks inside it."""
    text = F.lower(column)
    groups = F.split(text, ":")

    def group(i: int) -> Column:
        return F.conv(F.coalesce(F.nullif(F.try_element_at(groups, F.lit(i)), F.lit("")), F.lit("0")), 16, 10).cast("long")

    first, second = group(1), group(2)
    special = (
        ((first == 0x2001) & (second < 0x200) & ~(second.between(0x20, 0x3F) | (second == 3)))
        | ((first == 0x2001) & (second == 0xDB8)) | (first == 0x2002)
        | ((first == 0x3FFF) & (second < 0x1000))
    )
    return text.rlike(r"^[0-9a-f]{1,4}(:[0-9a-f]{0,4}){2,7}$") & first.between(0x2000, 0x3FFF) & ~special


def is_private_ip(column: Column) -> Column:
    """Private, loopback, link-local, multicast or reserved. Missing or unparsable text counts as private."""
    return (
        F.when(column.isNull() | (column == ""), True)
        .when(column.rlike(IPV4_PATTERN), column.rlike(NON_PUBLIC_V4))
        .otherwise(~F.coalesce(_public_v6(column), F.lit(False)))
    )
