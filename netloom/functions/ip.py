"""IP addresses and prefixes as column expressions.

An address is a family (4 or 6) and a fixed-width lower-case hexadecimal string (8 or 32 digits), which orders, masks
and joins alike for both families; 128 bits fit no numeric type. Text that is no address gives null, never an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """Without Unicode white space at the ends, in lower case."""
    return F.lower(F.regexp_replace(text, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", ""))


def v4_value(text: Column) -> Column:
    """Dotted quad to BIGINT; leading zeros, suffixes and parts over 255 give null."""
    part = [F.substring_index(F.substring_index(text, ".", i), ".", -1).cast("bigint") for i in (1, 2, 3, 4)]
    return F.when(text.rlike(IPV4), part[0] * 16777216 + part[1] * 65536 + part[2] * 256 + part[3])


def _hex(value: Column, digits: int) -> Column:
    return F.lower(F.lpad(F.hex(value), digits, "0"))


def _groups(half: Column) -> Column:
    return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))


def v6_hex(text: Column) -> Column:
    """IPv6 text to 32 hexadecimal digits. "::" stands for one group at least; a dotted tail is two groups."""

    def plain(t: Column) -> Column:
        def spelled(quad: Column) -> Column:
            return F.concat(F.regexp_extract(t, r"^(.*):[^:]*$", 1), F.lit(":"), F.lower(F.hex(F.shiftright(quad, 16))), F.lit(":"), F.lower(F.hex(quad.bitwiseAND(F.lit(65535)))))

        return F.when(F.contains(t, F.lit(".")), let(v4_value(trimmed(F.regexp_extract(t, r":([^:]*)$", 1))), spelled)).otherwise(t)

    def filled(x: Column) -> Column:
        missing = F.lit(8) - F.size(x["left"]) - F.size(x["right"])
        fits = F.when(x["halves"] == 1, missing == 0).otherwise((x["halves"] == 2) & (missing >= 1))
        every = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), x["right"])
        return F.when(fits & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    halves = lambda h: F.struct(F.size(h).alias("halves"), _groups(F.get(h, F.lit(0))).alias("left"), _groups(F.get(h, F.lit(1))).alias("right"))
    return F.when(F.contains(text, F.lit(":")), let(F.split(let(text, plain), "::", -1), lambda h: let(halves(h), filled)))


def parse_ip(text: Column) -> Column:
    """STRUCT<family INT, addr STRING>, or null."""

    def either(t: Column) -> Column:
        return let(v6_hex(t), lambda x: F.when(x.isNotNull(), F.struct(F.lit(6).alias("family"), x.alias("addr"))))

    t = trimmed(text)  # IPv4 stays in generated code; only other text takes the longer way
    return F.when(t.rlike(IPV4), F.struct(F.lit(4).alias("family"), _hex(v4_value(t), 8).alias("addr"))).when(F.contains(t, F.lit(":")), let(t, either))


def v4_text(value: Column) -> Column:
    """BIGINT to dotted quad."""
    return F.when(value.isNotNull(), F.concat_ws(".", *[F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))


def _v6_text(addr: Column) -> Column:
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.substring(addr, i * 4 + 1, F.lit(4)), "^0{1,3}", ""))

    def shortened(joined: Column) -> Column:
        # the longest run of two and more zero groups, the leftmost of equals, from the longest down
        runs = F.array(*[F.regexp_extract(joined, rf"(?:^|:)(0(?::0){{{n - 1}}})(?:$|:)", 1) for n in range(8, 1, -1)])

        def cut(zero: Column) -> Column:
            at = F.instr(F.concat(F.lit(":"), joined, F.lit(":")), F.concat(F.lit(":"), zero, F.lit(":")))
            around = lambda n: F.concat(F.regexp_replace(F.substring(joined, F.lit(1), n - 1), ":$", ""), F.lit("::"), F.regexp_replace(F.substring(joined, n + F.length(zero), F.lit(64)), "^:", ""))
            return F.when(zero == "", joined).otherwise(let(at, around))

        return let(F.coalesce(F.get(F.filter(runs, lambda r: r != ""), F.lit(0)), F.lit("")), cut)

    return let(F.array_join(groups, ":"), shortened)


def format_ip(family: Column, addr: Column) -> Column:
    """Canonical text: no leading zeros, the leftmost longest run of zero groups shortened."""
    return F.when(family == 4, v4_text(F.conv(addr, 16, 10).cast("bigint"))).when(addr.isNotNull(), _v6_text(addr))


def mask(addr: Column, length: Column) -> Column:
    """addr with the bits after the first `length` cleared. IPv4 is masked as a number, by one table look-up."""
    v4 = _hex(F.conv(addr, 16, 10).cast("bigint").bitwiseAND(F.element_at(F.array(*[F.lit((1 << 32) - (1 << 32 - n)) for n in range(33)]), F.least(length, F.lit(32)) + 1)), 8)
    bits = length % 4
    whole = ((length - bits) / 4).cast("int")
    keep = F.element_at(F.array(F.lit(0), F.lit(8), F.lit(12), F.lit(14)), bits + 1)
    part = F.lower(F.hex(F.conv(F.substring(addr, whole + 1, F.lit(1)), 16, 10).cast("bigint").bitwiseAND(keep.cast("bigint"))))
    v6 = F.rpad(F.concat(F.substring(addr, F.lit(1), whole), F.when(bits > 0, part).otherwise(F.lit(""))), 32, "0")
    return F.when(F.length(addr) == 8, v4).otherwise(v6)


def prefix_text(family: Column, key: Column, length: Column) -> Column:
    return F.concat(format_ip(family, key), F.lit("/"), length.cast("string"))


def bytes_value(data: Column) -> Column:
    """Up to 7 big-endian bytes as BIGINT."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")
