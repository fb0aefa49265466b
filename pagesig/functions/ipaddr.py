"""IPv4 column functions as built-in expressions. Addresses are longs (0 .. 2^32-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesig.params import CIDR, DOTTED_QUAD, MAX_IP


def _quads_ok(ip: Column) -> Column:
    return F.forall(F.split(ip, r"\."), lambda q: q.try_cast("int") <= 255)


def valid_ip(ip: Column) -> Column:
    return F.coalesce(ip.rlike(DOTTED_QUAD) & _quads_ok(ip), F.lit(False))


def valid_cidr(cidr: Column) -> Column:
    ip = F.substring_index(cidr, "/", 1)
    mask = F.substring_index(cidr, "/", -1)
    ok = cidr.rlike(CIDR) & _quads_ok(ip) & (mask.try_cast("int") <= 32)
    return F.coalesce(ok, F.lit(False))


def _fold(quads: Column) -> Column:
    return F.aggregate(quads, F.lit(0).cast("long"),
                       lambda acc, q: F.shiftleft(acc, 8).bitwiseOR(q.try_cast("long")))


def ip_to_long(ip: Column) -> Column:
    """One group = network only (`10` -> 10.0.0.0); two or three groups: the last is the host
    and zero groups are inserted before it (`127.1` -> 127.0.0.1)."""
    q = F.split(ip, r"\.")
    n = F.size(q)
    padded = (F.when(n == 1, F.concat(q, F.array(F.lit("0"), F.lit("0"), F.lit("0"))))
              .when(n < 4, F.concat(F.slice(q, 1, n - 1),
                                    F.array_repeat(F.lit("0"), 4 - n),
                                    F.slice(q, n, 1)))
              .otherwise(q))
    return F.when(valid_ip(ip), _fold(padded))


def long_to_ip(v: Column) -> Column:
    octet = lambda s: F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string")
    return F.when((v >= 0) & (v <= F.lit(MAX_IP)),
                  F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)))


def _shl(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n)


def _shr(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n)


def _network_base(ip: Column) -> Column:
    """Partial quads padded on the right (`127.1` -> 127.1.0.0), unlike ip_to_long."""
    q = F.split(ip, r"\.")
    padded = F.concat(q, F.array_repeat(F.lit("0"), 4 - F.size(q)))
    return _fold(padded)


def cidr_start(cidr: Column) -> Column:
    ip = F.substring_index(cidr, "/", 1)
    shift = F.lit(32) - F.substring_index(cidr, "/", -1).try_cast("int")
    start = _shl(_shr(_network_base(ip), shift), shift)
    return F.when(valid_cidr(cidr), start)


def cidr_end(cidr: Column) -> Column:
    shift = F.lit(32) - F.substring_index(cidr, "/", -1).try_cast("int")
    mask = _shl(F.lit(1).cast("long"), shift) - 1
    return F.when(valid_cidr(cidr), cidr_start(cidr).bitwiseOR(mask))


def ip_range(spec: Column, end: Column | None = None):
    """(start, end) longs of a range given as a pair, a CIDR or a single address; ends sorted."""
    if end is not None:
        a, b = ip_to_long(spec), ip_to_long(end)
    else:
        a = F.when(valid_cidr(spec), cidr_start(spec)).otherwise(ip_to_long(spec))
        b = F.when(valid_cidr(spec), cidr_end(spec)).otherwise(ip_to_long(spec))
    lo = F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
    hi = F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))
    return lo, hi
