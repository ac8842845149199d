"""Addresses and sensor timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the address pattern of the sensor's own validity check.
IPV4_PATTERN = r"^(((25[0-5]|2[0-4]\d|1\d{2})|([1-9]?\d))\.){3}((25[0-5]|2[0-4]\d|1\d{2})|([1-9]?\d))$"

# Address classes as half-open (low, high] ranges.
ADDRESS_CLASSES = (
    (1, "1.0.0.1", "127.0.0.0"),
    (2, "127.0.0.0", "191.255.255.254"),
    (3, "192.0.1.1", "223.255.255.254"),
    (4, "224.0.0.1", "239.255.255.254"),
)

UNRESOLVED = "-"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where the body uses it often or in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ipv4(c) -> Column:
    """True for a dotted quad with four octets 0-255 and no leading zeros."""
    return F.coalesce(_col(c).rlike(IPV4_PATTERN), F.lit(False))


def ipv4_to_long(c) -> Column:
    """Dotted quad to unsigned 32-bit number; null for anything else."""
    octets = F.split(_col(c), r"\.")
    value = F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, x: acc * F.lit(256) + x.cast("bigint"))
    return F.when(is_ipv4(c), value)


def long_to_ipv4(c) -> Column:
    value = _col(c).cast("bigint")
    octets = [F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("string") for shift in (24, 16, 8, 0)]
    return F.when(value.isNotNull(), F.concat_ws(".", *octets))


def _quad(text: str) -> int:
    return sum(int(part) << shift for part, shift in zip(text.split("."), (24, 16, 8, 0)))


def address_class(c) -> Column:
    """Class 1-4 of an address, 0 outside every range."""

    def chain(value: Column) -> Column:
        out = F.lit(0)
        for number, low, high in reversed(ADDRESS_CLASSES):
            out = F.when((value > F.lit(_quad(low))) & (value <= F.lit(_quad(high))), F.lit(number)).otherwise(out)
        return out

    return bound(ipv4_to_long(c), chain)


def flow_time(c) -> Column:
    """``MM/dd/yy-HH:mm:ss.ffffff`` (month and day may be unpadded) to timestamp; null when unparsable."""
    return F.try_to_timestamp(_col(c), F.lit("M/d/yy-H:mm:ss[.SSSSSS]"))


def epoch_micros(c) -> Column:
    return F.unix_micros(flow_time(c))


def epoch_second(c) -> Column:
    return F.unix_seconds(flow_time(c))


def time_bucket(c, seconds: int = 1) -> Column:
    """Number of the ``seconds``-wide bucket a flow falls into."""
    return F.floor(epoch_second(c) / F.lit(seconds)).cast("bigint")


def differs(c, value: str) -> Column:
    """``!=`` which keeps nulls, as a boolean mask does."""
    return ~_col(c).eqNullSafe(F.lit(value))
