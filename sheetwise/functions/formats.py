"""Sizes, speeds and fingerprints as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB, TIB = 1024, 1024**2, 1024**3, 1024**4


def half_up(value: Column, digits: int = 0) -> Column:
    """Round halves upwards, as the three receivers do."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def _tenths(value: Column) -> Column:
    return F.format_string("%.1f", half_up(value, 1))


def format_bytes(size: Column, style: str = "server") -> Column:
    """Size as text in the ``server``, ``desktop`` or ``phone`` style."""
    real = size.cast("double")
    if style == "server":
        return (
            F.when(size <= 0, "0 B")
            .when(size < KIB, F.concat(size.cast("long").cast("string"), F.lit(" B")))
            .when(size < MIB, F.concat(_tenths(real / KIB), F.lit(" KB")))
            .when(size < GIB, F.concat(_tenths(real / MIB), F.lit(" MB")))
            .when(size < TIB, F.concat(_tenths(real / GIB), F.lit(" GB")))
            .otherwise(F.concat(_tenths(real / TIB), F.lit(" TB")))
        )
    if style == "desktop":
        return (
            F.when(size >= GIB, F.concat(F.format_number(half_up(real / GIB, 1), 1), F.lit(" GB")))
            .when(size >= MIB, F.concat(F.format_number(half_up(real / MIB, 1), 1), F.lit(" MB")))
            .when(size >= KIB, F.concat(F.format_number(half_up(real / KIB), 0), F.lit(" KB")))
            .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))
        )
    if style == "phone":
        return (
            F.when(size >= GIB, F.concat(_tenths(real / GIB), F.lit(" GB")))
            .when(size >= MIB, F.concat(_tenths(real / MIB), F.lit(" MB")))
            .when(size >= KIB, F.concat(half_up(real / KIB).cast("long").cast("string"), F.lit(" KB")))
            .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))
        )
    raise ValueError(f"unknown style {style!r}")


def transfer_rate(size: Column, seconds: Column) -> Column:
    """Bytes per second; a transfer takes at least a millisecond."""
    return size / F.greatest(seconds, F.lit(0.001))


def transfer_speed(size: Column, seconds: Column) -> Column:
    """Speed as text: MB/s with one decimal from 1 MiB/s on, else at least 1 KB/s."""
    rate = transfer_rate(size, seconds)
    slow = F.greatest(F.lit(1), half_up(rate / KIB).cast("long"))
    return F.when(rate >= MIB, F.concat(_tenths(rate / MIB), F.lit(" MB/s"))).otherwise(
        F.concat(slow.cast("string"), F.lit(" KB/s"))
    )


def content_fingerprint(content: Column) -> Column:
    """Change tag: the first 16 hex characters of the SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 16)
