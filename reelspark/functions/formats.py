"""Text formats of exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(ms: str, separator: str) -> Column:
    """HH:MM:SS, separator and milliseconds; hours never wrap."""
    parts = [f"{ms} div 3600000", f"{ms} div 60000 % 60", f"{ms} div 1000 % 60", f"{ms} % 1000"]
    return F.format_string(f"%02d:%02d:%02d{separator}%03d", *(F.expr(p) for p in parts))


def line_feeds(text: str) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def one_decimal(value: str) -> Column:
    """``value`` rounded half up to one decimal, always shown."""
    tenths = f"cast(floor({value} * 10 + 0.5) as bigint)"
    return F.concat(F.expr(f"{tenths} div 10").cast("string"), F.lit("."), F.expr(f"{tenths} % 10").cast("string"))


def bytes_label(n: str, whole_mb: bool) -> Column:
    """KB, MB or GB of a number of bytes; ``whole_mb``: unknown for null, MB without a decimal, and 0 KB
    may be shown."""
    kb = F.expr(f"cast(floor({n} / 1024 + 0.5) as bigint)")
    kb = kb if whole_mb else F.greatest(F.lit(1).cast("bigint"), kb)
    mb = F.expr(f"cast(floor({n} / 1048576 + 0.5) as bigint)").cast("string") if whole_mb else one_decimal(f"({n} / 1048576)")
    label = F.when(F.col(n) < 1 << 20, F.concat(kb.cast("string"), F.lit(" KB"))).when(F.col(n) < 1 << 30, F.concat(mb, F.lit(" MB"))).otherwise(F.concat(one_decimal(f"({n} / 1073741824)"), F.lit(" GB")))
    return F.coalesce(label, F.lit("unknown")) if whole_mb else label


def content_evidence(data: Column, sample: int = 256 << 10) -> Column:
    """SHA-256 of a binary's size (64 bits, big end first), its first and its last ``sample`` bytes."""
    size = F.octet_length(data)
    tail = F.substring(data, F.greatest(F.lit(1), size - sample + 1), F.lit(sample))
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), F.substring(data, F.lit(1), F.lit(sample)), tail), 256)


def _turned(h: str, digits: int) -> str:
    """The bytes of a hexadecimal text in reverse, as SQL."""
    return "concat(" + ", ".join(f"substr({h}, {k}, 2)" for k in range(digits - 1, 0, -2)) + ")"


def packet_fault(payload: str, most: int) -> Column:
    """Why a packet (64-bit offset, then 16-bit samples, small end first) is refused; null if it is not."""
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    far = F.expr(f"hex(substring({payload}, 8, 1)) >= '80'")
    return F.when(size < 10, "short").when(size > most, "oversize").when(size % 2 != 0, "odd").when(far, "offset")


def packet_offset(payload: str) -> Column:
    return F.expr(f"cast(conv({_turned(f'hex(substring({payload}, 1, 8))', 16)}, 16, 10) as bigint)")


def packet_samples(payload: str) -> Column:
    """The signed samples of a packet."""
    word = f"cast(conv({_turned(f'hex(substring({payload}, 9 + 2 * i, 2))', 4)}, 16, 10) as bigint)"
    return F.expr(f"transform(transform(sequence(0, (octet_length({payload}) - 8) div 2 - 1), i -> {word}), x -> if(x >= 32768, x - 65536, x))")
