"""Scalar functions of the text codecs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_int(s: Column) -> Column:
    """The 64-bit value of text that is exactly how that value is written, else null."""
    v = s.try_cast("long")
    return F.when((v.cast("string") == s) & (F.octet_length(s) <= 19), v)


def fixed_decimal(s: Column) -> tuple[Column, Column]:
    """Scaled value and number of decimals of canonical fixed-decimal text of 3 to 19 characters, else nulls."""
    fine = s.rlike(r"^-?(0|[1-9][0-9]*)\.[0-9]+$") & F.octet_length(s).between(3, 19)
    return F.when(fine, F.replace(s, F.lit("."), F.lit("")).try_cast("long")), F.when(fine, F.octet_length(s) - F.instr(s, "."))


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def is_lower_hex(s: Column) -> Column:
    """Lower-case hex digits of even number."""
    return s.rlike("^([0-9a-f][0-9a-f])+$")


def human_bytes(n: Column) -> Column:
    out = F.concat(n.cast("string"), F.lit(" B"))
    for limit, unit in ((1 << 10, "KiB"), (1 << 20, "MiB"), (1 << 30, "GiB")):
        out = F.when(n >= limit, F.format_string(f"%.1f {unit}", F.bround(n.cast("double") / limit, 1))).otherwise(out)
    return out


def parse_size(s: Column) -> Column:
    """`10`, `10K`, `10m`, `2G`, `1T`: powers of 1024; null for anything else."""
    unit = F.upper(F.regexp_extract(s, r"^\d+([KkMmGgTt]?)[Bb]?$", 1))
    number = F.regexp_extract(s, r"^(\d+)[KkMmGgTt]?[Bb]?$", 1)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", number.cast("long") * F.pow(F.lit(1024), power).cast("long"))
