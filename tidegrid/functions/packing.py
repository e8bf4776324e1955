"""Raw counts to physical values, class codes, and packed integer codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..domain import CLASS_MAX, CLASS_MIN, Packing, Variable, code_limits


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def physical(raw, var: Variable) -> Column:
    """`raw * scale + offset`, NULL for the fill value."""
    raw = _col(raw)
    value = raw * F.lit(var.scale)
    if var.offset:
        value = value + F.lit(var.offset)
    return F.when(raw != var.fill, value)


def is_class(raw) -> Column:
    """True for 1..5. Land and ice are coded outside that range in every source
    encoding, below it in one and above it in the other, so both ends count."""
    return _col(raw).between(CLASS_MIN, CLASS_MAX)


def class_or_null(raw) -> Column:
    raw = _col(raw)
    return F.when(is_class(raw), raw)


def quantise(value, packing: Packing, no_value=None) -> Column:
    """Nearest code, clamped to the packable range. `no_value` marks ocean cells
    that get the sentinel; a cell that is neither stays NULL."""
    code = F.rint((_col(value) - F.lit(packing.offset)) / F.lit(packing.scale))
    low, high = (F.lit(float(c)) for c in code_limits(packing))
    code = F.least(F.greatest(code, low), high).cast("int")
    code = F.when(_col(value).isNotNull(), code)
    if packing.sentinel is not None and no_value is not None:
        code = F.when(_col(no_value), F.lit(packing.sentinel)).otherwise(code)
    return code


def code_bytes(code, packing: Packing) -> list[Column]:
    """The code's bytes, high one first."""
    shifts = range(8 * (packing.channels - 1), -1, -8)
    return [F.shiftright(_col(code), s).bitwiseAND(F.lit(255)) for s in shifts]


def decode(code, packing: Packing) -> Column:
    value = _col(code) * F.lit(packing.scale) + F.lit(packing.offset)
    if packing.sentinel is None:
        return value
    return F.when(_col(code) != packing.sentinel, value)
