"""Labels of record groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomrec.functions.scalar import id_text


def _signed(value: Column, bits: int) -> Column:
    return F.when(value >= 1 << (bits - 1), value - (1 << bits)).otherwise(value)


def group_label(kind: Column, label: Column) -> Column:
    """A group's 32-bit label as text, by the group's type: type signature, id, block number, grid place, or the number itself.

    0 is a signature in its four bytes, the lowest first; 1 and 6 to 10 hold an id; 2 and 3 a signed
    block number; 4 and 5 a grid place x,y, y in the high half, both signed. Null if either is null.
    """
    byte = lambda i: F.chr(F.shiftright(label, 8 * i).bitwiseAND(F.lit(255)))
    half = lambda i: _signed(F.shiftright(label, 16 * i).bitwiseAND(F.lit(65535)), 16).cast("string")
    return (
        F.when(kind.isNull() | label.isNull(), None)
        .when(kind == 0, F.concat(byte(0), byte(1), byte(2), byte(3)))
        .when(kind.isin(1, 6, 7, 8, 9, 10), id_text(label))
        .when(kind.isin(2, 3), _signed(label, 32).cast("string"))
        .when(kind.isin(4, 5), F.concat_ws(",", half(0), half(1)))
        .otherwise(label.cast("string"))
    )
