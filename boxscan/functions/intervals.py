"""Column arithmetic on half-open intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxscan import constants as K


def centre_start(start: Column, end: Column, width: int = K.WINDOW) -> Column:
    """Start of the centred ``width``-nt part; an odd excess cuts one more at the end."""
    return start + F.floor((end - start - width) / 2)


def centre_end(start: Column, end: Column, width: int = K.WINDOW) -> Column:
    return end - F.ceil((end - start - width) / 2)


def widen_left(start: Column, end: Column, width: int = K.WINDOW) -> Column:
    """Nucleotides to add on the left so that the interval becomes ``width`` long."""
    return F.greatest(F.floor((width - (end - start)) / 2), F.lit(0))


def widen_right(start: Column, end: Column, width: int = K.WINDOW) -> Column:
    return F.greatest(F.ceil((width - (end - start)) / 2), F.lit(0))


def flip(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Coordinates counted from the 3' end -> plus-strand coordinates."""
    return length - end, length - start
