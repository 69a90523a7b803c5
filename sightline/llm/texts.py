"""Words of whole texts as UTF-8 bytes.

Every operator here sees a text as bytes: lower-casing A-Z and turning ASCII separators into
spaces are byte-for-byte translations, so positions in the normalised text are positions in
the original, and ``bytes.split()`` cuts exactly at space, tab, newline, VT, FF and CR.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes.maketrans(UPPER, UPPER.lower())

_ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Lower-cases A-Z and makes every ASCII character but letters and digits a space.
ALNUM_LOWER = bytes(
    ord(chr(i).lower()) if i in _ALNUM else (i if i > 127 else 32) for i in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of any non-ASCII characters."""
    return text.translate(ALNUM_LOWER).split()


def utf8(column: str | Column) -> Column:
    """The text as UTF-8 bytes, so that Python workers need not decode it."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until it clashes with no column in ``taken``."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name = "_" + name
    return name


def vacant(taken: list[str], name: str) -> str:
    """``name``, which no column in ``taken`` may have: a result replaces no given column."""
    if name.lower() in {c.lower() for c in taken}:
        raise ValueError(f"the table has a column {name} already; name another one for the result")
    return name


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
