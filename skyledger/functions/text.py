"""Text and number coercions as Column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def ascii_lower(c: Column) -> Column:
    """Folds A to Z only, as a case-blind match on header text wants it."""
    return F.translate(c, _UPPER, _LOWER)


def to_text(c: Column) -> Column:
    return F.nullif(c.cast("string"), F.lit(""))


def to_float(c: Column) -> Column:
    """A plain decimal number; anything else, such as `3.5f`, is null."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def to_int(c: Column) -> Column:
    """Truncates toward zero, so `100.0` is 100; zero is a value."""
    return to_float(c).try_cast("bigint")


def norm(c: Column) -> Column:
    """White space of any script as one blank, none at the ends, in upper case."""
    return F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def _decomposed(values: pa.Array) -> pa.Array:
    found = [None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode() for v in values.to_pylist()]
    return pa.array(found, pa.string())


def norm_ascii(c: Column) -> Column:
    """Letters decomposed and what is not ASCII dropped, then as `norm`; only texts that aren't ASCII leave the JVM."""
    odd = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return norm(F.coalesce(F.arrow_udf(_decomposed, "string")(odd), c))


def norm_alnum(c: Column) -> Column:
    return F.regexp_replace(norm(c), "[^A-Z0-9]+", "")


def sanitize(c: Column) -> Column:
    """A file-name segment: runs of other characters become one `_`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), "[^0-9A-Za-z+._-]+", "_"), "^_+|_+$", "")


def unquote(c: Column) -> Column:
    """A header string without its quotes; doubled quotes are one, blanks at the end go."""
    inner = F.regexp_extract(c, "(?s)^'(.*)'$", 1)
    return F.when(c.rlike("(?s)^'.*'$"), F.rtrim(F.replace(inner, F.lit("''"), F.lit("'")))).otherwise(c)


def parts(path: Column) -> Column:
    return F.split(path, r"[\\/]")


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def folder(path: Column, n: int = 1) -> Column:
    """The n-th folder above a file, empty above the root."""
    own = parts(path)
    return F.coalesce(F.when(F.size(own) > n, F.element_at(own, -(n + 1))), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))
