"""The form in which terms, callees and ids are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, which is removed at both ends of a key.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def key_form(col: Column | str) -> Column:
    """Trimmed, lower-case form of a key; null if nothing is left.

    Most keys begin and end with a visible character of ASCII and need no search for white space.
    """
    col = F.col(col) if isinstance(col, str) else col
    trimmed = F.when(col.rlike(r"(?s)^[!-~](?:.*[!-~])?\z"), col).otherwise(F.btrim(col, F.lit(WHITE_SPACE)))
    return F.nullif(F.lower(trimmed), F.lit(""))


def sql_key_form(col: str) -> str:
    """The same as an expression of DuckDB."""
    chars = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)
    return f"nullif(lower(trim({col}, {chars})), '')"
