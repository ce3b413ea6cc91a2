"""String column helpers that reproduce Python string semantics with native
Spark expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Characters for which Python's str.isspace() is true; str.strip() removes
# exactly these. Spark's trim() removes only spaces.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line boundaries of Python's str.splitlines().
PY_LINE_BREAK_REGEX = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"
# The same whitespace set as a regex character class (Java and RE2 syntax).
PY_WS_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)
# -----------------------------------------------------------------------------


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(PY_WHITESPACE))


def contains_any(text: Column, words) -> Column:
    """True when any of ``words`` is a substring of ``text``."""
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def count_present(text: Column, words) -> Column:
    """Number of ``words`` that occur at least once as a substring."""
    total = F.lit(0)
    for w in words:
        total = total + text.contains(w).cast("int")
    return total
