"""Spelling-independent forms of thing identifiers and account names.

A thing is named by a base-36 id, optionally preceded by its kind (``t1_`` a comment, ``t3_`` a post). The same thing may
be written with another letter case, with white space around it, and with or without its kind.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for no account.
NO_ACCOUNT = ("", "[deleted]", "[removed]", "automoderator")

_EDGE = r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$"


def squeezed(c: Column) -> Column:
    """``c`` in lower case without white space at its ends."""
    return F.lower(F.regexp_replace(c, _EDGE, ""))


def full_name(c: Column | str, default_kind: str) -> Column:
    """``kind_id`` of an identifier; null for a null, empty or bare-kind one.

    >>> # " T3_9X8A " -> "t3_9x8a";  "9x8a" with default_kind="t3" -> "t3_9x8a";  "t3_" -> null
    """
    c = F.col(c) if isinstance(c, str) else c
    s = squeezed(c)
    kind = F.regexp_extract(s, r"^(t\d)_", 1)
    bare = F.regexp_replace(s, r"^t\d_", "")
    return F.when(
        s.isNotNull() & (bare != ""), F.concat(F.when(kind == "", F.lit(default_kind)).otherwise(kind), F.lit("_"), bare)
    )


def account(c: Column | str) -> Column:
    """The comparison form of an account name; null where the value names no account."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(squeezed(c), r"^/?u/", "")
    s = F.regexp_replace(s, _EDGE, "")
    return F.when(~s.isin(*NO_ACCOUNT), s)
