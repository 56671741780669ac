"""One spelling for the many ways a path of the project folder is written."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = " \t\r\n\f\v ﻿​\"'"
_ROOTED = re.compile(r"^(?:file:/*|[a-z]:/|/)", re.I)
#: Already canonical but for letter case: handled inside the JVM (\z, as $ would allow a last line end).
PLAIN = r"^data(?:/[A-Za-z0-9_åäöÅÄÖ][A-Za-z0-9_.åäöÅÄÖ-]*)+\z"


def canonical(path: str | None, anchor: str = "data") -> str | None:
    """The canonical form of one path.

    Surrounding white space and quotes go, percent escapes are decoded, Unicode is
    composed, back slashes become slashes, ``.``, ``..`` and empty steps are resolved,
    letter case is folded.  Of a path with a root (scheme, drive or leading slash) the
    part before the first folder named ``anchor`` is the project's own location and goes.
    NULL gives NULL; a path of nothing but the above gives the empty string.
    """
    if path is None:
        return None
    s = path.strip(_EDGE)
    # every turn that changes anything shortens the path, so this ends
    while len(t := unquote(s)) < len(s):
        s = t
    s = unicodedata.normalize("NFC", s.strip(_EDGE)).replace("\\", "/")
    s = unicodedata.normalize("NFC", s.casefold())
    rooted = bool(_ROOTED.match(s))
    s = _ROOTED.sub("", s)
    out: list[str] = []
    for step in s.split("/"):
        if step == "..":
            if out:
                out.pop()
        elif step not in ("", "."):
            out.append(step)
    if rooted and anchor in out:
        out = out[out.index(anchor) :]
    return "/".join(out)


@F.pandas_udf(T.StringType())
def _canonical_udf(paths: pd.Series) -> pd.Series:
    known: dict = {}
    return pd.Series([None if p is None else known.get(p) or known.setdefault(p, canonical(p)) for p in paths], dtype=object)


def canonical_path(path: Column) -> Column:
    """:func:`canonical` as a Column; only paths not plainly written leave the JVM."""
    plain = path.rlike(PLAIN)
    return F.when(plain, F.lower(path)).otherwise(_canonical_udf(F.when(~plain, path)))
