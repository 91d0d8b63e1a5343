"""Whether a query asks for the newest records (a small fixed grammar)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the grammar.
VETO = re.compile(r"(?<!\w)not\s+(?:the\s+)?latest(?!\w)")
NEWEST = re.compile(r"(?<!\w)latest(?!\w)")
VETO_PREFIXES = ("最新ではない", "直近ではない")
NEWEST_PREFIXES = ("最新", "直近")
DAYS = re.compile(r"(?<!\w)last\s+([0-9]{1,3})\s+days?(?!\w)")
DAYS_PREFIXES = (re.compile(r"过去\s*([0-9]{1,3})\s*天"), re.compile(r"過去\s*([0-9]{1,3})\s*日"))
MAX_DAYS = 365


def wants_recent(text: str | None) -> bool:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    start = folded.lstrip()
    if VETO.search(folded):
        return False
    if NEWEST.search(folded):
        return True
    if start.startswith(NEWEST_PREFIXES):
        return not start.startswith(VETO_PREFIXES)
    spans = [DAYS.search(folded), *(p.match(start) for p in DAYS_PREFIXES)]
    return any(1 <= int(m[1]) <= MAX_DAYS for m in spans if m)


def recent(text: Column | str) -> Column:
    """The same for a column: NFKC has no built-in, so an Arrow function does it."""
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(wants_recent)

    return run(F.col(text) if isinstance(text, str) else text)
