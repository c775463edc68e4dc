"""Natural keys hashed to short identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memlake.functions.text import as_column

#: Put before every identifier's kind; set it once to share an id space with another store.
ID_SPACE = ""


def stable_id(kind: str, *parts: Column | str) -> Column:
    """kind_ and the first 16 hex digits of the SHA-1 of the parts joined by ||; null parts count as empty."""
    joined = F.concat_ws("||", *(F.coalesce(as_column(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{ID_SPACE}{kind}_"), F.substring(F.sha1(joined.cast("binary")), 1, 16))
