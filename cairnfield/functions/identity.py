"""Content identity: equal bytes have equal ids, wherever they live."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id formats.
HASH_PREFIX = "sha256:"
PUBLIC_ID_PREFIX = "sub:item/img_"
PUBLIC_ID_DIGITS = 12


def content_hash(content: Column) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(content.cast("binary"), 256))


def public_id(hash_col: Column) -> Column:
    return F.concat(F.lit(PUBLIC_ID_PREFIX), F.substring(hash_col, len(HASH_PREFIX) + 1, PUBLIC_ID_DIGITS))
