"""Text expressions: folding, tokenising and path words."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges that \p{L} and \p{N} hold anyway come first: most letters are decided by them, in half the time.
WORD_BREAK = r"[^a-z0-9\p{L}\p{N}\p{Co}]+"
WORD = r"[a-z0-9\p{L}\p{N}\p{Co}]+"
NOT_ALNUM = r"[^\p{L}\p{N}]+"


@functools.cache
def _accent_map() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and the base letter each one decomposes to."""
    accented, plain = [], []
    blocks = [(0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000)]
    for lo, hi in blocks:
        for code in range(lo, hi):
            letter = chr(code)
            base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
            if len(base) == 1 and base != letter:
                accented.append(letter)
                plain.append(base)
    return "".join(accented), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without diacritics; pure ASCII skips the letter map."""
    accented, plain = _accent_map()
    lowered = F.lower(text)
    stripped = F.regexp_replace(F.translate(lowered, accented, plain), r"\p{Mn}", "")
    # More bytes than characters: something is not ASCII.
    return F.when(F.octet_length(lowered) != F.length(lowered), stripped).otherwise(lowered)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in text order."""
    return F.array_remove(F.split(fold(text), WORD_BREAK), "")


def token_count(text: Column) -> Column:
    """Number of tokens, without building them."""
    return F.regexp_count(fold(text), F.lit(WORD))


def words_of(text: Column) -> Column:
    """Letters and digits kept, everything else becomes single spaces."""
    return F.trim(F.regexp_replace(text, NOT_ALNUM, " "))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def parent_path(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+/*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension without its dot, empty for none; a leading dot does not start one."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))
