"""Text normalisation, keys and statistics as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f]+"
_NOT_ASCII = r"[^\x00-\x7F]"


def _ascii_parts() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds one ASCII character, or several, with these.

    A text's decomposition is that of its characters, apart from the order of marks, which are no ASCII.
    """
    one, many = {}, {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if unicodedata.decomposition(c):
            part = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            if part:
                (one if len(part) == 1 else many)[c] = part
    return one, many


_ONE, _MANY = _ascii_parts()
_FROM, _TO, _WIDE = "".join(_ONE), "".join(_ONE.values()), "".join(_MANY)


def fold(c: Column) -> Column:
    """The ASCII part of the text's compatibility decomposition (NFKD), in any script.

    Letters that become one are translated; texts with a character that becomes several (ligatures, fractions, ...) go
    through their characters first; what is left outside ASCII is dropped. Plain ASCII passes as it is.
    """
    parts = F.array(*[F.lit(x) for x in _MANY.values()])
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.when((x != "") & (F.instr(F.lit(_WIDE), x) > 0), F.get(parts, F.instr(F.lit(_WIDE), x) - 1)).otherwise(x)), "")
    whole = F.when(c.rlike(f"[{_WIDE}]"), spelled).otherwise(c)
    return F.when(c.rlike(_NOT_ASCII), F.regexp_replace(F.translate(whole, _FROM, _TO), _NOT_ASCII, "")).otherwise(c)


def normalize_keep_empty(c: Column, folded: Column | None = None) -> Column:
    """ASCII, punctuation to blanks, blanks collapsed and trimmed; an empty result stays empty."""
    flat = F.regexp_replace(fold(c) if folded is None else folded, r"[^\w\s\x1c-\x1f]", " ")
    return F.trim(F.regexp_replace(flat, _BLANK, " "))


def normalize(c: Column) -> Column:
    """As ``normalize_keep_empty``, but an empty result is null."""
    return F.nullif(normalize_keep_empty(c), F.lit(""))


def _sorted_tokens(c: Column) -> Column:
    words = F.array_remove(F.split(c, _BLANK), "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def fingerprint(c: Column) -> Column:
    """Sorted distinct words of the folded, lower-cased text, parted by blanks and punctuation; null has none."""
    return F.coalesce(_sorted_tokens(F.regexp_replace(F.lower(fold(c)), r"[^\w\s\x1c-\x1f]", " ")), F.lit(""))


def fingerprint_unicode(c: Column) -> Column:
    """As ``fingerprint``, but punctuation becomes blanks before folding, with letters and digits of any script kept.

    Separators that do not decompose to a blank (next line, Ogham space, line and paragraph separator) go with folding.
    """
    return F.coalesce(_sorted_tokens(fold(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}_\s\x1c-\x1f\x{85}\x{1680}\x{2028}\x{2029}]", " "))), F.lit(""))


def canonical_key(c: Column) -> Column:
    """Lower-case, blanks collapsed, only a-z, 0-9 and blanks kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), _BLANK, " "), r"[^a-z0-9 ]", ""))


def title_key(c: Column) -> Column:
    """Lower-case with every run of other characters than a-z and 0-9 turned into one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def has_non_ascii(c: Column) -> Column:
    return c.rlike(_NOT_ASCII)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters in bits; empty text has 0, a null stays null.

    One pass over the sorted characters adds n log n of every run of equal ones.
    """
    chars = F.sort_array(F.array_remove(F.split(c, ""), ""))
    n = F.length(c)

    def mass(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count)).otherwise(0.0)

    def step(s: Column, x: Column) -> Column:
        same = x == s["at"]
        return F.struct(x.alias("at"), F.when(same, s["run"] + 1).otherwise(1.0).alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + mass(s["run"])).alias("sum"))

    start = F.struct(F.lit("").alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    runs = F.aggregate(chars, start, step, lambda s: s["sum"] + mass(s["run"]))
    return F.when(n == 0, 0.0).when(n > 0, F.abs(F.log2(n.cast("double")) - runs / n))


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.trim(c), _BLANK), ""))
