"""Quality rules as a bitmask ledger: measure once, store, then apply policies and ablations to the stored bits.

Everything here is built from DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted

#: The characters that part words, and those that count as symbols.
SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Bit of each rule in the ledger, with the condition under which a document fails it. A bit keeps its meaning for ever;
#: new rules take new bits.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbol_share": (2, "10 * n_symbols > n_words"),
    "duplicate_lines": (3, "n_dup_lines > 1 AND 10 * n_dup_lines > 3 * n_lines"),
    "short_words": (4, "n_words > 0 AND word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 15 * n_words"),
}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbol_share", "duplicate_lines", "short_words", "long_words"),
    # scripts that part no words by blanks have long ones
    "v2": ("few_words", "repeated_windows", "symbol_share", "duplicate_lines", "short_words"),
}


@dataclass(frozen=True)
class Policy:
    name: str

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in POLICIES[self.name])


def _without(column: str, chars: str | tuple[str, ...]) -> F.Column:
    out = F.col(column)
    for c in chars:
        out = F.replace(out, F.lit(c))
    return out


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text but with the measurements that the rules read.

    Windows of eight words are found by a 64-bit hash built by doubling (1, 2, 4, 8 words). Only documents in which a
    hash occurs twice sort their windows; neighbours of equal hash are then compared word by word. Should their words
    differ, the document's windows are sorted by their words instead. Positions of repeated windows are merged into
    covered words.
    Null text counts as empty. Each row stands alone, so nulls, ties and repeated rows in other columns do not matter;
    columns named like a measurement are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    own = [c for c in docs.columns if c != text_col and c.lower() not in made]
    kept = ["_row"]  # one column for all others, so that no name of theirs meets one of the names below
    spaced = F.col("_t")
    for c in SPACES:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    row = F.struct(*[F.col(quoted(c)) for c in own]) if own else F.lit(None)
    d = docs.select(row.alias("_row"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("_t"))
    d = d.select(
        *kept,
        spaced.alias("_s"),
        F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("_lines"),
        (F.length("_t") - F.length(_without("_t", SYMBOLS))).cast("long").alias("n_symbols"),
    )
    d = d.select(
        *kept,
        "n_symbols",
        F.length(F.replace("_s", F.lit(" "))).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("array_remove(split(_s, ' ', -1), '')").alias("_w"),
    )
    now = [*kept, "n_symbols", "word_chars", "n_lines", "n_dup_lines"]
    d = d.select(*now, F.size("_w").cast("long").alias("n_words"), "_w", F.expr("transform(_w, w -> xxhash64(w))").alias("_h"))
    now += ["n_words", "_w"]
    for step in (1, 2, 4):
        d = d.select(*now, F.expr(f"zip_with(_h, slice(_h, {step + 1}, size(_h)), (a, b) -> xxhash64(a, b))").alias("_h"))
    d = d.select(*now, F.expr(f"slice(_h, 1, greatest(size(_h) - {WINDOW - 1}, 0))").alias("_h"))
    # windows as (hash, null, position), or as (null, words, position) where equal hashes have different words
    differ = f"slice(_w, x.p + 1, {WINDOW}) != slice(_w, y.p + 1, {WINDOW})"
    d = d.select(
        *now,
        F.expr("""
            CASE WHEN size(array_distinct(_h)) < size(_h) THEN
                sort_array(zip_with(_h, sequence(0, size(_h) - 1), (h, p) -> named_struct('h', h, 'w', CAST(NULL AS string), 'p', p)))
            END""").alias("_z"),
    )
    d = d.select(*now, "_z", F.expr(f"exists(zip_with(_z, slice(_z, 2, size(_z)), (x, y) -> x.h = y.h AND {differ}), c -> c)").alias("_clash"))
    d = d.select(
        *now,
        F.expr(f"""
            CASE WHEN _clash THEN
                sort_array(transform(_z, z -> named_struct('h', CAST(NULL AS bigint), 'w', array_join(slice(_w, z.p + 1, {WINDOW}), ' '), 'p', z.p)))
            ELSE _z END""").alias("_z"),
    )
    now.remove("_w")
    d = d.select(*now, "_z", F.expr("zip_with(_z, slice(_z, 2, size(_z)), (x, y) -> coalesce(x.h <=> y.h AND x.w <=> y.w AND y.p IS NOT NULL, false))").alias("_e"))
    d = d.select(
        *now,
        F.expr("""
            sort_array(filter(
                zip_with(_z, zip_with(_e, concat(array(false), _e), (a, b) -> coalesce(a, false) OR coalesce(b, false)),
                         (x, r) -> IF(r, x.p, NULL)),
                p -> p IS NOT NULL))""").alias("_p"),
    )
    repeat = F.expr(f"""
        CAST(coalesce(aggregate(
            zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))),
            0, (s, x) -> s + x), 0) AS long)""")
    return d.select(*[F.col("_row")[c].alias(c) for c in own], *now[1:], repeat.alias("n_repeat_words"))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit b is set if the document fails the rule of bit b. Each rule runs once."""
    bits = F.lit(0).cast("long")
    for bit, condition in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def stored(entries: DataFrame, path: str) -> DataFrame:
    """The ledger as it is read back from Parquet at ``path``, which policies and ablations then share.

    A filter on the bits of a ledger that is not stored would make the optimizer repeat the measurements in its condition.
    """
    entries.write.parquet(path)
    return entries.sparkSession.read.schema(entries.schema).parquet(path)


def apply_policy(entries: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """``out`` is true where no rule of the policy failed."""
    return entries.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, and how many more would be kept without it.

    The ledger shrinks to one row for each pattern of bits before any rule is looked at; of an empty one no rows are left.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy.name]])
    hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    return (
        patterns.select("n", hit.alias("hit"), F.explode(rules).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(F.col("r.bit")) != 0, F.col("n"))), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("hit") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
        )
    )
