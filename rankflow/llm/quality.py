"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule, so that a policy (a named, versioned set of rules)
is a bit test, and an ablation (what would change without a rule) is an
aggregation over bits; neither reads a text again.

All work is done by column functions inside the scan: no shuffle, no Python.

Defined cases: a null text counts as empty; an empty text has no words, lines
or symbols and fails ``few_words``; repeated rows each get their own ledger row;
other columns are kept, except those with the ledger's own names, which are
replaced; texts are judged whole, of any length; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.tables import BLANKS, present

#: Rules in bit order: a document fails a rule where its condition holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 12 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}
BIT = {name: 1 << at for at, name in enumerate(RULES)}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals"]


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is kept unless it fails one of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[rule] for rule in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
FULL = Policy("full-1", tuple(RULES))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, the bits of the failed rules."""
    blank_chars = F.lit(" \t\n\x0b\x0c\r")
    mine = ["_text", "_words", "_lines", "_grams", "_sorted", "_at"]
    df = docs.withColumn("_text", present(text))
    trimmed = F.btrim("_text", blank_chars)
    df = df.withColumns({
        "_words": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: F.btrim(line, blank_chars) != ""),
        "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_capitals": F.regexp_count("_text", F.lit("\\p{Lu}")).cast("bigint"),
    })
    df = df.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        # Hashes only tell texts that certainly repeat no window; the others are compared word by word.
        "_grams": F.when(F.size("_words") > 3, _windows(lambda *words: F.xxhash64(*words))),
    })
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    window = lambda i, *words: F.struct(F.concat_ws(" ", *words).alias("g"), i.alias("at"))
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(_windows(window, index=True))))
    df = df.withColumn("_at", F.sort_array(F.transform(_equal_neighbours("_sorted"), lambda x: x["at"])))
    df = df.withColumn("n_repeat_words", F.coalesce(_covered("_at", 3), F.lit(0)).cast("bigint"))
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return df.withColumn("failed", failed.cast("int")).drop(*mine)


def _windows(of, index: bool = False) -> Column:
    """``of`` the three words of every window of ``_words``."""

    def at(i: Column) -> Column:
        words = [F.get("_words", i + k) for k in range(3)]
        return of(i, *words) if index else of(*words)

    return F.transform(F.sequence(F.lit(0), F.size("_words") - 3), at)


def _equal_neighbours(name: str) -> Column:
    """Elements of a sorted array of (g, at) whose g occurs more than once."""

    def same(x: Column, i: Column) -> Column:
        before, after = F.get(F.col(name), i - 1)["g"], F.get(F.col(name), i + 1)["g"]
        return F.coalesce(x["g"] == before, F.lit(False)) | F.coalesce(x["g"] == after, F.lit(False))

    return F.filter(name, same)


def _covered(name: str, width: int) -> Column:
    """Places covered by windows of ``width`` that start at the sorted places in an array."""

    def step(p: Column, i: Column) -> Column:
        return F.least(F.lit(width), F.coalesce(F.get(F.col(name), i + 1) - p, F.lit(width)))

    return F.aggregate(F.transform(name, step), F.lit(0), lambda a, b: a + b)


def kept(policy: Policy, failed: str | Column = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def passing(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger rows that pass a policy.

    The number of the partition keeps the optimizer from moving the test below the
    measurements, where it would repeat them inside one another.
    """
    seated = rows.withColumn("_seat", F.spark_partition_id())
    return seated.filter(kept(policy) & (F.col("_seat") >= 0)).drop("_seat")


def ablations(rows: DataFrame, policy: Policy, by: list[str] | None = None) -> DataFrame:
    """For each rule of a policy: how many rows fail it, fail only it, and are kept in all without it.

    One aggregation over the ledger's bits; groups of ``by`` are combined before the shuffle.
    """
    masked = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = [F.count(F.lit(1)).alias("_rows"), F.count_if(masked == 0).alias("_kept")]
    for rule in policy.rules:
        bit = F.lit(BIT[rule])
        counts.append(F.count_if(masked.bitwiseAND(bit) != 0).alias(f"_any_{rule}"))
        counts.append(F.count_if(masked == bit).alias(f"_only_{rule}"))
    totals = rows.groupBy(*(by or [])).agg(*counts)
    each = [
        F.struct(
            F.lit(rule).alias("rule"),
            F.col(f"_any_{rule}").alias("n_failed"),
            F.col(f"_only_{rule}").alias("n_failed_only_this"),
            (F.col("_kept") + F.col(f"_only_{rule}")).alias("n_kept_without"),
        )
        for rule in policy.rules
    ]
    listed = totals.select(*(by or []), F.lit(policy.version).alias("policy"), F.explode(F.array(*each)).alias("_r"))
    return listed.select(*(by or []), "policy", "_r.*")
