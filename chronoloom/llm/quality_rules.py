"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per failed rule; policies are
versioned masks over those bits, so that changing a policy or asking what one rule alone removes never reads the texts again.
Everything is built of DataFrame functions and runs without any exchange.

Defined results: a null or blank text has no words and measures 0 everywhere, so it fails ``few_words``; repeated rows are
judged row by row; an empty table gives an empty ledger; extra columns are carried unless their names clash with those of
the ledger, in which case the ledger's win.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free_name, let, space_words

WINDOW = 8

#: rule -> failed? over the measurements. The position in this table is the rule's bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbol_ratio": "n_words > 0 AND 10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)",
    "capitals": "100 * n_upper > 40 * word_chars",
    "exclamations": "n_words > 0 AND 10 * n_bangs > 2 * n_words",
}

#: policy version -> rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": tuple(RULES),
}
BASE_POLICY, CURRENT_POLICY = "v1", "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


def rule_bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def policy_mask(version: str) -> int:
    return sum(rule_bit(r) for r in POLICIES[version])


def _count_of(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def repeat_words(windows: Column) -> Column:
    """Words covered by windows that occur at least twice, from the hashes of all windows in order.

    The hashes are sorted with their positions, so that equal windows are neighbours; the flagged positions in order then
    add up to the covered words. Texts without a repeated window stop after one distinct count.
    """
    keyed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    flagged = let(
        keyed,
        lambda ps: F.filter(ps, lambda p, j: (F.get(ps, j - 1)["h"] == p["h"]) | F.coalesce(F.get(ps, j + 1)["h"] == p["h"], F.lit(False))),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.sort_array(F.transform(flagged, lambda p: p["i"])),
        start,
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), covered).otherwise(F.lit(0)).cast("long")


def _pair_hashes(hashes: Column, shift: int) -> Column:
    """Hashes of runs twice as long, from the hashes of runs of ``shift`` members."""
    n = F.greatest(F.size(hashes) - shift, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))


def measurements(text_col: str = "text") -> Column:
    """A struct of all measurements of a text. Words, lines and window hashes are bound once, so the struct may be used in a
    filter, where Catalyst puts expressions in place of column names, without computing them again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(words: Column, body: Callable[[Column], Column]) -> Column:
        one = F.transform(words, lambda x: F.xxhash64(x))
        return let(one, lambda h1: let(_pair_hashes(h1, 1), lambda h2: let(_pair_hashes(h2, 2), lambda h4: let(_pair_hashes(h4, 4), body))))

    def figures(w: Column, l: Column, h: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count_of(text, "#*$%&|<>").alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            repeat_words(h).alias("n_repeat_words"),
            F.size(l).cast("long").alias("n_lines"),
            _count_of(text, "A-Z").alias("n_upper"),
            _count_of(text, "!").alias("n_bangs"),
        )

    return let(space_words(F.col(text_col)), lambda w: let(lines, lambda l: windows(w, lambda h: figures(w, l, h))))


def _bits(measured: str) -> Column:
    """The failed rules of the struct ``measured``, which is named once."""
    own = re.compile(r"\b(" + "|".join(MEASURES) + r")\b")
    terms = " + ".join(f"CASE WHEN {own.sub(r'm.\1', sql)} THEN {rule_bit(name)} ELSE 0 END" for name, sql in RULES.items())
    return F.expr(f"element_at(transform(array(`{measured}`), m -> CAST({terms} AS BIGINT)), 1)")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with one column per measurement."""
    kept, own = [F.col(f"`{c}`") for c in docs.columns if c not in MEASURES], free_name(docs, "_m")
    return docs.withColumn(own, measurements(text_col)).select(*kept, *[F.col(f"{own}.{m}").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with their measurements and ``rule_bits``: bit k is set where the k-th rule failed."""
    kept, own = [F.col(f"`{c}`") for c in docs.columns if c not in (*MEASURES, "rule_bits")], free_name(docs, "_m")
    return docs.withColumn(own, measurements(text_col)).select(*kept, *[F.col(f"{own}.{m}").alias(m) for m in MEASURES], _bits(own).alias("rule_bits"))


def apply_policy(ledger_df: DataFrame, version: str = CURRENT_POLICY, out: str = "kept") -> DataFrame:
    """Adds ``out``: true where no rule of the policy failed."""
    return ledger_df.withColumn(out, F.col("rule_bits").bitwiseAND(F.lit(policy_mask(version))) == 0)


def ablation(ledger_df: DataFrame, version: str = CURRENT_POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that a policy without it would keep.

    The ledger is first counted by bit pattern (at most 2^rules rows, combined before the shuffle).
    """
    mask = policy_mask(version)
    patterns = ledger_df.groupBy(F.col("rule_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(rule_bit(r)).cast("long").alias("bit")) for r in POLICIES[version]])
    each = patterns.select("bits", "n", F.inline(names))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    alone = F.col("bits") == F.col("bit")
    zero = F.lit(0)
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(zero)).alias("n_only_this"),
        F.sum(F.when((F.col("bits") == 0) | alone, F.col("n")).otherwise(zero)).alias("n_kept_without"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """The digest of the ledger that the query returns."""
    judged = apply_policy(apply_policy(ledger(docs), BASE_POLICY, "_base_kept"), CURRENT_POLICY)
    return judged.select("doc_id", *MEASURES, "rule_bits", (~F.col("_base_kept")).alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the current policy keeps, with their own columns."""
    own, bits = free_name(docs, "_m"), free_name(docs, "_bits")
    judged = docs.withColumn(own, measurements()).withColumn(bits, _bits(own))
    return judged.where(F.col(bits).bitwiseAND(F.lit(policy_mask(CURRENT_POLICY))) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def _sql_rules(names: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN {RULES[r]} THEN {rule_bit(r)} ELSE 0 END" for r in names)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS gram
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, sum(least({WINDOW}, i - prev)) AS n
        FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -{WINDOW}) AS prev FROM rep) GROUP BY r),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(l)::BIGINT AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper,
             length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_bangs
      FROM d LEFT JOIN cov USING (r)),
b AS (SELECT *, ({_sql_rules(tuple(RULES))})::BIGINT AS rule_bits FROM m)
SELECT *, (rule_bits & {policy_mask(BASE_POLICY)}) <> 0 AS base_failed, (rule_bits & {policy_mask(CURRENT_POLICY)}) = 0 AS kept FROM b
"""
