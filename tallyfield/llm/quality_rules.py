"""Quality rules as a ledger of failure bits and measurements, in SQL expressions only.

Every rule is evaluated once a document, in one pass without a shuffle. A policy is a mask
of the rules that reject; verdicts under any policy, and what each rule rejects alone, come
from the stored bits without looking at a text again.

A null text counts as empty: it has no words and fails the rule for short texts. Null ids
and repeated rows keep a row each; a very long text is measured whole by its task; other
columns, whatever their names, are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import WORD, text_or_empty

WINDOW = 8  # words of a window whose repeats count
# bit, name, condition under which a document fails
RULES: list[tuple[int, str, str]] = [
    (0, "too_few_words", "n_words < 20"),
    (1, "repeated_words", "100 * n_repeat_words > 30 * n_words"),
    (2, "symbols", "10 * n_symbols > 3 * n_words"),
    (3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
]
BASE_MASK = 0b00011
POLICIES: dict[str, int] = {"base": BASE_MASK, "v1": 0b00111, "v2": 0b11111}
CURRENT = "v2"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the measurements that the rules use."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    d = d.withColumn("words", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("win", F.expr(f"case when size(words) >= {WINDOW} then transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW}))) else array() end"))
    # Windows met twice: sort (hash, start), keep those equal to a neighbour, and add up how
    # far each start is from the next one, a window's length at most.
    starts = "sort_array(transform(filter(s, (x, j) -> x.h = s[j - 1].h or x.h = s[j + 1].h), x -> x.i))"
    held = "transform(array(sort_array(transform(win, (h, i) -> named_struct('h', h, 'i', i)))), s -> {})[0]"
    cover = f"aggregate(transform(p, (x, j) -> least({WINDOW}, coalesce(get(p, j + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
    repeat = "case when size(array_distinct(win)) = size(win) then 0L else transform(array({}), p -> {})[0] end".format(held.format(starts.replace("s[j - 1]", "get(s, j - 1)").replace("s[j + 1]", "get(s, j + 1)")), cover)
    return d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat).cast("long").alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, rules: list[tuple[int, str, str]] = RULES, **kw) -> DataFrame:
    """Measurements and ``fail_bits``: bit b is set if the rule of that bit fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.expr(f"case when {cond} then {1 << bit}L else 0L end") for bit, _, cond in rules))
    return measured(docs, **kw).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, mask: int) -> DataFrame:
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0)


def ablations(led: DataFrame, rules: list[tuple[int, str, str]] = RULES, policies: dict[str, int] = POLICIES) -> DataFrame:
    """Per policy and rule of it: documents, rejected, failing the rule, rejected by it alone.

    Documents are first counted by their bits, of which there are at most 2 to the number of
    rules; policies and rules are applied to those counts.
    """
    counts = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    plan = [(p, mask, name, 1 << bit) for p, mask in policies.items() for bit, name, _ in rules if mask >> bit & 1]
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for p, m, n, b in plan)))
    hit = F.col("fail_bits").bitwiseAND(F.col("p.mask"))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (
        counts.select("fail_bits", "n", each.alias("p"))
        .groupBy(F.col("p.policy").alias("policy"), F.col("p.rule").alias("rule"))
        .agg(F.sum("n").alias("n_docs"), total(hit != 0).alias("n_rejected"), total(hit.bitwiseAND(F.col("p.bit")) != 0).alias("n_failing"), total(hit == F.col("p.bit")).alias("n_only"))
    )


def quality_rules(docs: DataFrame, policy: str = CURRENT, **kw) -> DataFrame:
    led = apply_policy(ledger(docs, **kw), POLICIES[policy] | BASE_MASK)
    return led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0)
