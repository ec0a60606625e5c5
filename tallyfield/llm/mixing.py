"""Mix sources to target weights by systematic sampling, in DataFrame operations only.

Targets: sources in code point order (null last) take the weights in turn and share
``share`` times the corpus; no target passes ``cap`` times its source, and what is cut off
goes to the others by weight until none is above (solved in closed form: capped sources
are a prefix in order of size over weight).

Sampling: every document of a source has the same expected number of copies, its target
over its size. Documents stand in one order within their source; the prefix sum of expected
copies plus one offset drawn for the source crosses some integers at each document, and the
document is taken once for each. The order goes by size, so what one long document takes too
much or too little is made up by its neighbours of like length: the error of a source stays
below its longest document.

The position in the order is not a window over the source, which may hold a third of all
rows. It is a sum of three counts: of smaller size classes (at most 512 for each power of
two), of lower salts within the class, and a row number within (source, class, salt), a
group kept near 100,000 rows whatever the corpus. The salt and the offset come from md5, so
reruns agree.

Nulls and odd input: a null text has size 0 and is drawn like any other; a null source is a
source of its own, after the others; null ids and repeated rows are rows like any other (a
tie in everything shown is between equal rows); a source without words has target 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import WORD, staged, unused, with_row_id

GROUP_ROWS = 100_000  # rows that one window sorts, about, if every document has one size
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row a source (``k``, ``source_size``) in; with ``target`` out.

    The table of sources is a dimension: its windows run over one row a source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy("k")
    by_fill = Window.partitionBy(F.lit(0)).orderBy("fill", "k")
    everything = Window.partitionBy(F.lit(0))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("fill", F.col("source_size") / F.col("w"))
    s = s.withColumns(
        {
            "n": F.row_number().over(by_fill),
            "rest": F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    fits = F.col("w") * F.col("rest") / F.col("rest_w") <= F.lit(cap) * F.col("source_size")
    level = F.min(F.when(fits, F.struct("n", "rest", "rest_w"))).over(everything)
    s = s.withColumn("level", level)
    open_target = F.col("w") * F.col("level.rest") / F.col("level.rest_w")
    target = F.when(F.col("n") >= F.col("level.n"), open_target).otherwise(F.lit(cap) * F.col("source_size"))
    return s.select("k", "source_size", target.cast("double").alias("target"))


def mixed(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, tie: str | None = None) -> DataFrame:
    """Add source_size, target, copies and taken to rows of (doc_id, source, size).

    Other columns of ``rows`` pass through, but for k, class, salt, r and base, which are this
    function's own; rows of one size and id go by ``tie``. ``rows`` should be cheap to read
    twice.
    """
    n = rows.count()
    salts = SALTS * (1 + n // (SALTS * GROUP_ROWS))
    digits = lambda c, k: F.conv(F.substring(F.md5(c), 1, k), 16, 10).cast("long")
    rows = rows.withColumns(
        {
            "k": F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")),
            "class": F.expr("size - size % cast(pow(2, greatest(0, length(bin(size)) - 10)) as bigint)"),
            "salt": digits(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 8) % F.lit(salts),
        }
    )
    counts = rows.groupBy("k", "class", "salt").agg(F.count("*").alias("c"))
    classes = counts.groupBy("k", "class").agg(F.sum("c").alias("c"))
    lower = Window.partitionBy("k").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select("k", "class", F.coalesce(F.sum("c").over(lower), F.lit(0)).alias("lower"))
    in_class = Window.partitionBy("k", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("salted", F.coalesce(F.sum("c").over(in_class), F.lit(0))).join(classes, ["k", "class"])
    bases = bases.select("k", "class", "salt", (F.col("lower") + F.col("salted")).alias("base"))
    targets = source_targets(rows.groupBy("k").agg(F.sum("size").alias("source_size")), weights, share, cap)
    bases = bases.join(targets, "k")

    own = Window.partitionBy("k", "class", "salt").orderBy("size", F.col("doc_id").asc_nulls_first(), *([tie] if tie else []))
    rows = rows.withColumn("r", F.row_number().over(own)).join(bases, ["k", "class", "salt"])
    u = digits(F.concat(F.lit("offset:"), "k"), 5) / F.lit(1048576.0)
    upto = lambda r: F.floor(r * F.col("target") / F.col("source_size") + u)
    r = F.col("base") + F.col("r")
    copies = F.when(F.col("source_size") > 0, upto(r) - upto(r - 1)).otherwise(F.lit(0))
    rows = rows.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return rows.drop("k", "class", "salt", "r", "base")


def document_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *more: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), *more)


def mix_plan(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row a document."""
    return mixed(staged(document_sizes(docs), "sizes"), **kw)


def mix_documents(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, and the columns of ``docs``."""
    name, copies, copy = (unused(docs, x) for x in ("__mix_row", "__mix_copies", "__mix_copy"))
    held = with_row_id(docs, name)
    plan = mixed(staged(document_sizes(held, "doc_id", "text", "source", name), "sizes"), tie=name, **kw)
    taken = plan.where("copies > 0").select(name, F.col("copies").alias(copies))
    out = held.join(taken, name)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
