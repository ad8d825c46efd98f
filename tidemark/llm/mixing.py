"""Mixing sources to target weights by Pareto order sampling [native].

Each source gets a target number of words from its weight, capped at a multiple of its size (the excess goes to the
other sources by weight). A document first gets the whole copies that are certain; the rest of its source's target is
drawn by Pareto order sampling: documents with inclusion odds p/(1-p) and random odds u/(1-u) are ranked by the
quotient, and the lowest ranks are taken until the words come nearest to the target. u is a hash of the document id
and a seed, so reruns agree and no shuffle order matters.

No source is gathered: ranks are cut through sums over (source, slice of the score), once more within the slice in which
the source's target falls, and only the one slice of 2 ** BITS that is left is ordered row by row. Sources themselves, one
row each, are ordered in one task.

Defined cases: a null source is a source of its own, last in code point order; a null or wordless text has size 0 and
is never taken; a null id hashes as the text "null"; rows equal in source, score and id are taken together; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, spare, stage

MOST = 3.0
SLICE_BITS, BITS = 12, 24


def sized(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("size", n_words(F.col(text_col)))


def cyclic_weights(cycle: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights by a source's rank (from 0, in code point order): the cycle, repeated."""
    return F.element_at(F.array(*[F.lit(float(x)) for x in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))


def targets(sizes: DataFrame, weight: Column | None = None, most: float = MOST, source_col: str = "source") -> DataFrame:
    """One row for each source: source, source_size, tilt (sum of size * bit length of size), weight, target.

    The cap is solved in closed form: in order of cap/weight, the capped sources are the longest prefix whose level
    (what is left for the others, per weight) still exceeds their own cap/weight.
    """
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _tilt()).alias("tilt"))
    ranked = per.withColumn("rank", F.row_number().over(W.orderBy(F.col(source_col).asc_nulls_last())) - 1)
    weighted = ranked.withColumn("weight", cyclic_weights() if weight is None else weight).drop("rank")
    order = W.orderBy(F.col("__limit") / F.col("weight"), F.col(source_col).asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    limited = weighted.withColumn("__limit", F.col("source_size") * F.lit(most))
    total = F.sum("source_size").over(W.partitionBy())
    level = (total - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    free = F.when(F.col("__level") * F.col("weight") <= F.col("__limit"), F.col("__level"))
    solved = limited.withColumn("__level", level).withColumn("__free", F.first(free, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("__limit"), F.col("__free") * F.col("weight"))
    return solved.withColumn("target", F.coalesce(target, F.col("__limit"))).drop("__level", "__free", "__limit")


def _tilt() -> Column:
    """Inclusion grows with the bit length of a document's size: whole numbers, so sums are exact in any order."""
    return F.length(F.bin(F.col("size")))


def _uniform(id_col: str, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash that other engines have too."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def mix(docs: DataFrame, weight: Column | None = None, most: float = MOST, seed: int = 7, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs (with a column size) -> docs with source_size, target, copies (how often the mix takes the document).

    Columns of docs with these three names are replaced; all others are kept, whatever they are called.
    """
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    own = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("size").cast("long").alias("size")]
    narrow = docs.select(*own)
    plan = stage(targets(narrow, weight, most), "mix-targets")

    def scored(rows: DataFrame, drawn: DataFrame) -> DataFrame:
        """Rows with whole copies, the words that the source still needs, and a score where the row may be drawn."""
        held = rows.join(drawn.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        rest = F.col("target") - whole * F.col("source_size")
        p = F.least(F.lit(1.0), F.when(F.col("tilt") > 0, rest * _tilt() / F.col("tilt")).otherwise(0.0))
        u = _uniform("id", seed)
        odds = u / (1.0 - u) * (1.0 - F.col("p")) / F.col("p")
        held = held.withColumn("whole", whole.cast("long")).withColumn("rest", rest).withColumn("p", p)
        held = held.withColumn("score", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1.0 + odds)))
        return held.withColumn("place", F.floor(F.col("score") * float(1 << BITS)).cast("long"))

    lots = scored(narrow, plan).filter(F.col("score").isNotNull())
    # where each source's target falls: a slice of the score, then a slice of that one
    edge, inside = None, lots.withColumn("before", F.lit(0).cast("long"))
    for left in range(BITS - SLICE_BITS, -1, -SLICE_BITS):
        slices = inside.groupBy("source", F.shiftright("place", left).alias("slice")).agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        until = F.col("before") + F.sum("sum").over(W.partitionBy("source").orderBy("slice"))
        found = slices.withColumn("until", until).filter((F.col("until") - F.col("sum") <= F.col("rest")) & (F.col("rest") < F.col("until")))
        edge = stage(found.select(F.col("source").alias("of"), F.col("slice").alias("edge"), (F.col("until") - F.col("sum")).alias("before")), "mix-edges")
        inside = lots.join(edge, F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("place", left) == F.col("edge")))
    order = W.partitionBy("source").orderBy("score", F.col("id").asc_nulls_first(), "size")
    reach = F.col("before") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2.0
    taken = inside.withColumn("reach", reach).filter(F.col("reach") <= F.col("rest"))
    cut = taken.groupBy("of").agg(F.max(F.struct("score", "id")).alias("last")).withColumnRenamed("of", "cut_of")
    # a source without an edge is taken whole; one with an edge but no row before it stops at the slice's start
    cut = stage(edge.join(cut, F.col("of").eqNullSafe(F.col("cut_of")), "left").select("of", "edge", "last"), "mix-cuts")
    drawn = plan.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    slice_, me = F.col("place"), F.struct("score", "id")
    chosen = F.when(F.col("score").isNull(), False).when(F.col("edge").isNull(), F.lit(True)).when(slice_ < F.col("edge"), True).otherwise((slice_ == F.col("edge")) & F.coalesce(me <= F.col("last"), F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + chosen.cast("long")).otherwise(0).cast("long")
    out = scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *own), drawn).withColumn("copies", copies)
    return out.select("row.*", "source_size", "target", "copies")


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each copy."""
    copy = spare(mixed, "copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*(f"`{c}`" for c in columns))
