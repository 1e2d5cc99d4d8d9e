"""Mixing sources to target weights (operator 7), native.

Method: Poisson replication.  A source's mean rate is its target share of all
bytes over its own bytes.  Each row's copies are a Poisson number with that mean,
found by inverting the distribution at a uniform number hashed from seed, id and
text; rows are exploded by their copies and shuffled globally by a hash of seed,
id, text and copy.

A rate above MOST_RATE is split into equal parts of at most that, since exp(-rate)
leaves the normal doubles near 708; a sum of independent Poisson numbers is one.
Each further part has its own number, hashed from the row's.

Only DataFrame functions: per source the cumulative probabilities are built once,
up to where they equal 1 in doubles; a row counts those below its numbers.  Sources
are joined, not collected, and Spark broadcasts them only if their measured size
allows it.  A source that holds a third of all rows is summed partially before
the shuffle, and its side of the join is split by AQE if it is not broadcast.

Defined results: a null source is a source of its own; null and empty texts have
0 bytes and take their source's rate; a source of 0 bytes keeps every row once
(with ``weights``, if it is named with more than 0; sources not named are dropped);
repeated rows get the same number of copies, each row its own; an empty table
gives no rows; extra columns are kept, and where they are named like ours (_copy,
_copies, _order), ours get another underscore in front (``names``); ties in the
shuffle's hash stay in any order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import scratch

#: The largest mean that is inverted at once.
MOST_RATE = 700.0

#: Digits to which targets relative to the largest are rounded before they are summed.
DIGITS = 15


def names(columns: list[str]) -> tuple[str, str, str]:
    """What _copy, _copies and _order are called beside ``columns``."""
    taken = {c.lower() for c in columns}

    def free(name: str) -> str:
        while name in taken:
            name = "_" + name
        return name

    return free("_copy"), free("_copies"), free("_order")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1): 52 bits of the md5 of the parts, joined by ':'."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, bytes, rate (null for a source of 0 bytes that is kept once).

    Without ``weights`` a source's target is its bytes to ``power``, 0 or more; sources not named in ``weights`` have target 0.
    """
    if power < 0 or any(w < 0 for w in (weights or {}).values()):
        raise ValueError("a power or weight below 0")
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("bytes"))
    if weights is None:
        target = F.round(F.pow(F.col("bytes").cast("double"), F.lit(float(power))), 4).cast("decimal(38,4)")
        kept = F.lit(True)
    else:
        top = max(weights.values(), default=0.0) or 1.0
        named = F.create_map(*(F.lit(x) for name, w in sorted(weights.items()) for x in (name, w / top))) if weights else None
        target = F.coalesce(named[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
        # No weight is too small to count: the least that is told from 0 stays.
        target = F.when(target > 0, F.greatest(F.round(target, DIGITS).cast(f"decimal(38,{DIGITS})"), F.lit(Decimal(1).scaleb(-DIGITS)))).otherwise(F.lit(0).cast(f"decimal(38,{DIGITS})"))
        kept = target > 0
    with scratch(docs.sparkSession, "mixing") as own:
        sizes = own.keep(sizes.withColumn("target", target).withColumn("kept", kept), "sources")
    # Two numbers; targets are summed as decimals, so that the order of the sum can't matter.
    total = sizes.agg(F.sum("bytes").alias("all"), F.sum(F.when(F.col("bytes") > 0, F.col("target"))).cast("double").alias("sum")).first()
    rate = F.col("target").cast("double") / F.lit(total["sum"] or 1.0) * F.lit(float(total["all"] or 0)) / F.col("bytes")
    return sizes.select("source", "bytes", F.when(F.col("bytes") > 0, rate).when(~F.col("kept"), F.lit(0.0)).alias("rate"))


def inverse(rate: Column) -> Column:
    """The distribution's cumulative probabilities, as many as can lie below a number under 1."""
    most = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(24.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["all"])


def _copies(u: Column, below: Column) -> Column:
    """The Poisson number of a row's uniform number and its source's table; 1 without a table."""

    def at(u: Column) -> Column:
        return F.size(F.filter(below["c"], lambda c: c < u))

    # 2 ** 53 * u is a whole number.
    own = (u * F.lit(float(1 << 53))).cast("long").cast("string")
    more = F.transform(F.sequence(F.lit(1), below["parts"] - 1), lambda k: uniform(own, k.cast("string"), F.lit("part")))
    number = at(u) + F.when(below["parts"] > 1, F.aggregate(more, F.lit(0), lambda s, v: s + at(v))).otherwise(F.lit(0))
    return F.when(below["c"].isNull(), F.lit(1)).otherwise(number)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, and _copy (from 1), _copies and _order, shuffled by _order."""
    copy, copies, order = names(docs.columns)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(MOST_RATE)), F.lit(1)).cast("int")
    table = F.struct(parts.alias("parts"), F.when(F.col("rate").isNotNull(), inverse(F.col("rate") / parts)).alias("c"))
    below = rates(docs, weights, power, source_col, text_col).select("source", table.alias("below"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # The numbers are hashed before the join, so that the text isn't read again after it; the row is one column, so no name clashes.
    digest = F.md5(text.cast("binary"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source_col).cast("string").alias("of"), F.concat_ws(":", key, digest).alias("key"), uniform(F.lit(str(seed)), key, digest).alias("u"))
    met = rows.join(below, F.col("of").eqNullSafe(F.col("source"))).select("row", "key", _copies(F.col("u"), F.col("below")).alias("copies"))
    each = met.where(F.col("copies") > 0).select("row", "key", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("copy").cast("string"), F.lit("order")).cast("binary")), 1, 15)
    mixed = each.select("row.*", F.col("copies").alias(copies), F.col("copy").alias(copy), F.conv(digits, 16, 10).cast("long").alias(order))
    return mixed.repartition(order).sortWithinPartitions(order)
