"""Mixing sources to target weights by Pfair scheduling, in DataFrame expressions only.

The rows of each source are dealt into blocks. With integer weights p over a granularity D (their sum),
block i of a source is released at slot floor(i * D / p) and due by slot ceil((i + 1) * D / p); in each
slot the released block with the earliest deadline goes next, so every source is always less than one
block away from its share (Baruah et al. 1996). The schedule repeats after D slots: one period is
simulated, and block i of a source takes slot (i div p) * D + slot_of(i mod p). A source that has no
blocks left leaves its slots empty; no row is dropped or repeated.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import save

#: Slots of a period, which is also the sum of the integer weights.
GRANULARITY = 1000
#: Rows of a block.
BLOCK = 64
#: Rows that one window of the row numbering holds on average at most.
WINDOW_ROWS = 20_000


def source_key(column: str = "source") -> Column:
    """The source as a key: a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("null"))


def root_weights(sizes: DataFrame, granularity: int = GRANULARITY) -> DataFrame:
    """Integer weights (source, p) in proportion to the square root of n, by largest remainders, at least 1 each, with sum `granularity`.

    The few sources' rows are numbered in one window: a table of at most `granularity` rows.
    """
    root = F.floor(F.sqrt(F.col("n").cast("double"))).cast("long")
    rows = sizes.select("source", F.greatest(root, F.lit(1).cast("long")).alias("q"))
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("q").over(every)).withColumn("k", F.count("*").over(every))
    spare = F.lit(granularity).cast("long") - F.col("k")
    rows = rows.withColumn("whole", F.col("q") * spare).withColumn("p0", F.expr("whole div total")).withColumn("rest", F.expr("whole % total"))
    rank = F.row_number().over(every.orderBy(F.desc("rest"), "source"))
    left = spare - F.sum("p0").over(every)
    return rows.withColumn("rank", rank).withColumn("left", left).select("source", (1 + F.col("p0") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("int").alias("p"))


def given_weights(sizes: DataFrame, targets: Mapping[str | None, float], granularity: int = GRANULARITY) -> DataFrame:
    """Integer weights (source, p) from target weights by source name; every source needs a positive one."""
    rows = [r.source for r in sizes.select("source").collect()]
    names = {("null" if k is None else f"={k}"): float(v) for k, v in targets.items()}
    if missing := [s for s in rows if names.get(s, 0) <= 0]:
        raise ValueError(f"sources without a positive weight: {missing[:5]}")
    total, spare = sum(names[s] for s in rows), granularity - len(rows)
    exact = {s: names[s] / total * spare for s in rows}
    p = {s: 1 + int(exact[s]) for s in rows}
    for s in sorted(rows, key=lambda s: (-(exact[s] % 1), s))[: granularity - sum(p.values())]:
        p[s] += 1
    return sizes.sparkSession.createDataFrame(sorted(p.items()), "source string, p int")


def period(weights: DataFrame) -> DataFrame:
    """One period of the schedule: (source, p, total, idx, slot, release, deadline), a row per slot.

    Earliest deadline first among released blocks, ties by source; an aggregate over the slots whose state
    is each source's number of blocks so far. Bounded by the granularity, which is at least the number of sources.
    """
    rows = weights.agg(F.sort_array(F.collect_list(F.struct("source", "p"))).alias("s"), F.sum("p").cast("int").alias("total"))

    def step(a: Column, t: Column) -> Column:
        ready = F.transform(
            F.col("s"),
            lambda x, i: F.when(
                F.get(a["done"], i).cast("long") * F.col("total") < (t + 1).cast("long") * x["p"],  # floor(c * D / p) <= t
                F.struct(F.floor(((F.get(a["done"], i) + 1).cast("long") * F.col("total") + x["p"] - 1) / x["p"]).alias("due"), i.alias("i")),
            ),
        )
        chosen = F.array_min(ready)
        done = F.transform(a["done"], lambda n, i: n + F.when(i == chosen["i"], 1).otherwise(0))
        return F.struct(done.alias("done"), F.concat(a["order"], F.array(chosen["i"])).alias("order"))

    start = F.struct(F.transform("s", lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0), F.col("total") - 1), start, step, lambda a: a["order"])
    slots = rows.where("total > 0").select("s", "total", F.posexplode(order).alias("slot", "i"))
    slots = slots.select(F.get("s", "i").alias("x"), "total", "slot").select("x.source", "x.p", "total", "slot")
    idx = F.row_number().over(Window.partitionBy("source").orderBy("slot")) - 1
    return slots.withColumn("idx", idx)


def numbered(docs: DataFrame, rows: int) -> DataFrame:
    """The documents with src (source key) and n: their rank, from 0, by digest of their id within their source.

    Ranks come in two levels so that a large source is spread over many windows: digests are dealt to
    buckets by their first hexadecimal digits, as many as the number of rows asks for.
    """
    digits = 0
    while rows > WINDOW_ROWS * 16**digits and digits < 8:
        digits += 1
    whole = F.xxhash64(*(F.col(c) for c in docs.columns)).cast("string")  # rows without an id go by what they hold
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), whole)).cast("binary"))
    keyed = docs.withColumn("src", source_key()).withColumn("_o", order).withColumn("_b", F.substring("_o", 1, digits) if digits else F.lit(""))
    ties = [F.col(c) for c in ("text",) if c in docs.columns]
    inner = F.row_number().over(Window.partitionBy("src", "_b").orderBy("_o", *ties)) - 1
    sizes = keyed.groupBy("src", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("src").alias("_s"), F.col("_b").alias("_c"), before.alias("_before"))
    return keyed.withColumn("_r", inner).join(offsets, (F.col("src") == F.col("_s")) & (F.col("_b") == F.col("_c"))).withColumn("n", F.col("_r") + F.col("_before")).drop("_o", "_b", "_r", "_s", "_c", "_before")


def mix(docs: DataFrame, targets: Mapping[str | None, float] | None = None, granularity: int = GRANULARITY, block: int = BLOCK) -> DataFrame:
    """The documents, all columns kept, with block, release, deadline, slot and position; the mixed order is by position.

    docs: doc_id, source. block: the number, from 0, of the row's block in its source; release, deadline
    and slot are the block's; position = slot * block size + the row's place in its block. Within a
    source rows go by the MD5 digest of their doc_id (then by text). Weights come from `targets` or, without, go
    with the square roots of the sources' sizes. Every row is returned once; an empty table gives an
    empty one; a null source counts as a source; rows without a doc_id go by a hash of the whole row. Input columns of these
    names are replaced. With more than half as many sources as `granularity` the period has two slots for each source;
    making it takes time in the square of the number of sources (bounded by their number, not by the rows).
    """
    made = ("block", "release", "deadline", "slot", "position")
    docs = docs.drop(*made, "src", "n")
    sizes = save(docs.groupBy(source_key().alias("source")).agg(F.count("*").alias("n")), "mix-sizes")
    k, total = sizes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    granularity = max(granularity, 2 * k)
    weights = root_weights(sizes, granularity) if targets is None else given_weights(sizes, targets, granularity)
    plan = save(period(save(weights, "mix-weights")), "mix-period").withColumnRenamed("source", "of")
    rows = numbered(docs, total).withColumn("block", F.expr(f"n div {int(block)}"))
    ps = plan.groupBy(F.col("of").alias("ps")).agg(F.first("p").alias("p"), F.first("total").alias("total"))
    rows = rows.join(F.broadcast(ps), F.col("src") == F.col("ps")).withColumn("idx2", F.expr("cast(block % p as int)"))
    slots = plan.select("of", F.col("idx").alias("idx3"), F.col("slot").alias("in_period"))
    rows = rows.join(F.broadcast(slots), (F.col("src") == F.col("of")) & (F.col("idx2") == F.col("idx3")))
    rows = rows.withColumn("slot", F.expr("(block div p) * total + in_period"))
    rows = rows.withColumn("release", F.expr("block * total div p")).withColumn("deadline", F.expr("((block + 1) * total + p - 1) div p"))
    rows = rows.withColumn("position", F.expr(f"slot * {int(block)} + n % {int(block)}"))
    return rows.select(*docs.columns, *made)
