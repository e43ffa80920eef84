"""Mixing sources to target weights by capped water-filling, in SQL functions only.

Sources share a budget of words by weight. A source is clamped at `most_epochs` times its size; what it can't take is
shared by the others by weight, until none is above its bound. Each source then takes whole repetitions of all its
documents, and for the fraction left those that come first in a seeded order, up to the document that brings the total
nearest to the target.

The seeded order is counted in histograms: hashes fall into bins of bounded width, and only the bin with the end of the
fraction is looked at row by row, so no source is one task. The hash is of doc_id and text; rows equal in both are taken
or left one by one in no particular order, always as many. A null source is one source, the last one. Null text has size 0; a source
without words has the target 0 and takes nothing. Extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellstream.llm.common import cut, packed, unpacked, written

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST_EPOCHS = 2.0
SEED = "mixture-1"
#: The seeded order is split into so many bins.
BINS = 1 << 16


def word_count(text: str) -> Column:
    """Runs of bytes that are no ASCII white space; null has none."""
    raw = F.col(text)
    return F.coalesce(F.regexp_count(raw, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget: float = BUDGET, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """sources (source, source_size, weight) with target: budget times all sizes, shared by weight under the bound of each source.

    A round clamps all sources that are above their bound. Two sums come to the driver in each.
    """
    state = sources.withColumn("bound", F.col("source_size") * most_epochs).withColumn("clamped", F.col("source_size") == 0)
    total = budget * (state.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        sums = state.agg(F.sum(F.when(F.col("clamped"), F.col("bound")).otherwise(0.0)).alias("bound"), F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        level = (total - (sums["bound"] or 0.0)) / sums["weight"] if sums["weight"] else 0.0
        target = F.when(F.col("clamped"), F.col("bound")).otherwise(F.col("weight") * F.lit(level))
        over = ~F.col("clamped") & (F.col("weight") * F.lit(level) > F.col("bound"))
        if not state.where(over).limit(1).count():
            return state.withColumn("target", target).drop("bound", "clamped")
        state = cut(state.withColumn("clamped", F.col("clamped") | over))


def weighted(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, source_size) with the weights in turn, sources by code point, null last.

    Sources are numbered slice by slice of their first two bytes, so that very many sources are no single task.
    """
    head = F.coalesce(F.substring(F.hex(F.col("source").cast("binary")), 1, 4), F.lit("g"))
    sizes = sizes.withColumn("head", head)
    counts = sizes.groupBy("head").agg(F.count("*").alias("n"))  # at most 65 793 rows
    before = counts.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("before"))
    order = Window.partitionBy("head").orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("own", F.row_number().over(order)).join(before, "head")
    turn = ((F.col("before") + F.col("own") - 1) % len(weights)).cast("int")
    return numbered.select("source", "source_size", F.array(*[F.lit(float(w)) for w in weights])[turn].alias("weight"))


def _fraction(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, bin, ...) histograms with the words before each bin, for sources whose target leaves a fraction."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bin")  # at most BINS rows each
    return bins.join(goals, bins["source"].eqNullSafe(goals["for_source"])).select("source", "bin", "words", (F.sum("words").over(order) - F.col("words")).alias("before"), "whole", "left", "target", "source_size")


def _some_of(rows: DataFrame) -> DataFrame:
    """Equal rows of each source with __part: whether a row is among the first part_rows of them. Rows are numbered task by task."""
    rows = written(rows.withColumn("__at", F.monotonically_increasing_id()))
    rows = rows.withColumns({"__task": F.shiftright("__at", 33), "__own": F.row_number().over(Window.partitionBy("__source", F.shiftright("__at", 33)).orderBy("__at"))})
    counts = rows.groupBy("__source", "__task").agg(F.count("*").alias("n"))
    order = Window.partitionBy("__source").orderBy("__task")  # as many as tasks
    before = counts.select(F.col("__source").alias("of"), F.col("__task").alias("task"), (F.sum("n").over(order) - F.col("n")).alias("earlier"))
    rows = rows.join(F.broadcast(before), rows["__source"].eqNullSafe(before["of"]) & (rows["__task"] == before["task"]))
    return rows.withColumn("__part", F.col("earlier") + F.col("__own") <= F.col("part_rows")).drop("__at", "__task", "__own", "of", "task", "earlier")


RESULTS = ["size", "source_size", "target", "repetitions", "taken"]


def mixed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """documents with size, source_size, target, repetitions (how often the mix takes the row) and taken (words).

    Columns of the input with one of these names are replaced; others may have any name.
    """
    return unpacked(_mixed(packed(documents), doc_id=f"row.`{doc_id}`", text=f"row.`{text}`", source=f"row.`{source}`", **options), *RESULTS)


def _mixed(documents: DataFrame, budget: float = BUDGET, most_epochs: float = MOST_EPOCHS, weights: tuple[float, ...] = WEIGHTS, seed: str = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """documents with size, source_size, target, repetitions (how often the mix takes the row) and taken (words).

    Columns of the input with one of these names are replaced.
    """
    results = ["size", "source_size", "target", "repetitions", "taken"]
    # the hash is of the row alone, so it can be made again anywhere; rows of the same key and text follow each other
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null"))).cast("binary"))
    rows = documents.withColumns({"size": word_count(text), "__hash": key}).withColumn("__bin", F.conv(F.substring("__hash", 1, 4), 16, 10).cast("int"))
    light = rows.select(F.col(source).alias("source"), "size", F.col("__hash").alias("hash"), F.col("__bin").alias("bin"))
    light = written(light)
    sizes = light.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(cut(weighted(sizes)), budget, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = cut(goals.select(F.col("source").alias("for_source"), "source_size", "target", "whole", "left"))
    # the bin in which the fraction ends, and in it the last hash that is taken
    ends = _fraction(light, goals).where("before <= left and left < before + words")
    ends = cut(ends.select(F.col("source").alias("for_source"), F.col("bin").alias("end_bin"), "before", "left"))
    inside = light.join(ends, light["source"].eqNullSafe(ends["for_source"]) & (light["bin"] == ends["end_bin"]))
    grouped = inside.groupBy("source", "hash").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("left").alias("left"))
    order = Window.partitionBy("source").orderBy("hash")  # one bin of BINS
    summed = grouped.withColumn("start", F.col("before") + F.sum("words").over(order) - F.col("words"))
    # a row is taken if more than half of it lies before the end: the nearest total; equal rows are taken up to a number
    some = F.floor((F.col("left") - F.col("start")) / (F.col("words") / F.col("n")) + 0.5)
    some = F.when(F.col("words") > 0, F.least(F.greatest(some, F.lit(0)), F.col("n"))).when(F.col("start") <= F.col("left"), F.col("n")).otherwise(0)
    counted = summed.select("source", "hash", "n", some.alias("some"))
    part = F.col("some").between(1, F.col("n") - 1)
    taken = counted.where("some > 0").groupBy("source").agg(F.max(F.when(F.col("some") == F.col("n"), F.col("hash"))).alias("last_hash"), F.max(F.when(part, F.col("hash"))).alias("part_hash"), F.max(F.when(part, F.col("some"))).alias("part_rows"))
    last = taken.select(F.col("source").alias("taken_source"), "last_hash", "part_hash", "part_rows")
    goals = goals.join(ends.select(F.col("for_source").alias("end_source"), "end_bin"), F.col("for_source").eqNullSafe(F.col("end_source")), "left")
    goals = cut(goals.join(last, F.col("for_source").eqNullSafe(F.col("taken_source")), "left").select("for_source", "source_size", "target", "whole", "left", "end_bin", "last_hash", "part_hash", "part_rows"))
    out = rows.join(goals.withColumnRenamed("for_source", "__source").withColumnRenamed("source_size", "__size").withColumnRenamed("target", "__target"), F.col(source).eqNullSafe(F.col("__source")))
    out = out.withColumn("__part", F.lit(False))
    if goals.where("part_hash is not null").limit(1).count():
        equal = F.coalesce(F.col("__hash") == F.col("part_hash"), F.lit(False))
        out = out.where(~equal).unionByName(_some_of(out.where(equal)))
    extra = F.when(F.col("__part"), F.lit(1)).when(F.col("end_bin").isNull(), F.lit(0)).when((F.col("__bin") < F.col("end_bin")) | ((F.col("__bin") == F.col("end_bin")) & (F.col("__hash") <= F.coalesce("last_hash", F.lit("")))), F.lit(1)).otherwise(F.lit(0))
    repetitions = (F.col("whole") + extra).cast("long")
    return out.select("row", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), repetitions.alias("repetitions"), (repetitions * F.col("size")).alias("taken"))


def summary(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixed(documents.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def repeated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken; the columns of documents as they were."""
    mix = _mixed(packed(documents), doc_id=f"row.`{doc_id}`", text=f"row.`{text}`", source=f"row.`{source}`", **options).where("repetitions > 0")
    return unpacked(mix.select("row", F.explode(F.sequence(F.lit(1), F.col("repetitions").cast("int")))))
