"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions only.

Each document of a source should be taken target / source size times.  The whole part is certain; the fraction is
rounded by the pivotal method: two documents with fractional copies exchange mass (words), in a random direction that
keeps both expectations, until one of them is integral; the other goes on to the next.  The words of a pair stay what
they were.  Pairs are met in a reduction tree: documents fall by hash into chunks of about FAN_IN, a chunk folds to one
document that is still fractional, and these fold again, level by level, until one is left for each source.  It goes to
its nearer side, and what that adds or leaves is settled by KEPT of the source's documents (by hash, at most a quarter of
them), which stay out of the tree: the largest that still fits is taken, again and again.  So a source ends within half
of one of its smaller documents of its target, if the kept ones hold as many words as half of the last one.  All draws
are hashes of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.names import unused
from newsloom.tables import ensure_checkpoints

#: Weights that repeat over the sources in order; all targets together and each one's most, as parts of the sizes.
WEIGHTS, SHARE, MOST, SEED = (3, 1, 2), 1.5, 2.0, 11
#: Mean number of documents in a chunk of the reduction tree, and those of a source that settle the rest.
FAN_IN, KEPT = 48, 16


def word_count(text: Column) -> Column:
    """Words (runs of characters other than blank and tab to carriage return) of a whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Targets share ``share`` times all sizes by weight; one that would pass ``most`` times its source's size stops there
    and the excess is shared again.  That is the level L with sum(min(most * size, L * weight)) = total; sources sorted
    by most * size / weight reach their stop in this order, so running sums find L.  The windows run over one row a
    source.  A table without words has targets of zero.
    """
    k = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(k)) + 1).cast("int")).cast("double")
    stop = (F.col("source_size") * F.lit(most)).alias("stop")
    table = sizes.select("source", "source_size", weight.alias("weight"), stop)
    everything = Window.partitionBy()
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    table = table.withColumn("stopped", F.coalesce(F.sum("stop").over(by_stop), F.lit(0.0)))
    table = table.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_stop), F.lit(0.0)))
    # the level if this source were the first that does not stop; of those that do not pass their stop, the first has
    # the highest, as taking more sources as stopped takes more than their share
    table = table.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("stop")
    table = table.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything))
    target = F.least(F.col("stop"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop")))
    return table.select("source", "source_size", target.alias("target"))


def _draw(*what: str) -> str:
    return f"(pmod(xxhash64({', '.join(what)}), 1099511627776L) / 1099511627776D)"


def _fold(units: DataFrame, level: int, id_type: str, seed: int) -> DataFrame:
    """Fold each chunk (source, chunk, list of units): its settled units and the one that is carried on."""
    unit, settled = f"struct<id:{id_type},w:bigint,m:double>", f"array<struct<id:{id_type},up:boolean>>"
    u = _draw(f"{seed}", f"{level}", "c.carry.id", "x.id")
    # words that i can still take from j, and give to j
    up, down = "least(c.carry.w - c.carry.m, x.m)", "least(c.carry.m, x.w - x.m)"
    goes_up = f"{u} * ({up} + {down}) < {down}"
    done = lambda who, flag: f"concat(c.settled, array(named_struct('id', {who}.id, 'up', {flag})))"
    state = lambda out, who, m: f"named_struct('settled', {out}, 'carry', named_struct('id', {who}.id, 'w', {who}.w, 'm', {m}))"
    i, j = "c.carry", "x"
    step = f"""CASE
        WHEN c.carry IS NULL THEN {state('c.settled', j, 'x.m')}
        WHEN {goes_up} AND c.carry.w - c.carry.m <= x.m THEN {state(done(i, 'true'), j, 'x.m - (c.carry.w - c.carry.m)')}
        WHEN {goes_up} THEN {state(done(j, 'false'), i, 'c.carry.m + x.m')}
        WHEN c.carry.m <= x.w - x.m THEN {state(done(i, 'false'), j, 'x.m + c.carry.m')}
        ELSE {state(done(j, 'true'), i, 'c.carry.m - (x.w - x.m)')} END"""
    out = f"struct<settled:{settled},carry:{unit}>"
    fold = f"aggregate(units, cast(named_struct('settled', array(), 'carry', NULL) AS {out}), (c, x) -> cast({step} AS {out}))"
    chunks = units.groupBy("source", "chunk").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("by_size"), "id", "w", "m"))).alias("units"))
    return chunks.select("source", F.expr(fold).alias("f")).select("source", "f.settled", "f.carry")


def _settled(carried: DataFrame, kept: DataFrame, id_type: str) -> DataFrame:
    """(source, id, up) for the last document of each source and its kept ones (source, id, w, m), at most KEPT.

    The last one goes to its nearer side, or to the other if only that can be made up for.  Then the kept ones are taken
    from the largest to the smallest as long as they fit into the words that are due, and the smallest that is left if it
    brings them nearer.
    """
    units = kept.groupBy(F.col("source").alias("_s")).agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("by_size"), "id", "w"))).alias("units"), F.sum("w").alias("all"), F.sum("m").alias("due"))
    last = carried.select("source", F.struct("id", "w", "m").alias("last"))
    both = last.join(units, F.col("source").eqNullSafe(F.col("_s")), "full_outer").select(F.expr("CASE WHEN last IS NULL THEN _s ELSE source END AS source"), "last", "units", F.expr("coalesce(all, 0)").alias("all"), F.expr("coalesce(due, 0)").alias("due"))
    near = F.expr("2 * last.m >= last.w")
    up_fits, down_fits = F.expr("due + last.m - last.w >= 0"), F.expr("due + last.m <= all")
    both = both.withColumn("up", F.when(F.col("last").isNull(), F.lit(None)).when(near, up_fits | ~down_fits).otherwise(~down_fits & up_fits))
    both = both.withColumn("due", F.expr("due + CASE WHEN last IS NULL THEN 0 WHEN up THEN last.m - last.w ELSE last.m END"))
    state = f"struct<due:double,taken:array<struct<id:{id_type},up:boolean>>>"
    take = "cast(named_struct('due', c.due - CASE WHEN x.w <= c.due THEN x.w ELSE 0 END, 'taken', concat(c.taken, array(named_struct('id', x.id, 'up', x.w <= c.due)))) AS " + state + ")"
    both = both.withColumn("f", F.expr(f"aggregate(coalesce(units, array()), cast(named_struct('due', due, 'taken', array()) AS {state}), (c, x) -> {take})"))
    # the smallest document that was not taken
    places = "filter(sequence(1, greatest(size(f.taken), 1)), i -> NOT coalesce(try_element_at(f.taken, i).up, true))"
    one = F.expr(f"try_element_at({places}, -1)").alias("one")
    both = both.select("source", "last", "up", "units", "f", one)
    more = "i + 1 = one AND 2 * f.due >= element_at(units, one).w"
    done = F.expr(f"transform(f.taken, (t, i) -> named_struct('id', t.id, 'up', t.up OR coalesce({more}, false)))")
    first = F.expr(f"CASE WHEN last IS NULL THEN cast(array() AS array<struct<id:{id_type},up:boolean>>) ELSE array(named_struct('id', last.id, 'up', up)) END")
    return both.select("source", F.explode(F.concat(first, done)).alias("d")).select("source", "d.id", "d.up")


def rounded_copies(sized: DataFrame, id_type: str, seed: int = SEED, fan_in: int = FAN_IN, **shares) -> DataFrame:
    """(source, id, source_size, target, copies) for each distinct (source, id) of ``sized`` (source, id, size).

    Rows with the same source and id are one unit of their summed size.
    """
    units = sized.groupBy("source", "id").agg(F.sum("size").alias("w")).checkpoint()
    counts = units.groupBy("source").agg(F.sum("w").alias("source_size"), F.count("*").alias("n_units"), F.count_if(F.col("w") > 0).alias("n_worded"))
    # some documents of each source, a top-k that is cut before the shuffle; the last one tells them from the rest
    place = F.xxhash64(F.lit(seed), F.lit("kept"), F.col("id"))
    least = units.where("w > 0").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(place, "id"))).where(F.col("k") <= KEPT)
    of = counts.select(F.col("source").alias("_s"), "n_units", "n_worded")
    least = least.join(of, F.col("source").eqNullSafe(F.col("_s"))).where("k <= n_worded div 4").groupBy(F.col("source").alias("_l")).agg(F.max(F.struct(place.alias("place"), "id")).alias("last"))
    targets = source_targets(counts.select("source", "source_size"), **shares).join(of.drop("n_worded"), F.col("source").eqNullSafe(F.col("_s"))).join(least, F.col("source").eqNullSafe(F.col("_l")), "left").drop("_s", "_l").checkpoint()
    at_source = F.col("source").eqNullSafe(F.col("_source"))
    parted = units.join(F.broadcast(targets.withColumnRenamed("source", "_source")) if targets.count() <= 10_000 else targets.withColumnRenamed("source", "_source"), at_source).drop("_source")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    parted = parted.withColumn("whole", F.floor(share)).withColumn("m", (share - F.floor(share)) * F.col("w"))
    chunk = lambda n, level: F.pmod(F.xxhash64(F.lit(seed), F.lit(level), F.col("id")), F.greatest(F.ceil(n / F.lit(fan_in)), F.lit(1)))
    kept = F.coalesce(F.struct(place.alias("place"), "id") <= F.col("last"), F.lit(False))
    now = parted.where(F.expr("w > 0 and m > 0") & ~kept).select("source", "id", "w", "m", chunk(F.col("n_units"), 0).alias("chunk"))
    most = targets.agg(F.max("n_units")).first()[0] or 0
    decided, level = None, 0
    while True:
        folded = _fold(now, level, id_type, seed).checkpoint()
        settled = folded.select("source", F.explode("settled").alias("d")).select("source", "d.id", "d.up")
        decided = settled if decided is None else decided.unionByName(settled)
        carried = folded.where("carry is not null").select("source", "carry.*")
        if most <= fan_in:  # every source was a single chunk
            break
        level, most = level + 1, -(-most // fan_in)
        per = carried.groupBy(F.col("source").alias("_source")).agg(F.count("*").alias("_n"))
        now = carried.join(per, at_source).select("source", "id", "w", "m", chunk(F.col("_n"), level).alias("chunk"))
    final = _settled(carried, parted.where(F.expr("w > 0 and m > 0") & kept).select("source", "id", "w", "m"), id_type)
    decided = decided.unionByName(final).withColumnsRenamed({"source": "_source", "id": "_id"})
    out = parted.join(decided, at_source & F.col("id").eqNullSafe(F.col("_id")), "left")
    return out.select("source", "id", "source_size", "target", (F.col("whole") + F.coalesce(F.col("up").cast("long"), F.lit(0))).alias("copies"))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    ensure_checkpoints(docs.sparkSession)
    return docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size")).checkpoint()


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies, taken (size * copies).

    Texts are read once and never shuffled; ids and sizes are.  A source with most of the rows is many chunks, so no
    task holds a source.  The same input gives the same rows, however it is partitioned.

    Null text has size 0 and is never taken; a null source is a source of its own, last in order; null ids are a unit
    like any other; rows with the same source and id are taken alike; an empty table gives no rows.
    """
    sized = _sized(docs, id_col, source_col, text_col)
    copies = rounded_copies(sized, docs.schema[id_col].dataType.simpleString(), **options).withColumnsRenamed({"source": "_source", "id": "_id"})
    out = sized.join(copies, F.col("source").eqNullSafe(F.col("_source")) & F.col("id").eqNullSafe(F.col("_id")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each repeated as often as it is taken.

    Null texts are never taken; null sources, null and repeated ids and empty tables are as in ``mix_plan``; other
    columns pass through under any name.
    """
    of_source, of_id, times = unused(docs, "_source", "_id", "_copies")
    sized = _sized(docs, id_col, source_col, text_col)
    copies = rounded_copies(sized, docs.schema[id_col].dataType.simpleString(), **options)
    copies = copies.where("copies > 0").select(F.col("source").alias(of_source), F.col("id").alias(of_id), F.col("copies").alias(times))
    out = docs.join(copies, F.col(source_col).eqNullSafe(F.col(of_source)) & F.col(id_col).eqNullSafe(F.col(of_id)))
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).drop(of_source, of_id, times)
