"""Mix sources to target weights, block by block, with DataFrame functions only.

Each source's documents, in a fixed pseudorandom order, form one stream of words, which is cut into
blocks of equal length. A source's target in words is its weight's share of all words, at most
``most`` times its own words; what it cannot take is shared among the others by weight. The mix is a
row of slots, each taking one block; output shards are runs of slots. Every slot of a shard draws its
source by the sources' shares of all slots, so a shard's source counts are a multinomial draw. A
source's slots are numbered over the shards; slots beyond its own total, which come late, go to the
sources that were drawn too seldom, so that every source gets exactly its total. A source's n-th slot
takes block n of a pseudorandom permutation of that source's blocks, a new one for every pass over
the source. Slots and blocks meet by block index, and what a document gives is summed over its slots.

Defined results: a null text has no words; a null source is a source of its own and comes last;
sources without words get no target; rows that repeat a doc_id count as documents of their own
in the mixed table and are summed in the report; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulcast.llm.common import SPACE, stage, word_count

WEIGHTS = (5, 2, 1)
MOST = 3  # times its own words that a source gives at most
BLOCK = 128  # words
SHARD = 1024  # slots of an output shard
CELLS = 4096  # parts of the slots' share line in which a draw is looked up
TASK_SLOTS = 1 << 18  # slots that one task places
SHARD_RUN = 1024  # shards whose running counts one task computes
GROUP_DOCS = 50_000  # documents whose running sums one task computes
ROUNDS = 14
ROW = ["u", "v", "nth"]


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """Image of ``x`` under a pseudorandom permutation of 0 .. n-1 (swap-or-not rounds)."""

    def swap(at, turn):
        partner = F.pmod(F.pmod(F.xxhash64(seed, turn), n) - at + n, n)
        return F.when(F.pmod(F.xxhash64(seed, turn, F.greatest(at, partner)), F.lit(2)) == 0, at).otherwise(partner)

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), x.cast("long"), swap)


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): one row per source of a table with source and size.

    Sources are taken in code-point order; the windows below see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    # sources that reach their limit are those with the smallest limit per weight
    by_limit = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything).cast("double")
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    totals = totals.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    share = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    target = F.coalesce(F.least(F.col("most"), share * F.col("weight")), F.col("most"))
    return totals.select("source", "source_size", target.alias("target"))


def _prepared(docs: DataFrame) -> DataFrame:
    """(u, v, nth, doc_id, source, size): every row under an identity that a second read gives again.

    u and v hash the row's key, source and text; nth tells apart rows that agree in all of them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size"), *_identity())
    return stage(rows.withColumn("nth", F.row_number().over(Window.partitionBy("u", "v").orderBy("size"))))


def _identity() -> list[Column]:
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("text")]
    return [F.xxhash64(*fields).alias("u"), F.hash(*fields).alias("v")]


def _streams(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with ``begin``: words of the same source before the document.

    Sums run inside groups of documents and over one row per group, so a source of any share of the
    rows is worked by many tasks.
    """
    groups = 8 * (rows.count() // GROUP_DOCS + 1)
    rows = rows.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "u"), F.lit(groups)))
    sums = rows.groupBy("source", "group").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("group").alias("g"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "group").orderBy(F.xxhash64(F.lit(seed + 1), "u"), "u", "v", "nth")
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("group") == F.col("g")))
    return joined.select(*ROW, "source", "size", (F.col("base") + F.col("upto") - F.col("size")).alias("begin"))


def _source_slots(targets: DataFrame, block: int) -> DataFrame:
    """Per source: number, blocks, whole passes, words of the last pass (rest), slots it takes, and those of the sources up to it."""
    named = targets.withColumn("blocks", F.ceil(F.col("source_size") / block))
    # whole passes over the source, then blocks up to the rest of the target
    named = named.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    named = named.withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))
    named = named.withColumn("takes", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return stage(named.withColumn("upto", F.sum("takes").over(order)).withColumn("number", F.row_number().over(order)))


def shard_counts(sources: DataFrame, total: int, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """(shard, number, n): the sources that the slots of every output shard draw, counted.

    A slot draws a place on a line on which every source has a stretch as long as the slots it takes;
    the line's cells name the sources that reach into them.
    """
    spark = sources.sparkSession
    cell = max(1, -(-total // CELLS))
    stretch = sources.filter("takes > 0").select("number", (F.col("upto") - F.col("takes")).alias("from"), "upto")
    stretch = stretch.withColumn("cell", F.explode(F.expr(f"sequence(`from` div {cell}, (upto - 1) div {cell})")))
    tasks = max(1, -(-total // TASK_SLOTS))
    drawn = spark.range(0, total, 1, tasks).select(F.expr(f"id div {shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 3), "id"), F.lit(max(1, total)).cast("long")).alias("at"))
    drawn = drawn.withColumn("cell", F.expr(f"at div {cell}")).join(stage(stretch), "cell").filter("at >= `from` and at < upto")
    return stage(drawn.groupBy("shard", "number").agg(F.count("*").alias("n")))


def _numbered(counts: DataFrame) -> DataFrame:
    """``counts`` with ``base``: the slots of the same source in earlier shards, by runs of shards."""
    run = F.expr(f"shard div {SHARD_RUN}").alias("run")
    sums = counts.groupBy("number", run).agg(F.sum("n").alias("in_run"))
    before = Window.partitionBy("number").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("number", "run", F.coalesce(F.sum("in_run").over(before), F.lit(0)).alias("runs_before"))
    inside = Window.partitionBy("number", "run").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.withColumn("run", run).withColumn("shards_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return rows.join(sums, ["number", "run"]).select("shard", "number", "n", (F.col("runs_before") + F.col("shards_before")).alias("base"))


def slots(targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 17) -> DataFrame:
    """(shard, slot, source, pass, index, words): every slot of the mix and the block it takes, as a written table.

    A slot takes ``words`` words of its block; only a source's last slot takes less than the block.
    """
    sources = _source_slots(targets, block)
    total = sources.agg(F.max("upto")).first()[0] or 0
    counts = stage(_numbered(shard_counts(sources, total, shard, seed)).join(sources.select("number", "takes"), "number"))
    own = counts.withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("takes") - F.col("base"))))
    # slots beyond a source's total: in the order of a draw's spread, few against all slots
    late = own.filter("n > own").select("shard", F.expr("n - own").alias("n"), F.col("number").alias("drew"))
    order = Window.orderBy("shard", "drew")
    late = late.withColumn("upto", F.sum("n").over(order)).select("shard", F.explode(F.expr("sequence(upto - n, upto - 1)")).alias("at"))
    drawn = counts.groupBy("number").agg(F.sum("n").alias("drawn"))
    short = sources.join(drawn, "number", "left").withColumn("first", F.coalesce("drawn", F.lit(0))).withColumn("n", F.col("takes") - F.col("first")).filter("n > 0")
    short = short.withColumn("upto", F.sum("n").over(Window.orderBy("number")))
    short = short.select("number", F.expr("posexplode(sequence(upto - n, upto - 1))").alias("k", "at"), "first").select("number", "at", (F.col("first") + F.col("k")).alias("nth"))
    moved = late.join(short, "at").select("shard", "number", F.lit(1).cast("long").alias("n"), F.col("nth").cast("long").alias("base"))
    placed = stage(own.filter("own > 0").select("shard", "number", F.col("own").alias("n"), "base").unionByName(moved))
    # a shard's slots: its sources' runs one after another, dealt out by a permutation
    before = Window.partitionBy("shard").orderBy("number", "base")
    placed = placed.withColumn("upto", F.sum("n").over(before)).withColumn("size", F.sum("n").over(Window.partitionBy("shard")))
    tasks = max(1, -(-total // TASK_SLOTS))
    each = placed.repartition(tasks, "shard").select("*", F.posexplode(F.expr("sequence(upto - n, upto - 1)")).alias("k", "inside"))
    each = each.withColumn("nth", F.col("base") + F.col("k")).join(sources.select("number", "source", "blocks", "passes", "rest"), "number")
    each = each.withColumn("pass", F.expr("nth div blocks")).withColumn("in_pass", F.col("nth") % F.col("blocks"))
    index = permuted(F.col("in_pass"), F.col("blocks"), F.xxhash64(F.lit(seed), "number", "pass"))
    words = F.when(F.col("pass") < F.col("passes"), block).otherwise(F.least(F.lit(block), F.col("rest") - F.col("in_pass") * block))
    slot = F.col("shard") * shard + permuted(F.col("inside"), F.col("size"), F.xxhash64(F.lit(seed + 2), "shard"))
    # written, so that the planner knows its size when the blocks are joined
    return stage(each.select("shard", slot.alias("slot"), "source", "pass", index.alias("index"), words.cast("long").alias("words")))


def _pieces(streams: DataFrame, drawn: DataFrame, block: int) -> DataFrame:
    """Word ranges [low, high) of documents that the drawn blocks take, with the draws' other columns."""
    spread = streams.filter("size > 0").withColumn("index", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})")))
    drawn = drawn.withColumnRenamed("source", "s").withColumnRenamed("index", "i")
    met = spread.join(drawn, F.col("source").eqNullSafe(F.col("s")) & (F.col("index") == F.col("i")))
    start = F.col("index") * block
    met = met.withColumn("low", F.greatest(start - F.col("begin"), F.lit(0)))
    return met.withColumn("high", F.least(start + F.col("words") - F.col("begin"), F.col("size"))).filter("high > low")


def mix_report(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_shard.

    ``taken`` and ``first_shard`` come from the slots that the document's blocks went to.
    """
    rows = _prepared(docs)
    targets = stage(source_targets(rows, weights, most))
    pieces = _pieces(_streams(rows, seed), slots(targets, block, seed=seed), block)
    taken = pieces.groupBy(*ROW).agg(F.sum(F.col("high") - F.col("low")).alias("taken"), F.min("shard").alias("first_shard"))
    out = rows.join(taken, ROW, "left").join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mix as rows of ``docs``: a document taken whole n times gives n equal rows; parts taken
    besides give one more row whose text is those words, in order, and whose n_chars is its length."""
    rows = _prepared(docs)
    targets = stage(source_targets(rows, weights, most))
    pieces = _pieces(_streams(rows, seed), slots(targets, block, seed=seed), block)
    passes = pieces.groupBy(*ROW, "size", "pass").agg(
        F.sum(F.col("high") - F.col("low")).alias("words"), F.collect_list(F.struct("low", "high")).alias("ranges")
    )
    whole = F.col("words") == F.col("size")
    takes = passes.groupBy(*ROW).agg(
        F.count(F.when(whole, 1)).cast("int").alias("copies"), F.sort_array(F.flatten(F.collect_list(F.when(~whole, F.col("ranges"))))).alias("ranges")
    )
    takes = stage(takes)
    row = docs.select(F.struct("*").alias("row"), *_identity())
    if rows.filter("nth > 1").isEmpty():
        met = row.join(takes.drop("nth"), ["u", "v"])
    else:
        nth = F.row_number().over(Window.partitionBy("u", "v").orderBy("u"))
        met = row.withColumn("nth", nth).join(takes, ROW)
    # the row meets its takes once; its copies and the row of its parts come from there
    met = met.withColumn("n", F.explode(F.expr("sequence(1, copies + cast(size(ranges) > 0 as int))")))
    words = F.filter(F.split("row.text", f"{SPACE}+"), lambda w: w != "")
    taken = F.transform("ranges", lambda r: F.slice(words, (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")))
    part = F.when(F.col("n") > F.col("copies"), F.concat_ws(" ", F.flatten(taken)))
    met = met.withColumn("part", part)
    new = {"text": F.coalesce("part", "row.text"), "n_chars": F.when(F.col("part").isNotNull(), F.length("part").cast("long")).otherwise(F.col("row.n_chars"))}
    return met.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
