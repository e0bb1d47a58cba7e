"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. The sizes (words) of all documents are shared out by weight; a source stops
   at `epochs` times its size and its excess goes to the others, which is one
   water level over the sources.
2. Slots k = 0, 1, ... of `block` words each get the golden-ratio point
   frac(k / phi) (on a grid of 2**31, where the sequence is a permutation). The
   point falls in one interval of the cumulative targets: that source's slot.
3. Slots are ranked within their source: counts of chunks of 65536 slots are
   summed up first, so no task ranks more than a chunk.
4. Each source's documents, shuffled by md5 of their id, make a stream of
   words, cut into blocks. The slot of rank r takes block r modulo the number
   of blocks. A document's take is the words of it in the blocks taken.

DataFrame operations only; only ids, sources and sizes are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voicegauge.llm._store import Store

GRID, STEP = 1 << 31, 1327217885  # STEP is the odd number nearest to GRID / phi
CHUNK, CELLS, BUCKET_DIGITS = 65536, 4096, 3


def targets(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size); sources by code point, null last, take the weights in turn.

    One window over the sources, of which there are far fewer than documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    done = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(done), F.lit(0))).cast("double"))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(done), F.lit(0))))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, block: int = 64) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    taken: words that the mix takes of the document, repeats counted; never
    over `epochs` times its size. A source's sum of them differs from its
    target by a few blocks. Reruns give the same mix.

    Null and blank texts have size 0 and nothing taken. A null source is a
    source of its own, the last one. A null doc_id takes its place in the
    shuffle like any other; rows with equal ids are each kept, in order of
    size. Columns with clashing names are ignored. Empty table: empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, "mixing")
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    sized = store.keep(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(source).cast("string").alias("source"), words.alias("size")))
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("src", F.row_number().over(by_name)).withColumn("hi", F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("source_size").over(Window.partitionBy())
    plan = store.keep(plan.withColumn("total", total).withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0.0)) / total).withColumn("hi", F.col("hi") / total).withColumn("blocks", F.ceil(F.col("source_size") / block)))
    words_in_all = (plan.agg(F.max("total")).first()[0]) or 0

    point = (F.col("id") % GRID) * STEP % GRID / float(GRID)
    slots = spark.range(-(-words_in_all // block)).select(F.col("id").alias("k"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    some = plan.where("target > 0")
    last = F.max("hi").over(Window.partitionBy())
    some = some.withColumn("hi", F.when(F.col("hi") == last, 1.0).otherwise(F.col("hi")))  # rounding must not leave a gap at 1
    grid = some.select("src", "lo", "hi", "blocks", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    slots = slots.join(grid, "cell").where("x >= lo and x < hi").select("src", "blocks", "k", F.floor(F.col("k") / CHUNK).alias("chunk"))
    counts = slots.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    counts = counts.select("src", "chunk", (F.sum("n").over(Window.partitionBy("src").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = slots.join(counts, ["src", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("src", "chunk").orderBy("k")) - 1)
    times = ranked.where(F.col("rank") < F.col("blocks") * epochs).groupBy("src", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))

    named = sized.join(plan.select(F.col("source").alias("named"), "src", "source_size", "target"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    key = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    named = named.withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    full = named.where("size > 0")
    sums = full.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.select("src", "bucket", (F.sum("n").over(Window.partitionBy("src").orderBy("bucket")) - F.col("n")).alias("before"))
    own = Window.partitionBy("src", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    stream = full.join(sums, ["src", "bucket"]).withColumn("at", F.col("before") + F.sum("size").over(own) - F.col("size"))
    pieces = stream.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    taken = pieces.withColumn("words", overlap).join(times, ["src", "block"], "left")
    taken = taken.groupBy("src", "at", "id", "size", "source_size", "target").agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    out = taken.select("id", "size", "source_size", "target", "taken").union(named.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixing_sql(weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, block: int = 64, docs: str = "documents") -> str:
    """The same in DuckDB's SQL, without the distributed ranks and sums."""
    case = " ".join(f"when {i} then {w}" for i, w in enumerate(weights))
    return f"""
    with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from {docs}),
    sources as (select source, sum(size)::bigint as source_size from sized group by source),
    weighed as (select *, (case (row_number() over (order by source nulls last) - 1) % {len(weights)} {case} end)::bigint as weight, source_size * {epochs} as cap from sources),
    levels as (select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
      from weighed window before as (order by cap::double / weight, source nulls last rows between unbounded preceding and 1 preceding)),
    chosen as (select arg_min(level, cap::double / weight) as level from levels where level * weight <= cap),
    plan as (select source, source_size, least(cap::double, coalesce((select level from chosen), 0.0) * weight) as target, row_number() over (order by source nulls last) as src,
      (select sum(size)::bigint from sized) as total, ceil(source_size / {block})::bigint as blocks from weighed),
    summed as (select *, sum(target) over (order by src rows unbounded preceding) as top from plan),
    ends as (select *, coalesce(lag(top) over (order by src), 0.0) / total as lo, case when top = (select max(top) from summed) then 1.0 else top / total end as hi from summed),
    slots as (select k, ((k % {GRID}) * {STEP} % {GRID}) / {GRID}::double as x from range(ceil((select sum(size) from sized) / {block})::bigint) r(k)),
    ranked as (select src, blocks, row_number() over (partition by src order by k) - 1 as rank from slots join ends on x >= lo and x < hi where target > 0),
    times as (select src, rank % blocks as block, count(*) as times from ranked where rank < blocks * {epochs} group by all),
    stream as (select s.*, src, source_size, target, sum(size) over (partition by src order by md5(coalesce(doc_id::varchar, '')), size rows unbounded preceding)::bigint - size as pos
      from sized s join plan p on s.source is not distinct from p.source),
    pieces as (select *, unnest(range(pos // {block}, (pos + size - 1) // {block} + 1)) as block from stream where size > 0)
    select doc_id, size, source_size, target, sum((least(pos + size, (p.block + 1) * {block}) - greatest(pos, p.block * {block})) * coalesce(times, 0))::bigint as taken
    from pieces p left join times t on p.src = t.src and p.block = t.block group by p.src, pos, doc_id, size, source_size, target
    union all select doc_id, size, source_size, target, 0 from stream where size = 0
    """
