"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate of a host where it stands on at least `min_pages` of the
host's pages and on more than `ratio` of them. The counts are of distinct lines
a page, summed up per task before the shuffle. A host can have no more
boilerplate lines than its mean number of lines a page divided by the ratio.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _key(line: Column) -> Column:
    """128 bits of the line without the blanks around it."""
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("p"), F.xxhash64(F.lit("line"), line).alias("q"))


def _keys(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(_lines(text), lambda x: F.trim(x) != ""), _key))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, key) of the lines to drop."""
    rows = docs.select(F.col(host).alias("host"), _keys(F.col(text)).alias("keys"))
    pages = rows.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "site")
    counts = rows.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(pages, F.col("host").eqNullSafe(F.col("site"))).where(F.col("n") > F.col("pages") * ratio).select("host", "key")


def site_line_dedup(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", ratio: float = 0.02, min_pages: int = 4) -> DataFrame:
    """docs with text cut down, and n_lines, n_dropped added (in place of columns of those names).

    Lines are what stands between line feeds; they compare without the blanks
    around them. Every occurrence of a boilerplate line goes; blank lines
    never do. Each row is a page, repeated rows too. A null host is a host of
    its own. A null text stays null, with no line; an empty one is a single
    blank line. Columns not named stay as they are. Empty table: empty result.
    """
    # Names that the caller's columns can't clash with.
    lines_of = docs.select(F.col(doc_id).alias("id"), F.col(host).alias("host"), F.explode(_keys(F.col(text))).alias("key"))
    bad = boilerplate(docs, host, text, ratio, min_pages).select(F.col("host").alias("site"), F.col("key").alias("bad"))
    hit = lines_of.join(bad, F.col("host").eqNullSafe(F.col("site")) & (F.col("key") == F.col("bad")))
    drop = hit.groupBy("id", "host").agg(F.collect_set("key").alias("__drop")).select(F.col("id").alias("__id"), F.col("host").alias("__host"), "__drop")
    kept = F.when(F.col("__drop").isNull(), _lines(F.col(text))).otherwise(F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col("__drop"), _key(x))))
    out = docs.join(drop, F.col(doc_id).eqNullSafe(F.col("__id")) & F.col(host).eqNullSafe(F.col("__host")), "left")
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(_lines(F.col(text)))).cast("long")
    left = F.when(F.col(text).isNull(), 0).otherwise(F.size("__kept")).cast("long")
    out = out.withColumn("__kept", kept).withColumn("n_lines", lines).withColumn("n_dropped", F.col("n_lines") - left)
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join("__kept", "\n")))).drop("__id", "__host", "__drop", "__kept")


def lines_sql(ratio: float = 0.02, min_pages: int = 4, docs: str = "documents") -> str:
    return f"""
    with rows as (select *, row_number() over () as row from {docs}),
    parts as (select row, source, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from rows),
    pages as (select source, count(*) as pages from rows group by source),
    counts as (select source, trim(line, ' ') as line, count(distinct row) as n from parts where trim(line, ' ') <> '' group by all),
    bad as (select c.source, c.line from counts c join pages p on c.source is not distinct from p.source where n >= {min_pages} and n > pages * {ratio}::double),
    flagged as (select p.row, p.line, p.pos, b.line is not null as bad from parts p left join bad b on p.source is not distinct from b.source and trim(p.line, ' ') = b.line),
    joined as (select row, count(*) as n_lines, count(*) filter (bad) as n_dropped, string_agg(line, chr(10) order by pos) filter (not bad) as kept from flagged group by row)
    select doc_id, case when text is null then 0 else n_lines end::bigint as n_lines, case when text is null then 0 else n_dropped end::bigint as n_dropped, case when text is not null then coalesce(kept, '') end as text
    from rows join joined using (row)
    """
