"""Run identities, and which runs of a grid are compared with which: one window a kind over the table of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voicegauge.operators.settle import settled
from voicegauge.schemas import PRECISION_BITS


def parse_model_tag(tag: Column) -> Column:
    """struct(family, size_label, size_b, tuning, quantization, precision_bits) of family:size-tuning-quantization."""
    text = F.trim(F.coalesce(tag, F.lit("")))
    family = F.substring_index(text, ":", 1)
    rest = F.when(F.instr(text, ":") > 0, F.substring(text, F.instr(text, ":") + 1, F.length(text))).otherwise("")
    parts = F.filter(F.split(rest, "-"), lambda p: p != "")
    head = F.get(parts, F.lit(0))
    size = r"(?i)^(\d+(?:\.\d+)?)\s*([bm])$"
    sized = F.coalesce(head.rlike(size), F.lit(False))
    number = F.regexp_extract(head, size, 1).try_cast("double")
    size_b = F.when(sized, F.when(F.lower(F.regexp_extract(head, size, 2)) == "m", number / 1000).otherwise(number)).otherwise(0.0)
    left = F.when(sized, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    tail = F.get(left, F.size(left) - 1)
    quantized = F.coalesce(tail.rlike(r"(?i)^(?:fp?(?:16|32)|bf16|q\d+(?:_[0-9a-z]+)*)$"), F.lit(False))
    tuning = F.array_join(F.when(quantized, F.slice(left, F.lit(1), F.greatest(F.size(left) - 1, F.lit(0)))).otherwise(left), "-")
    bits = F.create_map(*(F.lit(x) for kv in PRECISION_BITS.items() for x in kv))
    quantization = F.when(quantized, tail).otherwise("")
    return F.struct(
        F.when(family == "", text).otherwise(family).alias("family"), F.when(sized, F.lower(head)).otherwise("").alias("size_label"), size_b.alias("size_b"), tuning.alias("tuning"), quantization.alias("quantization"),
        F.coalesce(F.try_element_at(bits, F.lower(quantization)), F.lit(0)).alias("precision_bits"),
    )


def recognizer_fields(config: Column) -> Column:
    """struct(stt_model, stt_device, stt_compute) of a run's settings (map of text); keys carry the engine's name, vosk is on the CPU."""
    get = lambda suffix: F.trim(F.coalesce(F.try_element_at(config, F.concat(engine, F.lit(suffix))), F.lit("")))
    engine = F.lower(F.trim(F.coalesce(F.try_element_at(config, F.lit("stt_engine")), F.lit(""))))
    model = F.element_at(F.split(F.regexp_replace(F.regexp_replace(get("_model"), r"\\", "/"), "/+$", ""), "/"), -1)
    named = model
    for prefix in ("-", "_model_", "-model-"):  # the longest that fits is cut, so it comes last
        full = F.concat(engine, F.lit(prefix))
        model = F.when(F.startswith(F.lower(named), full), F.substring(named, F.length(full) + 1, F.length(named))).otherwise(model)
    device = F.lower(get("_device"))
    device = F.when((device == "") & (engine == "vosk"), "cpu").otherwise(device)
    none = engine == ""
    return F.struct(F.when(none, "").otherwise(model).alias("stt_model"), F.when(none, "").otherwise(device).alias("stt_device"), F.when(none, "").otherwise(F.lower(get("_compute_type"))).alias("stt_compute"))


def recognizer(engine: Column, model: Column, device: Column, compute: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("-", F.coalesce(blank(engine), F.lit("stt")), blank(model), blank(device), blank(compute))


def lineage(family: Column) -> Column:
    """The family's name before any digit."""
    head = F.regexp_replace(F.regexp_extract(family, r"^([^\d]+)", 1), r"[-_.]+$", "")
    return F.when(head == "", family).otherwise(head)


def plain_number(x: Column) -> Column:
    """A double as %g writes it."""
    text = F.format_string("%.6f", x)
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def setting(temperature: Column, seed: Column) -> Column:
    text = F.concat(F.lit("t"), plain_number(temperature))
    return F.when(temperature.isNull(), "t?").when(seed.isNull(), text).otherwise(F.concat(text, F.lit("/s"), seed.cast("string")))


def short_model(family: Column, size_label: Column, quantization: Column) -> Column:
    return F.concat_ws("-", F.when(size_label != "", F.concat(family, F.lit(":"), size_label)).otherwise(family), F.nullif(quantization, F.lit("")))


def identify(runs: DataFrame) -> DataFrame:
    """runs (run, ord, model_tag, temperature, seed, recognizer) with every derived column of its identity."""
    out = runs.withColumn("m", parse_model_tag(F.col("model_tag"))).select("*", "m.*").drop("m")
    out = out.withColumn("lineage", lineage(F.col("family"))).withColumn("setting", setting(F.col("temperature"), F.col("seed"))).withColumn("short_model", short_model(F.col("family"), F.col("size_label"), F.col("quantization")))
    return out.withColumn("label", F.concat_ws(" ", F.format_string("%02d", F.col("ord").cast("long")), "short_model", "setting"))


#: kind: (held fixed, varying, order, group id)
KINDS = {
    "parameters": (("model_tag", "recognizer"), None, ("temperature", "ord"), "model_tag"),
    "quantization": (("family", "size_label", "tuning", "setting", "recognizer"), "quantization", ("precision_bits desc", "ord"), "concat_ws('_', family, size_label, setting)"),
    "model_size": (("lineage", "quantization", "tuning", "setting", "recognizer"), "size_label", ("size_b desc", "ord"), "concat_ws('_', lineage, quantization, setting)"),
    "cross_model": (("setting", "recognizer"), "model_tag", ("size_b desc", "precision_bits desc", "ord"), "concat('at_', setting)"),
    "recognizer": (("model_tag", "setting"), "recognizer", ("used desc", "ord"), "concat(model_tag, '_at_', setting)"),
}

#: What the kinds read of a run, besides the number of runs of its recognizer.
COMPARED = ("run", "ord", "model_tag", "temperature", "recognizer", "family", "size_label", "size_b", "tuning", "quantization", "precision_bits", "lineage", "setting")


def contrast_edges(runs: DataFrame) -> DataFrame:
    """(kind, group_id, baseline, contrast) of identified runs: groups that agree in all but one property, each member against the first in its order.

    With several recognizers the group's name carries its own. Identities are
    written once, with the number of runs of their recognizer, and a kind is
    one pass over its groups in order: a group varies if its least value isn't
    its greatest, so no row carries a set that grows with the group.
    """
    used = runs.groupBy(F.col("recognizer").alias("__r")).agg(F.count("*").alias("used"))
    runs = settled(runs.select(*COMPARED).join(used, F.col("recognizer").eqNullSafe(F.col("__r"))).drop("__r"))
    several = runs.agg(F.min("recognizer") < F.max("recognizer")).scalar()
    runs = runs.withColumn("several", F.coalesce(several, F.lit(False)))
    out = None
    for kind, (fixed, varying, order, name) in KINDS.items():
        by = Window.partitionBy(*fixed).orderBy(*(F.expr(o.split()[0]).desc() if " desc" in o else F.expr(o.split()[0]).asc_nulls_last() for o in order))
        w = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        varies = F.min(varying).over(w) < F.max(varying).over(w) if varying else F.count("*").over(w) >= 2
        group = F.expr(name) if kind == "recognizer" else F.when(F.col("several"), F.concat_ws("_", F.expr(name), F.col("recognizer"))).otherwise(F.expr(name))
        edges = runs.select(F.lit(kind).alias("kind"), group.alias("group_id"), F.first("run").over(w).alias("baseline"), F.col("run").alias("contrast"), varies.alias("varies"), F.row_number().over(by).alias("place"))
        edges = edges.where("varies and place > 1").drop("varies", "place")
        out = edges if out is None else out.union(edges)
    return out


def shared_inputs(edges: DataFrame, runs: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """(kind, group_id, property, n_distinct) of what a group should hold fixed; more than one value deserves a warning."""
    members = edges.select("kind", "group_id", F.explode(F.array("baseline", "contrast")).alias("run")).distinct().join(runs, "run")
    shown = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties)))
    long = members.select("kind", "group_id", shown.alias("x")).select("kind", "group_id", "x.*").distinct()
    return long.groupBy("kind", "group_id", "property").agg((F.count("value") + F.max(F.col("value").isNull().cast("long"))).alias("n_distinct"))


def item_set_differences(edges: DataFrame, items: DataFrame) -> DataFrame:
    """(kind, group_id, contrast, missing, extra, differing): items that a run lacks of its baseline's, has besides, or was given other inputs for.

    Between recognizers only the intended question has to agree, else what was recognised too.
    """
    given = items.select("run", "item_id", F.col("stt_text").alias("heard"), F.col("ori_text").alias("meant"))
    side = lambda end: edges.join(given, edges[end] == given["run"]).select("kind", "group_id", "contrast", "item_id", F.struct("heard", "meant").alias(end + "_in"))
    both = side("baseline").join(side("contrast"), ["kind", "group_id", "contrast", "item_id"], "full")
    a, b = F.col("baseline_in"), F.col("contrast_in")
    other = ~a["meant"].eqNullSafe(b["meant"]) | ((F.col("kind") != "recognizer") & ~a["heard"].eqNullSafe(b["heard"]))
    found = F.count_if(b.isNull()).alias("missing"), F.count_if(a.isNull()).alias("extra"), F.count_if(a.isNotNull() & b.isNotNull() & other).alias("differing")
    return both.groupBy("kind", "group_id", "contrast").agg(*found)
