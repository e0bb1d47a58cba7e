"""Preference formatting of chat pairs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order of turn, ties by role and text. A conversation is one value, like a text.

    A row without a conv_id belongs with no other: it is a conversation of one turn.
    """
    rows = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    alone = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    listed = conversations.select(F.col(conv_id).alias("conv_id"), alone.alias("alone"), rows.alias("row"))
    listed = listed.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def reply_swaps(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): a conversation up to its last assistant turn, and the same with the last assistant turn of its neighbour (conv_id with the lowest bit flipped) in that turn's place.

    Without an assistant turn chosen is empty; without one in the neighbour,
    or without a neighbour, rejected is empty. A null conv_id has no neighbour.
    """
    own = turns_of(conversations)
    at = F.coalesce(F.array_max(F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i + 1))), F.lit(0))
    own = own.withColumn("last", at)
    other = own.where("last > 0").select((F.expr("cast(conv_id as bigint) ^ 1L")).alias("to"), F.expr("turns[last - 1]").alias("reply"))
    both = own.join(other, own.conv_id == other["to"], "left")
    chosen = F.slice("turns", F.lit(1), F.col("last").cast("int"))
    rejected = F.when(F.col("reply").isNull() | (F.col("last") == 0), F.array().cast(f"array<{TURN}>")).otherwise(F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("last") - 1, F.lit(0))), F.array("reply")))
    return both.select("conv_id", chosen.alias("chosen"), rejected.alias("rejected"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit("<|end|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _segments(turns: Column) -> Column:
    return F.flatten(F.transform(turns, lambda t: F.array(_head(t), _body(t))))


def _mask(turns: Column, trained: str) -> Column:
    one = lambda t: F.when(t["role"] == trained, 1).otherwise(0)
    return F.flatten(F.transform(turns, lambda t: F.array(F.lit(0), one(t))))


def format_preferences(pairs: DataFrame, pair_id: str = "conv_id", chosen: str = "chosen", rejected: str = "rejected", trained: str = "assistant") -> DataFrame:
    """(pair_id, prompt, common_turns, chosen, rejected, *_segments, *_mask, usable) of pairs of turn arrays.

    The longest common prefix of turns (role and text equal, null equal to
    null) is rendered once as prompt. What follows it on each side is that
    side's completion: its segments are headers and bodies in turn, joined they
    are the completion; the mask is 1 for bodies of the trained role. usable:
    both completions have a body to train on.

    Null arrays count as empty. Equal sides give empty completions. A null
    role is shown as "unknown", a null text as an empty one. Repeated rows are
    each formatted. Empty table: empty result.
    """
    empty = F.array().cast(f"array<{TURN}>")
    p = pairs.select(F.col(pair_id).alias("pair_id"), F.coalesce(F.col(chosen), empty).alias("c"), F.coalesce(F.col(rejected), empty).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    first_off = F.array_position(same, False).cast("int")
    shorter = F.least(F.size("c"), F.size("r"))
    p = p.withColumn("common", F.when(first_off == 0, shorter).otherwise(F.least(first_off - 1, shorter)))
    p = p.withColumn("prefix", F.slice("c", F.lit(1), F.col("common")))
    for side in "cr":
        p = p.withColumn(f"{side}_rest", F.slice(side, F.col("common") + 1, F.size(side)))
    out = {"prompt": _render(F.col("prefix")), "common_turns": F.col("common").cast("long")}
    for side, name in (("c", "chosen"), ("r", "rejected")):
        out |= {name: _render(F.col(f"{side}_rest")), f"{name}_segments": _segments(F.col(f"{side}_rest")), f"{name}_mask": _mask(F.col(f"{side}_rest"), trained)}
    out["usable"] = F.array_contains(out["chosen_mask"], 1) & F.array_contains(out["rejected_mask"], 1)
    return p.select("pair_id", *(c.alias(n) for n, c in out.items()))


def chat_sql() -> str:
    """reply_swaps and format_preferences over `conversations` in DuckDB's SQL, in the columns of the query."""
    head = "'<|' || coalesce(t.role, 'unknown') || '|>' || chr(10)"
    body = "coalesce(t.text, '') || '<|end|>' || chr(10)"
    render = lambda x: f"array_to_string(list_transform({x}, lambda t: {head} || {body}), '')"
    mask = lambda x: f"array_to_string(list_transform({x}, lambda t: case when t.role = 'assistant' then '01' else '00' end), '')"
    length = lambda x: f"array_to_string(list_transform({x}, lambda t: length({head}) || ',' || length({body})), ',')"
    return f"""
    with own as (select conv_id, list(struct_pack(role := role, text := text) order by turn nulls first, role nulls first, text nulls first) as turns from (select *, case when conv_id is null then row_number() over () end as alone from conversations) group by conv_id, alone),
    marked as (select *, coalesce(list_max(list_transform(turns, lambda t, i: case when t.role = 'assistant' then i end)), 0)::bigint as last from own),
    pairs as (select a.conv_id, list_slice(a.turns, 1, a.last) as c,
      case when b.conv_id is null or a.last = 0 then [] else list_concat(list_slice(a.turns, 1, a.last - 1), [b.turns[b.last]]) end as r
      from marked a left join marked b on b.conv_id = xor(a.conv_id, 1) and b.last > 0),
    prefix as (select *, coalesce(list_min(list_filter(list_transform(range(1, least(len(c), len(r)) + 1), lambda i: case when c[i].role is distinct from r[i].role or c[i].text is distinct from r[i].text then i end), lambda i: i is not null)) - 1, least(len(c), len(r)))::bigint as common from pairs),
    parts as (select conv_id, common, list_slice(c, 1, common) as p, list_slice(c, common + 1, len(c)) as c, list_slice(r, common + 1, len(r)) as r from prefix)
    select conv_id, common as common_turns, {render("p")} as prompt, {render("c")} as chosen, {render("r")} as rejected, {mask("c")} as chosen_mask, {mask("r")} as rejected_mask,
      {length("c")} as chosen_lengths, {length("r")} as rejected_lengths, ({mask("c")} like '%1%' and {mask("r")} like '%1%') as usable
    from parts
    """
