"""Verifiable checks of responses: a list of check entries is compiled into one array column, then exploded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegauge.functions import text as T
from voicegauge.functions.kernels import sentences, sentences_each

END = r"[\"')\]}…]+$"


class Response:
    """Columns of one variant of a response that checks read; plain is its text in NFKC, sent its array of sentences."""

    def __init__(self, text: Column, sent: Column, plain: Column):
        self.text, self.sent, self.plain = text, sent, plain

    @property
    def n_words(self) -> Column:
        return T.word_count(self.plain)

    def last(self, of: Column) -> Column:
        return F.right(F.regexp_replace(of, END, ""), F.lit(1))


def _any_of(chars: str, c: Column) -> Column:
    return (c != "") & F.lit(chars).contains(c)


def _matches(patterns: list[str], text: Column, flags: str) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(f"(?{flags}){p}")
    return out


def _truncated(r: Response, p: dict) -> Column:
    if not p.get("max_tokens"):
        return F.lit(False)
    tokens = T.estimated_tokens(r.n_words, F.length(T.plain_marks(r.plain)))
    last = r.last(F.trim(r.text))
    return (tokens >= float(p.get("cap_ratio", 0.9)) * float(p["max_tokens"])) & (last != "") & ~_any_of(".!?", last)


#: type: (response, parameters) -> whether it passes. Add an entry to add a type.
CHECKS: dict[str, Callable[[Response, dict], Column]] = {
    "non_empty": lambda r, p: F.trim(r.text) != "",
    "opening_sentence_max_words": lambda r, p: (F.size(r.sent) > 0) & (T.word_count(F.get(r.sent, F.lit(0))) <= int(p.get("max_words", 5))),
    "opening_sentence_terminator": lambda r, p: (F.size(r.sent) > 0) & _any_of(str(p.get("terminators", ".")), r.last(F.get(r.sent, F.lit(0)))),
    "detail_sentence_count": lambda r, p: F.greatest(F.size(r.sent) - 1, F.lit(0)).between(int(p.get("min", 1)), int(p.get("max", 2))),
    "total_sentence_count": lambda r, p: F.size(r.sent).between(int(p.get("min", 1)), int(p.get("max", 4))),
    "language_marker_ratio": lambda r, p: T.english_ratio(T.words(r.plain)) >= float(p.get("min_marker_ratio", 0.08)),
    "forbidden_patterns": lambda r, p: ~_matches(p.get("patterns") or [], r.text, "im"),
    "no_question": lambda r, p: ~r.text.contains("?"),
    "response_complete": lambda r, p: _any_of(str(p.get("terminators", ".!?")), r.last(F.trim(r.text))),
    "not_truncated_at_cap": lambda r, p: ~_truncated(r, p),
    "max_total_words": lambda r, p: r.n_words <= int(p.get("max_words", 80)),
    "max_spoken_seconds": lambda r, p: T.spoken_seconds(r.n_words, float(p.get("words_per_second", 2.5))) <= float(p.get("max_seconds", 25.0)),
    # an item's own patterns
    "must_include": lambda r, p: F.forall("must_include", lambda x: F.regexp_like(r.text, F.concat(F.lit("(?i)"), x))),
    "must_forbid": lambda r, p: ~F.exists("must_forbid", lambda x: F.regexp_like(r.text, F.concat(F.lit("(?i)"), x))),
}
CONDITIONAL = ("must_include", "must_forbid")
NEEDS_SENTENCES = ("opening_sentence_max_words", "opening_sentence_terminator", "detail_sentence_count", "total_sentence_count")


def validate(checks: list[dict]) -> None:
    for c in checks:
        if c.get("type") not in CHECKS:
            raise ValueError(f"no such check: {c.get('type')!r}")


def _why_not(c: dict) -> Column:
    """Why a check doesn't apply to an item; null if it does."""
    out = F.lit(None).cast("string")
    if c["type"] in CONDITIONAL:
        out = F.when(F.coalesce(F.size(c["type"]), F.lit(0)) <= 0, "nothing specified for this item").otherwise(out)
    scope = c.get("applies_to")
    if scope not in (None, "all", ["all"]):
        names = [scope] if isinstance(scope, str) else list(scope)
        out = F.when(F.col("category").isin(*names), out).otherwise(f"scoped to {', '.join(names)}")
    if c.get("min_response_words") is not None:
        out = F.when(T.word_count(F.col("plain")) < int(c["min_response_words"]), "too few words to decide").otherwise(out)
    if c.get("skip_for"):
        out = F.when(F.col("category").isin(*c["skip_for"]), F.concat(F.lit("exempt for category "), F.col("category"))).otherwise(out)
    return out


def evaluate(items: DataFrame, checks: list[dict], runtime: dict | None = None, loose: bool = True) -> DataFrame:
    """(item, check_id, severity, applicable, strict, loose, reason): a row for each item and check.

    items: (item, text, category, must_include, must_forbid). A check that
    doesn't apply counts as passed and not applicable. The loose verdict is
    whether any rewrite of the formatting passes; sentences are split in one
    kernel call for the text, and in one for its rewrites, only if a check
    reads them.
    """
    validate(checks)
    items = items.withColumn("text", F.coalesce("text", F.lit("")))
    items = items.withColumn("plain", T.folded(F.col("text")))
    deep = any(c["type"] in NEEDS_SENTENCES for c in checks)
    none = F.array().cast("array<string>")
    items = items.withColumn("sent", sentences("text") if deep else none)
    if loose:
        items = items.withColumns({v: T.loose_variants(F.col(c)) for v, c in (("variants", "text"), ("plains", "plain"))})
        items = items.withColumn("sents", sentences_each("variants") if deep else F.transform("variants", lambda v: none))
    rows = []
    for c in checks:
        params = dict(c.get("params") or {})
        if c["type"] == "not_truncated_at_cap":
            params = {**{k: v for k, v in (runtime or {}).items() if k == "max_tokens"}, **params}
        ask = CHECKS[c["type"]]
        strict = ask(Response(F.col("text"), F.col("sent"), F.col("plain")), params)
        easy = F.exists(F.arrays_zip("variants", "sents", "plains"), lambda v: ask(Response(v["variants"], v["sents"], v["plains"]), params)) if loose else strict  # noqa: B023
        why = _why_not(c)
        rows.append(F.struct(F.lit(str(c.get("id") or c["type"])).alias("check_id"), F.lit(c.get("severity", "hard")).alias("severity"), why.isNull().alias("applicable"), F.when(why.isNotNull(), True).otherwise(strict).alias("strict"), F.when(why.isNotNull(), True).otherwise(strict | easy).alias("loose"), why.alias("reason")))
    return items.select("item", F.explode(F.array(*rows)).alias("c")).select("item", "c.*")


def item_verdicts(results: DataFrame) -> DataFrame:
    """(item, pass_strict, pass_loose, rate_strict, rate_loose, failures): hard applicable checks only; an item with none passes and has no rate."""
    hard = F.col("applicable") & (F.col("severity") == "hard")
    rate = lambda c: F.avg(F.when(hard, F.col(c).cast("int")))
    every = lambda c: F.coalesce(F.bool_and(F.when(hard, F.col(c))), F.lit(True))
    return results.groupBy("item").agg(every("strict").alias("pass_strict"), every("loose").alias("pass_loose"), rate("strict").alias("rate_strict"), rate("loose").alias("rate_loose"), F.array_join(F.array_sort(F.collect_list(F.when(hard & ~F.col("strict"), F.col("check_id")))), ";").alias("failures"))


def check_rates(results: DataFrame) -> DataFrame:
    """(check_id, n_applicable, rate_strict, rate_loose) over applicable items; soft checks count here."""
    on = F.col("applicable")
    return results.groupBy("check_id").agg(F.count_if(on).alias("n_applicable"), F.avg(F.when(on, F.col("strict").cast("int"))).alias("rate_strict"), F.avg(F.when(on, F.col("loose").cast("int"))).alias("rate_loose"))


def describe(text: Column, sent: Column) -> Column:
    """struct of nine measures of a response."""
    plain = T.folded(text)
    n, s = T.word_count(plain), F.size(sent)
    syllables = F.aggregate(F.transform(T.words(plain), T.syllables), F.lit(0), lambda a, x: a + x)
    ok = (n > 0) & (s > 0)
    return F.struct(
        n.alias("word_count"), s.alias("sentence_count"), F.length(text).alias("char_count"), F.when(s > 0, n / s).otherwise(0.0).alias("mean_words_per_sentence"), F.when(s > 0, T.word_count(F.get(sent, F.lit(0)))).otherwise(0).alias("opening_words"),
        T.estimated_tokens(n, F.length(T.plain_marks(plain))).alias("estimated_tokens"), F.round(T.spoken_seconds(n), 2).alias("estimated_spoken_seconds"),
        F.when(ok, F.round(T.reading_ease(n, s, syllables), 2)).alias("flesch_reading_ease"), F.when(ok, F.round(T.grade_level(n, s, syllables), 2)).alias("flesch_kincaid_grade"),
    )
