"""Overlap of a response with its question and references: token F1, presence, ROUGE, weighted coverage, error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegauge.functions import text as T
from voicegauge.functions.kernels import best_alignment, joined_subsequence


def shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    times = lambda xs, w: F.size(xs) - F.size(F.array_remove(xs, w))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(times(a, w), times(b, w)))


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(tokens)), lambda i: i <= F.size(tokens) - n), lambda i: F.array_join(F.slice(tokens, i + 1, F.lit(n)), " "))


def token_scores(p: Column, r: Column) -> Column:
    """struct(precision, recall, f1, exact, presence) of answer tokens p against reference tokens r."""
    return T.bound(F.struct(p.alias("p"), r.alias("r")), lambda x: T.bound(shared(x["p"], x["r"]), lambda common: _token_scores(x["p"], x["r"], common)))


def _token_scores(p: Column, r: Column, common: Column) -> Column:
    none = (F.size(p) == 0) | (F.size(r) == 0)
    flat = F.when(p == r, 1.0).otherwise(0.0)
    share = lambda of: F.when(none, flat).otherwise(common / F.size(of))
    f1 = F.when(none, flat).when(common == 0, 0.0).otherwise(2 * common / (F.size(p) + F.size(r)))
    padded = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    presence = F.when(F.size(r) == 0, 0.0).otherwise(F.when(padded(p).contains(padded(r)), 1.0).otherwise(0.0))
    return F.struct(share(p).alias("precision"), share(r).alias("recall"), f1.alias("f1"), (p == r).cast("double").alias("exact"), presence.alias("presence"))


def rouge_n(p: Column, r: Column, n: int = 1) -> Column:
    a, b = ngrams(p, n), ngrams(r, n)
    return F.when(F.size(b) <= 0, 0.0).otherwise(shared(a, b) / F.size(b))


def rouge_l(p: Column, r: Column, beta: float = 1.2) -> Column:
    c = joined_subsequence(F.array_join(p, " "), F.array_join(r, " "))
    precision, recall = c["lcs"] / c["n_a"], c["lcs"] / c["n_b"]
    return F.when((c["n_a"] == 0) | (c["n_b"] == 0) | (c["lcs"] == 0), 0.0).otherwise((1 + beta**2) * precision * recall / (recall + beta**2 * precision))


def reference_scores(pairs: DataFrame, prediction: str, references: str) -> DataFrame:
    """pairs (item, prediction, references array) -> best of each measure over the references; answer_words is the shortest reference's."""
    r = pairs.select("item", T.answer_tokens(T.folded(F.col(prediction))).alias("p"), F.explode(references).alias("ref")).withColumn("r", T.answer_tokens(T.folded(F.col("ref"))))
    s = r.select("item", "p", "r", token_scores(F.col("p"), F.col("r")).alias("s"), rouge_n(F.col("p"), F.col("r")).alias("rouge_1"), rouge_l(F.col("p"), F.col("r")).alias("rouge_l"))
    return s.groupBy("item").agg(F.max("s.f1").alias("token_f1"), F.max("s.exact").alias("exact_match"), F.max("s.presence").alias("answer_presence"), F.max("rouge_1").alias("rouge_1"), F.max("rouge_l").alias("rouge_l"), F.min(F.size("r")).alias("answer_words"))


def idf_index(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, token, df, idf) of the topical stems of non-blank texts: ln((N+1)/(df+1)) + 1, for each group of by on its own."""
    kept = docs.where(F.trim(text) != "").select(*by, F.array_distinct(T.content_tokens(T.folded(F.col(text)))).alias("tokens"))
    df = kept.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("df"))
    if by:
        sizes = kept.groupBy(*by).agg(F.count("*").alias("__n"))
        df, n = df.join(sizes, list(by)), F.col("__n")
    else:
        n = kept.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    return df.select(*by, "token", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def coverage(pairs: DataFrame, question: str, answer: str, idf: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(item, coverage, echo), weights from the item's group of by: the weight of the question's topics that the answer has, and the share of the answer's topics that repeat the question; null without any."""
    tokens = lambda c: T.content_tokens(T.folded(F.col(c)))
    t = pairs.select("item", *by, F.array_distinct(tokens(question)).alias("q"), tokens(answer).alias("a"))
    echo = t.select("item", F.when(F.size("a") > 0, F.size(F.filter("a", lambda w: F.array_contains("q", w))) / F.size("a")).alias("echo"))
    topics = t.select("item", *by, F.explode("q").alias("token"), "a").select("item", *by, "token", F.array_contains("a", F.col("token")).alias("hit"))
    if idf is None:
        topics = topics.withColumn("w", F.lit(1.0))
    else:
        topics = topics.join(idf.select(*by, "token", F.col("idf").alias("w")), [*by, "token"], "left")
    seen = topics.groupBy("item").agg((F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("coverage"))
    return echo.join(seen, "item", "left").select("item", "coverage", "echo")


def asr_tokens(text: Column) -> Column:
    return F.transform(T.words(T.folded(text)), lambda w: F.translate(F.lower(w), "'’", ""))


def error_rate(errors: Column, n: Column) -> Column:
    """Errors a reference word; without reference words 0, or infinite if there are errors."""
    return F.when(n > 0, errors / n).when(errors == 0, 0.0).otherwise(F.lit(float("inf")))


def word_errors(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """pairs with substitutions, deletions, insertions, ref_words, wer: the alignment with the fewest errors over the ways to say its numerals."""
    out = pairs.withColumn("__a", best_alignment(F.array_join(asr_tokens(F.col(reference)), " "), F.array_join(asr_tokens(F.col(hypothesis)), " "))).select(*pairs.columns, "__a.*")
    return out.withColumn("wer", error_rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("ref_words")))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    r, h = F.array_join(asr_tokens(reference), " "), F.array_join(asr_tokens(hypothesis), " ")
    return error_rate(F.levenshtein(r, h), F.length(r))


def content_recall(reference: Column, hypothesis: Column) -> Column:
    r, h = F.array_distinct(T.content_tokens(T.folded(reference))), T.content_tokens(T.folded(hypothesis))
    return F.when(F.size(r) > 0, F.size(F.array_intersect(r, h)) / F.size(r))


def stratum(wer: Column) -> Column:
    return F.when(wer.isNull(), "unknown").when(wer <= 0, "clean").when(wer <= 1 / 3, "mild").otherwise("severe")


def corpus_error_rate(errors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Errors over reference words of all items together, not a mean of rates."""
    total = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return errors.groupBy(*by).agg(F.count("*").alias("n"), total.alias("errors"), F.sum("ref_words").alias("ref_words"), F.try_divide(total, F.sum("ref_words")).alias("corpus_wer"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
