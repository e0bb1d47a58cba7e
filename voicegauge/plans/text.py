"""Queries over transcripts: measures, checks, overlap, error rates, acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voicegauge.functions import text as T
from voicegauge.functions.kernels import sentences
from voicegauge.operators import compare, constraints, evaluate, overlap
from voicegauge.plans.registry import query
from voicegauge.plans.tables import TURNS_SQL, r4, table, turns


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


MARKS = "translate({0}, '’‘“”–—', '''''\"\"--')"
WORDS = "regexp_extract_all({0}, '[0-9]+(?:[.,][0-9]+)*|\\p{{L}}+(?:[''’]\\p{{L}}+)*')"


def words_sql(text: str) -> str:
    return WORDS.format(MARKS.format(text))


@query("q20_word_measures", f"with w as (select doc_id, {words_sql('text')} as t, length({MARKS.format('text')}) as n from documents) select doc_id, len(t)::bigint as words, round(case when len(t) = 0 then 0 else len(list_filter(t, lambda x: lower(x) in {_list(T.ENGLISH_MARKERS)}))::double / len(t) end, 4) as english, round_even(greatest(len(t) * 1.33::double, n / 6.0::double), 0)::bigint as tokens, round(len(t) / 2.5::double, 4) as seconds from w")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(T.folded(F.col("text"))).alias("t"), F.length(T.plain_marks(T.folded(F.col("text")))).alias("n"))
    size = F.size("t")
    return d.select("doc_id", size.cast("long").alias("words"), r4(T.english_ratio(F.col("t"))).alias("english"), T.estimated_tokens(size, F.col("n")).alias("tokens"), r4(T.spoken_seconds(size)).alias("seconds"))


SYLLABLES = "list_sum(list_transform(list_filter(list_transform(t, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x <> ''), lambda x: case when length(x) <= 3 then 1 else greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(x, '(?:[^laeiouy]es|[^laeiouy]e|ed)$', ''), '^y', ''), '[aeiouy]{1,2}'))) end))"
SENTS = "list_filter(regexp_split_to_array(trim({0}, ' '), '[.!?][\"'')\\]}}…]*(?:\\s+|$)'), lambda s: trim(s, ' ') <> '')"


@query("q21_syllables_readability", f"with w as (select doc_id, {words_sql('text')} as t, len({SENTS.format(MARKS.format('text'))})::bigint as s from documents), c as (select doc_id, len(t)::bigint as n, s, coalesce({SYLLABLES}, 0)::bigint as y from w) select doc_id, n, s as sentences, y as syllables, round(206.835::double - 1.015::double * (n::double / s) - 84.6::double * (y::double / n), 3) as ease, round(0.39::double * (n::double / s) + 11.8::double * (y::double / n) - 15.59::double, 3) as grade from c where n > 0 and s > 0")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.words(T.folded(F.col("text"))).alias("t"), F.size(T.rough_sentences(T.folded(F.col("text")))).cast("long").alias("s"))
    y = F.aggregate(F.transform("t", T.syllables), F.lit(0), lambda a, x: a + x)
    d = d.select("doc_id", F.size("t").cast("long").alias("n"), "s", y.cast("long").alias("y")).where("n > 0 and s > 0")
    return d.select("doc_id", "n", F.col("s").alias("sentences"), F.col("y").alias("syllables"), F.round(T.reading_ease(F.col("n"), F.col("s"), F.col("y")), 3).alias("ease"), F.round(T.grade_level(F.col("n"), F.col("s"), F.col("y")), 3).alias("grade"))


PLAIN_CHECKS = [
    {"id": "non_empty", "type": "non_empty"}, {"id": "english", "type": "language_marker_ratio", "min_response_words": 8, "params": {"min_marker_ratio": 0.08}}, {"id": "no_labels", "type": "forbidden_patterns", "params": {"patterns": [r"^\s*(?:user|human)\s*:", r"Ich\s"]}},
    {"id": "no_question", "type": "no_question", "severity": "soft"}, {"id": "complete", "type": "response_complete"}, {"id": "brief", "type": "max_total_words", "severity": "soft", "params": {"max_words": 80}}, {"id": "short", "type": "max_spoken_seconds", "params": {"max_seconds": 25}},
]
SENTENCE_CHECKS = [{"id": "opener", "type": "opening_sentence_max_words"}, {"id": "full_stop", "type": "opening_sentence_terminator"}, {"id": "detail", "type": "detail_sentence_count", "params": {"min": 0, "max": 2}}, {"id": "total", "type": "total_sentence_count", "params": {"min": 1, "max": 3}}, {"id": "cap", "type": "not_truncated_at_cap"}]


def _items(spark, sf_dir):
    none = F.array().cast("array<string>")
    return turns(spark, sf_dir).select("item", "text", F.lit("unspecified").alias("category"), none.alias("must_include"), none.alias("must_forbid"))


LAST = "right(regexp_replace(trim(text, ' '), '[\"'')\\]}…]+$', ''), 1)"
CHECKS_SQL = f"""{TURNS_SQL}, w as (select item, text, {words_sql('text')} as t from turns),
    c as (select item, unnest([
      {{'check_id': 'non_empty', 'severity': 'hard', 'applicable': true, 'strict': trim(text, ' ') <> ''}},
      {{'check_id': 'english', 'severity': 'hard', 'applicable': len(t) >= 8, 'strict': len(t) < 8 or len(list_filter(t, lambda x: lower(x) in {_list(T.ENGLISH_MARKERS)}))::double / len(t) >= 0.08::double}},
      {{'check_id': 'no_labels', 'severity': 'hard', 'applicable': true, 'strict': not regexp_matches(text, '(?im)^\\s*(?:user|human)\\s*:') and not regexp_matches(text, '(?im)Ich\\s')}},
      {{'check_id': 'no_question', 'severity': 'soft', 'applicable': true, 'strict': not contains(text, '?')}},
      {{'check_id': 'complete', 'severity': 'hard', 'applicable': true, 'strict': {LAST} in ('.', '!', '?')}},
      {{'check_id': 'brief', 'severity': 'soft', 'applicable': true, 'strict': len(t) <= 80}},
      {{'check_id': 'short', 'severity': 'hard', 'applicable': true, 'strict': len(t) / 2.5::double <= 25}}]) as x from w),
    checks as (select item, x.check_id as check_id, x.severity as severity, x.applicable as applicable, x.strict as strict from c)"""


@query("q22_constraint_checks", f"with {CHECKS_SQL} select item, check_id, strict, applicable from checks")
def q22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.evaluate(_items(spark, sf_dir), PLAIN_CHECKS, loose=False).select("item", "check_id", "strict", "applicable")


@query("q23_constraint_rates", f"with {CHECKS_SQL}, i as (select item, coalesce(bool_and(strict) filter (applicable and severity = 'hard'), true) as pass, avg(strict::int) filter (applicable and severity = 'hard') as rate from checks group by item) select check_id, count(*) filter (applicable) as n, round(avg(strict::int) filter (applicable), 4) as rate from checks group by check_id union all select '(items)', count(*), round(avg(pass::int), 4) from i union all select '(item check rate)', count(rate), round(avg(rate), 4) from i")
def q23(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = constraints.evaluate(_items(spark, sf_dir), PLAIN_CHECKS, loose=False)
    items = constraints.item_verdicts(results)
    rates = constraints.check_rates(results).select("check_id", F.col("n_applicable").alias("n"), r4("rate_strict").alias("rate"))
    passed = items.agg(F.lit("(items)").alias("check_id"), F.count("*").alias("n"), r4(F.avg(F.col("pass_strict").cast("int"))).alias("rate"))
    return rates.union(passed).union(items.agg(F.lit("(item check rate)"), F.count("rate_strict"), r4(F.avg("rate_strict"))))


@query("q24_sentence_checks")
def q24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.evaluate(_items(spark, sf_dir), SENTENCE_CHECKS, {"max_tokens": 150})


def content_sql(text: str) -> str:
    bare = f"list_filter(list_transform({words_sql(text)}, lambda x: regexp_replace(lower(x), '[''’]s?$', '')), lambda x: length(x) >= 2 and x not in {_list(T.STOPWORDS)})"
    cases = " ".join(f"when length(x) > {len(s) + 3} and x like '%{s}' then x[:-{len(s) + 1}]" for s in T.SUFFIXES)
    return f"list_transform({bare}, lambda x: case {cases} else x end)"


@query("q25_content_tokens", f"with t as (select conv_id, turn, {content_sql('text')} as t from conversations) select conv_id, turn, len(t)::bigint as n, len(list_distinct(t))::bigint as n_distinct, array_to_string(list_sort(list_distinct(t)), ' ') as tokens from t")
def q25(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.content_tokens(T.folded(F.col("text"))).alias("t"))
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct("t")), " ").alias("tokens"))


IDF_SQL = f"docs as (select {content_sql('text')} as t from conversations where trim(text, ' ') <> ''), n as (select count(*) as n from docs), idf as (select token, count(*) as df, ln(((select n from n) + 1)::double / (count(*) + 1)) + 1 as idf from (select unnest(list_distinct(t)) as token from docs) group by token)"


@query("q26_idf", f"with {IDF_SQL} select token, df, round(idf, 4) as idf from idf")
def q26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.idf_index(table(spark, sf_dir, "conversations")).select("token", "df", r4("idf").alias("idf"))


@query("q27_coverage_echo", f"with {IDF_SQL}, {TURNS_SQL}, t as (select item, list_distinct({content_sql('question')}) as q, {content_sql('text')} as a from turns), e as (select item, case when len(a) > 0 then len(list_filter(a, lambda x: list_contains(q, x)))::double / len(a) end as echo from t), c as (select item, sum(case when list_contains(a, token) then idf else 0 end) / sum(idf) as coverage from (select item, a, unnest(q) as token from t) join idf using (token) group by item) select e.item, round(coverage, 4) as coverage, round(echo, 4) as echo from e left join c on e.item = c.item")
def q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf = overlap.idf_index(table(spark, sf_dir, "conversations"))
    return overlap.coverage(turns(spark, sf_dir), "question", "text", idf).select("item", r4("coverage").alias("coverage"), r4("echo").alias("echo"))


def answer_sql(text: str) -> str:
    return f"list_filter(list_transform({words_sql(text)}, lambda x: regexp_replace(lower(x), '[''’]', '', 'g')), lambda x: x <> '' and x not in {_list(T.ARTICLES)})"


OVERLAP_SQL = f"""with d as (select doc_id, {answer_sql('text')} as p from documents), r as (select item_id, {answer_sql('text')} as r from benchmark),
    x as (select doc_id, item_id, p, r from d join r on d.doc_id % (select count(*) from benchmark) = r.item_id),
    c as (select doc_id, item_id, sum(least(a, b))::bigint as common from (select doc_id, item_id, w, count(*) as a from (select doc_id, item_id, unnest(p) as w from x) group by all) join (select doc_id, item_id, w, count(*) as b from (select doc_id, item_id, unnest(r) as w from x) group by all) using (doc_id, item_id, w) group by all)
    select x.doc_id, x.item_id, round(case when len(p) = 0 or len(r) = 0 then (p = r)::int::double else 2 * coalesce(common, 0)::double / (len(p) + len(r)) end, 4) as f1, (p = r)::int::double as em, case when len(r) > 0 and contains(' ' || array_to_string(p, ' ') || ' ', ' ' || array_to_string(r, ' ') || ' ') then 1.0::double else 0.0::double end as presence, round(case when len(r) = 0 then 0 else coalesce(common, 0)::double / len(r) end, 4) as rouge_1
    from x left join c on x.doc_id = c.doc_id and x.item_id = c.item_id"""


def _answers(spark, sf_dir):
    """Every document with the item of its number modulo the items."""
    b = table(spark, sf_dir, "benchmark")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % b.agg(F.count("*")).scalar()).alias("item_id"))
    return d.join(b.select("item_id", F.col("text").alias("reference")), "item_id")


@query("q28_token_overlap", OVERLAP_SQL)
def q28(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _answers(spark, sf_dir).select("doc_id", "item_id", T.answer_tokens(T.folded(F.col("text"))).alias("p"), T.answer_tokens(T.folded(F.col("reference"))).alias("r"))
    s = x.select("doc_id", "item_id", overlap.token_scores(F.col("p"), F.col("r")).alias("s"), overlap.rouge_n(F.col("p"), F.col("r")).alias("rouge_1"))
    return s.select("doc_id", "item_id", r4("s.f1").alias("f1"), F.col("s.exact").alias("em"), F.col("s.presence").alias("presence"), r4("rouge_1").alias("rouge_1"))


@query("q29_rouge_l")
def q29(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _answers(spark, sf_dir)
    return x.select("doc_id", "item_id", r4(overlap.rouge_l(T.answer_tokens(T.folded(F.col("text"))), T.answer_tokens(T.folded(F.col("reference"))))).alias("rouge_l"))


@query("q30_cer", "with p as (select p_partkey as item, lower(p_name) as r, lower(p_type || ' ' || p_name) as h from part) select item, round(levenshtein(r, h)::double / length(r), 4) as cer from p")
def q30(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item"), r4(overlap.character_error_rate(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name"))).alias("cer"))


def _errors(spark, sf_dir, **more):
    """Turns, with more columns, against a copy that lost each word of two letters and has every 'the' as 'a'."""
    t = turns(spark, sf_dir).select("item", F.col("question").alias("reference"), F.regexp_replace(F.regexp_replace("question", r"\b\p{L}{2}\b", ""), r"\bthe\b", "a").alias("hypothesis"))
    return overlap.word_errors(t.withColumns(more) if more else t, "reference", "hypothesis")


@query("q31_wer_alignment")
def q31(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _errors(spark, sf_dir)
    items = e.select("item", "substitutions", "deletions", "insertions", r4("wer").alias("wer"))
    total = overlap.corpus_error_rate(e).select(F.lit("(corpus)").alias("item"), F.lit(None).cast("int").alias("substitutions"), F.lit(None).cast("int").alias("deletions"), F.lit(None).cast("int").alias("insertions"), r4("corpus_wer").alias("wer"))
    return items.union(total)


@query("q32_strata")
def q32(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the recall beside the tokens: one kernel folds the texts for both
    e = _errors(spark, sf_dir, recall=overlap.content_recall(F.col("reference"), F.col("hypothesis"))).withColumn("stratum", overlap.stratum(F.col("wer")))
    order = F.array_position(F.array(*map(F.lit, ("clean", "mild", "severe", "unknown"))), F.col("stratum"))
    s = e.groupBy("stratum").agg(F.count("*").alias("n"), F.percentile("wer", 0.5).alias("wer_median"), F.percentile("recall", 0.5).alias("recall_median"), overlap_total().alias("corpus_wer"))
    return s.select(order.alias("place"), "stratum", "n", *(r4(c).alias(c) for c in ("wer_median", "recall_median", "corpus_wer")))


def overlap_total():
    return F.try_divide(F.sum(F.expr("substitutions + deletions + insertions")), F.sum("ref_words"))


# DuckDB's word boundary knows ASCII only: other letters become a word character that no pattern matches.
ATOMS_SQL = f"""with t as (select doc_id, regexp_replace({MARKS.format('text')}, '[ªµºÀ-ÖØ-öø-ʯͰ-ӿ]', '_', 'g') as x from documents),
    a as (select doc_id, list_distinct(regexp_extract_all(x, '{T.YEAR}', 1)) as years, list_distinct(list_transform(regexp_extract_all(x, '{T.QUANTITY}'), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g'))) as qs, list_distinct(list_transform(regexp_extract_all(x, '{T.NAME_SPAN}'), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g'))) as ns from t)
    select doc_id, len(years)::bigint as years, len(list_filter(qs, lambda q: q <> '' and not regexp_full_match(q, '1[0-9]{{3}}|20[0-9]{{2}}')))::bigint as quantities, len(list_filter(ns, lambda s: not (regexp_split_to_array(s, '\\s+')[1] in {_list(T.SENTENCE_STARTERS)} and len(regexp_split_to_array(s, '\\s+')) < 3)))::bigint as names from a"""


@query("q33_audit_atoms", ATOMS_SQL)
def q33(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", T.audit_atoms(T.folded(F.col("text"))).alias("a"))
    return a.select("doc_id", *(F.size(f"a.{c}").cast("long").alias(c) for c in ("years", "quantities", "names")))


@query("q34_acceptance", "with i as (select d.lang as category, case when l.doc_id is null then null else d.n_chars <= 4000 end as pass, case when toxic is not null and d.doc_id % 5 > 0 then 5.0 - 2 * toxic end as safety, case when quality is not null then 2.0 + 2 * quality end as quality from documents d left join labels l using (doc_id)), v as (select *, case when pass is not null and safety is not null and quality is not null then pass and safety >= 4.0 and quality >= 3.5 end as accepted from i) select category, count(*) as n, count(accepted) as decided, count(*) - count(accepted) as undecided, round(avg(accepted::int), 4) as rate, round(avg(quality), 4) as quality_mean, min(safety)::double as worst_safety from v group by category")
def q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True)), "doc_id", "left")
    i = d.select(F.col("lang").alias("category"), F.when(F.col("labelled"), F.col("n_chars") <= 4000).alias("pass"), F.when(F.col("toxic").isNotNull() & (F.col("doc_id") % 5 > 0), 5.0 - 2 * F.col("toxic")).alias("safety"), F.when(F.col("quality").isNotNull(), 2.0 + 2 * F.col("quality")).alias("quality"))
    i = i.withColumn("accepted", compare.acceptance(F.col("pass"), F.col("safety"), F.col("quality"))["accepted"])
    i = i.select(F.lit("all").alias("run"), "category", "accepted", F.col("safety").alias("safety_minimum"), F.col("quality").alias("quality_composite"))
    s = evaluate.by_category(evaluate.blank_items(i))
    return s.select("category", "n", (F.col("n") - F.col("undecided")).alias("decided"), "undecided", r4("acceptance_rate").alias("rate"), r4("quality_mean").alias("quality_mean"), F.col("worst_safety").alias("worst_safety"))


@query("q35_answer_accuracy", f"with d as (select doc_id, n_chars, {answer_sql('text')} as p, doc_id % 3 = 0 as unsupported from documents), s as (select d.doc_id, case when unsupported then 'unanswerable' when b.item_id is not null and len({answer_sql('b.text')}) <= 30 then 'short' else 'long' end as subset, contains(' ' || array_to_string(p, ' ') || ' ', ' ' || array_to_string({answer_sql('b.text')}, ' ') || ' ') as hit from d join benchmark b on d.doc_id % (select count(*) from benchmark) = b.item_id) select coalesce(subset, 'all') as subset, count(*) as n, round(avg(hit::int), 4) as presence from s group by grouping sets ((subset), ())")
def q35(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    n = b.agg(F.count("*")).scalar()
    d = table(spark, sf_dir, "documents").select("doc_id", T.answer_tokens(T.folded(F.col("text"))).alias("p"), (F.col("doc_id") % 3 == 0).alias("unsupported"), (F.col("doc_id") % n).alias("item_id"))
    s = d.join(b.select("item_id", T.answer_tokens(T.folded(F.col("text"))).alias("r")), "item_id")
    s = s.select(F.lit("all").alias("run"), F.col("unsupported").alias("answer_unsupported"), F.size("r").alias("answer_words"), overlap.token_scores(F.col("p"), F.col("r")).alias("s"))
    s = s.withColumns({"answer_presence": F.col("s.presence"), "reference_exact_match": F.col("s.exact"), "reference_token_f1": F.col("s.f1")})
    return evaluate.answer_accuracy(s, 30).select("subset", "n", r4("presence").alias("presence"))


@query("q51_response_measures")
def q51(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).withColumn("sent", sentences("text"))
    return t.select("item", constraints.describe(F.col("text"), F.col("sent")).alias("m")).select("item", "m.*")
