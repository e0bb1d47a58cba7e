"""Endpointing: scoring decoded segments of a parameter sweep, the delay model, and derived timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voicegauge.functions import text as T

STOCK_WAIT_MS = 700.0  # fixed value: the wait that an unset schedule comes to


def score_segments(runs: DataFrame) -> DataFrame:
    """runs (file, segments array of (at_s, flush, text, n_words, last_word_end_s), speech_end_s) with what its firings did.

    A firing before the last speech is a cut; the last firing with text closed
    the utterance, and its distance to the last word is the endpoint delay.
    """
    fires = F.filter("segments", lambda s: ~s["flush"])
    spoken = F.filter(fires, lambda s: s["text"] != "")
    cuts = F.filter(fires, lambda s: s["at_s"] < F.col("speech_end_s") - 1e-6)
    closing = F.try_element_at(spoken, F.lit(-1))
    at = F.get(cuts, F.lit(0))["at_s"]
    place = F.array_position(F.transform("segments", lambda s: ~s["flush"] & (s["at_s"] == at)), True).cast("int")
    words = F.aggregate(F.slice("segments", F.lit(1), F.greatest(place, F.lit(0))), F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    cut = F.coalesce(F.size(cuts) > 0, F.lit(False))
    n_spoken = F.size(F.filter("segments", lambda s: s["text"] != ""))
    return runs.select(
        *[c for c in runs.columns if c != "segments"], F.size(fires).alias("n_fires"), n_spoken.alias("n_spoken_segments"), (n_spoken > 1).alias("asr_split"), cut.alias("acoustic_cut"), F.when(cut, at).alias("first_cut_s"), F.when(cut, words).alias("words_at_first_cut"),
        closing.isNotNull().alias("endpointer_fired"), F.round((closing["at_s"] - closing["last_word_end_s"]) * 1000, 1).alias("endpoint_delay_ms"),
    )


def coverage(word_s: Column, speech_s: Column) -> Column:
    """Share of the speech that lies in recognised words; 0 without speech."""
    return F.when(speech_s > 0, F.round(word_s / speech_s, 3)).otherwise(0.0)


def simple_wer(reference: Column, hypothesis: Column) -> Column:
    """Word error rate of lightly normalised texts, 1 for an empty reference. Words become single characters beyond the basic plane, so the built-in edit distance of the JVM counts them."""

    def coded(xs: Column, words: Column) -> Column:
        codes = F.transform(xs, lambda w: F.lpad(F.hex(F.array_position(words, w) + 0xFFFF), 8, "0"))
        return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")

    def rate(x: Column, words: Column) -> Column:
        return F.when(F.size(x["r"]) == 0, 1.0).otherwise(F.round(F.levenshtein(coded(x["r"], words), coded(x["h"], words)) / F.size(x["r"]), 3))

    both = F.struct(T.sweep_tokens(reference).alias("r"), T.sweep_tokens(hypothesis).alias("h"))
    return T.bound(both, lambda x: T.bound(F.array_distinct(F.concat(x["r"], x["h"])), lambda words: rate(x, words)))


def joined_recordings(features: DataFrame, decoded: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """features by file with what was decoded, and what a second engine heard; a file that either of those lacks is an error."""
    out = features
    for other in (decoded, second) if second is not None else (decoded,):
        lost = out.select("file").join(other.select("file"), "file", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"not decoded: {[r.file for r in lost]}")
        out = out.join(other, "file")
    return out


def usable(speech_s: Column, n_words: Column, covered: Column, least: float, second_wer: Column | None = None, second_words: Column | None = None, second_prob: Column | None = None, most: float = 0.5) -> Column:
    """Whether a recording can tell anything: enough speech, words and coverage, and, if asked, a second engine that heard the same."""
    out = (speech_s >= 1.0) & (n_words >= 4) & (covered >= least)
    if second_wer is not None:
        out = out & F.coalesce((second_words >= 5) & (second_prob >= 0.5) & (second_wer <= most), F.lit(False))
    return out


def summarize(scored: DataFrame, by: tuple[str, ...] = ("chunk_ms", "label")) -> DataFrame:
    """One row a setting: counts and shares of cuts, splits and missing ends, and quantiles of the delay over usable recordings."""
    use = F.col("usable")
    on = lambda c: F.count_if(use & c)
    pct = lambda c: F.round(100 * on(c) / F.greatest(F.count_if(use), F.lit(1)), 2)
    delay = F.when(use, F.col("endpoint_delay_ms"))
    cut, split = F.col("acoustic_cut"), F.col("asr_split")
    return scored.groupBy(*by).agg(
        F.count("*").alias("n_all"), F.count_if(use).alias("n_usable"), F.count_if(cut).alias("cut_all"), on(cut).alias("cut_usable"), pct(cut).alias("cut_usable_pct"), on(split).alias("split_usable"), pct(split).alias("split_usable_pct"),
        on(~F.col("endpointer_fired")).alias("never_fired_usable"), F.percentile(delay, 0.5).alias("delay_p50_ms"), F.percentile(delay, 0.9).alias("delay_p90_ms"), F.round(F.avg(delay), 1).alias("delay_mean_ms"),
    )


def parse_schedule(text: Column) -> Column:
    """Waits of the three endpoint rules: N for all, or N/N/N."""
    parts = F.transform(F.split(F.trim(text), "/"), lambda x: x.try_cast("int"))
    return F.when(F.size(parts) == 1, F.array_repeat(F.get(parts, F.lit(0)), 3)).when(F.size(parts) == 3, parts)


def schedule_label(waits: Column) -> Column:
    return F.when(F.size(F.array_distinct(waits)) == 1, F.get(waits, F.lit(0)).cast("string")).otherwise(F.array_join(waits.cast("array<string>"), "/"))


def expected_delay(wait_ms: Column, chunk_ms: Column, tail: bool = False) -> Column:
    """Fitted delay of an endpoint: median, or 99th percentile."""
    wait = F.coalesce(wait_ms.cast("double"), F.lit(STOCK_WAIT_MS))
    return wait + 390 + 0.75 * chunk_ms if tail else wait + 280 + 0.40 * chunk_ms


def fit_delay(points: DataFrame) -> DataFrame:
    """(n, slope, intercept) of delay - wait over chunk, by least squares."""
    y = F.col("delay_ms") - F.col("wait_ms")
    return points.select("chunk_ms", y.alias("y")).agg(F.count("*").alias("n"), F.regr_slope("y", "chunk_ms").alias("slope"), F.regr_intercept("y", "chunk_ms").alias("intercept"))


def derived_timings(t: DataFrame) -> DataFrame:
    """t with first_chunk_fill, ttfa, endpoint_delay, stt_rtf and tokens_per_sec from a turn's raw times (ms, ns for the evaluation)."""
    return t.withColumns({
        "first_chunk_fill_ms": F.col("ttfc_ms") - F.col("ttft_ms"), "ttfa_ms": F.col("tts_first_t_ms") - F.col("speech_end_t_ms"), "endpoint_delay_ms": F.col("final_t_ms") - F.col("speech_end_t_ms"),
        "stt_rtf": F.try_divide("stt_ms", "input_duration_ms"), "tokens_per_sec": F.try_divide(F.col("eval_count"), F.col("eval_ns") / 1e9),
    })


def process_utilisation(samples: DataFrame, by: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Shares of a device's processes at one moment, added up to 100 at most."""
    return samples.groupBy(*by).agg(F.least(F.lit(100.0), F.sum("value")).alias("util"))
