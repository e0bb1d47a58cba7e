"""Judges behind a function: prompt in, text out. The client is a parameter; stub() answers the same to the same prompt without any network."""

from __future__ import annotations

import functools
import json
import re
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voicegauge.functions.kernels import json_object, score_of

Client = Callable[[str], str]


def stub(prompt: str) -> str:
    """A fixed answer for tests: a score in the range that the prompt names, claims, labels or a winner."""
    h = zlib.crc32(prompt.encode())
    if "claims" in prompt:
        return '{"claims": [' + ", ".join(f'"claim {i}"' for i in range(1 + h % 3)) + "]}"
    if "supported" in prompt:
        return '{"label": "' + ("supported", "unsupported", "irrelevant")[h % 3] + '"}'
    if "winner" in prompt:
        return '{"winner": "' + "AB"[h % 2] + '"}'
    m = re.search(r"(-?\d+) to (-?\d+)", prompt)
    low, high = (int(m[1]), int(m[2])) if m else (1, 5)
    return f'{{"score": {low + h % (high - low + 1)}}}'


class Reply(str):
    """A reply that knows how many tokens it took; a client may return one, or a plain string."""

    tokens: int | None = None


@functools.cache
def reachable(url: str, seconds: float = 2.0) -> bool:
    """Whether a model server answers; asked once a process."""
    try:
        with urllib.request.urlopen(f"{url}/api/tags", timeout=seconds) as r:
            return r.status == 200
    except OSError:
        return False


@dataclass(frozen=True)
class HttpClient:
    """A model behind an HTTP server that takes {model, prompt, options} at /api/generate and answers {response, eval_count, prompt_eval_count}.

    It is sent to the tasks, and each call opens its own connection. Failures
    of the connection and of the server are worth another try; a request that
    the server refuses isn't.
    """

    url: str
    model: str
    temperature: float = 0.0
    seed: int = 0
    seconds: float = 120.0

    def __call__(self, prompt: str) -> str:
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": self.temperature, "seed": self.seed}}
        asked = urllib.request.Request(f"{self.url}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(asked, timeout=self.seconds) as r:
                said = json.load(r)
        except urllib.error.HTTPError as e:
            if e.code < 500:
                raise ValueError(f"refused: {e.code} {e.reason}") from e
            raise ConnectionError(str(e)) from e
        except urllib.error.URLError as e:
            raise ConnectionError(str(e.reason)) from e
        out = Reply(said.get("response") or "")
        out.tokens = sum(said.get(k) or 0 for k in ("prompt_eval_count", "eval_count"))
        return out


def with_retries(client: Client, times: int = 2) -> Client:
    """client, asked again after a transport failure; a refusal isn't repeated."""

    def ask(prompt: str) -> str:
        for left in range(times, -1, -1):
            try:
                return client(prompt)
            except (ConnectionError, TimeoutError):
                if not left:
                    raise
        raise AssertionError

    return ask


#: Replies that a task holds before it passes them on.
HELD = 1000


def ask_all(prompts: DataFrame, key: list[str], client: Client, retries: int = 2) -> DataFrame:
    """key columns, reply, error, tokens and seconds of each prompt; calls are made where the rows are, and a prompt is text only while it's asked."""
    kinds = dict(prompts.dtypes)

    def answers(asked: pa.RecordBatch, ask: Client) -> pa.RecordBatch:
        out = []
        for p in asked.column("prompt"):
            begun = time.monotonic()
            try:
                said = ask(p.as_py())
                out.append((str(said), None, getattr(said, "tokens", None), time.monotonic() - begun))
            except Exception as e:  # a failed call is a result: the item has no score
                out.append((None, str(e), None, time.monotonic() - begun))
        made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)]
        return pa.RecordBatch.from_arrays([*(asked.column(k) for k in key), *made], [*key, "reply", "error", "tokens", "seconds"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = with_retries(client, retries)
        for batch in batches:
            for i in range(0, batch.num_rows, HELD):
                yield answers(batch.slice(i, HELD), ask)

    made = ", ".join([*(f"{k} {kinds[k]}" for k in key), "reply string", "error string", "tokens long", "seconds double"])
    return prompts.select(*key, "prompt").mapInArrow(rows, made)


def rubric_judge(items: DataFrame, rubric: DataFrame, client: Client = stub, samples: int = 1, model: str = "stub") -> DataFrame:
    """(item, model, dimension, sample, score) of items (item, question, answer) by each dimension (dimension, low, high)."""
    prompt = F.concat_ws("\n", F.concat(F.lit("Rate "), "dimension", F.lit(" from "), F.col("low").cast("string"), F.lit(" to "), F.col("high").cast("string")), "question", "answer", F.concat(F.lit("sample "), F.col("sample").cast("string")))
    scale = rubric.agg(F.collect_list(F.struct("dimension", "low", "high")).alias("d"))  # one row: a rubric has a few dimensions
    asked = items.crossJoin(scale).select("*", F.inline("d")).drop("d").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("prompt", prompt)
    replies = ask_all(asked, ["item", "dimension", "low", "high", "sample"], client)

    @F.pandas_udf("int")
    def score(reply: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([score_of(r, int(a), int(b)) if r else None for r, a, b in zip(reply, low, high, strict=True)], dtype="Int32")

    return replies.select("item", F.lit(model).alias("model"), "dimension", "sample", score("reply", "low", "high").cast("double").alias("score"))


def pairwise(pairs: DataFrame, client: Client = stub) -> DataFrame:
    """(item, first, second, winner, consistent) of answers a and b asked in both orders; a verdict that follows the order is a tie."""
    both = pairs.select("item", F.explode(F.array(F.struct(F.lit("ab").alias("ord"), F.concat_ws("\n", F.lit("winner A or B?"), "question", "a", "b").alias("prompt")), F.struct(F.lit("ba").alias("ord"), F.concat_ws("\n", F.lit("winner A or B?"), "question", "b", "a").alias("prompt")))).alias("x")).select("item", "x.*")
    said = ask_all(both, ["item", "ord"], client).withColumn("w", F.regexp_extract("reply", r'"winner"\s*:\s*"(\w+)"', 1))
    own = F.when(F.col("w").isin("A", "B"), F.when(F.col("ord") == "ab", F.col("w")).otherwise(F.when(F.col("w") == "A", "B").otherwise("A"))).otherwise("tie")
    out = said.groupBy("item").agg(F.max(F.when(F.col("ord") == "ab", own)).alias("first"), F.max(F.when(F.col("ord") == "ba", own)).alias("second"))
    return out.withColumn("winner", F.when(F.col("first") == F.col("second"), F.col("first")).otherwise("tie")).withColumn("consistent", F.col("first") == F.col("second"))


def joined_answers(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item, question, a, b): the answers of two runs (stt_text, llm_text, pos) to the same question without regard to case and blanks; the last of several counts."""
    key = F.lower(F.regexp_replace(F.trim("stt_text"), r"\s+", " "))
    own = lambda d, n: d.select(key.alias("item"), F.col("stt_text").alias("q"), F.col("llm_text").alias("t"), "pos").groupBy("item").agg(F.max_by("q", "pos").alias("question"), F.max_by("t", "pos").alias(n))
    return own(a, "a").join(own(b, "b").drop("question"), "item").select("item", "question", "a", "b")


def tallies(verdicts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Wins of either side, ties and verdicts that don't follow the order, for each dimension of by."""
    return verdicts.groupBy(*by).agg(F.count_if(F.col("winner") == "A").alias("a"), F.count_if(F.col("winner") == "B").alias("b"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if("consistent").alias("consistent"))


def self_check(support: DataFrame, flag: float = 0.6) -> DataFrame:
    """(item, mean, max, flagged) of support (item, sentence, sample, other, score): 1 - the mean over resamples of the best support of each sentence."""
    best = support.groupBy("item", "sentence", "sample").agg(F.max("score").alias("s"))
    each = best.groupBy("item", "sentence").agg((1 - F.avg("s")).alias("x"))
    return each.groupBy("item").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.count_if(F.col("x") >= flag).alias("flagged"))


@F.udtf(returnType=T.StructType([T.StructField("claim_no", T.IntegerType()), T.StructField("claim", T.StringType())]))
class Claims:
    """One row a claim of a judge's reply: distinct without regard to case, the first `most`."""

    def eval(self, reply: str, most: int):
        seen: dict[str, str] = {}
        for c in (json_object(reply or "") or {}).get("claims") or []:
            text = str(c).strip()
            if text:
                seen.setdefault(text.lower(), text)
        for i, c in enumerate(list(seen.values())[:most]):
            yield i, c


def fact_precision(labels: DataFrame) -> DataFrame:
    """(item, n_claims, precision): supported over supported and unsupported; irrelevant claims don't count."""
    yes, no = F.count_if(F.col("label") == "supported"), F.count_if(F.col("label") == "unsupported")
    return labels.groupBy("item").agg(F.count("*").alias("n_claims"), F.try_divide(yes, yes + no).alias("precision"))


def cost(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("failures"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
