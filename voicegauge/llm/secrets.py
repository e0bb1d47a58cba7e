"""Secret scans: fixed patterns, and runs of characters that a Markov model of random strings explains better than one of identifiers.

Both models are first-order chains over characters, trained on labelled
samples; the ordinary ones are identifiers made of words of the documents. The
random class has one chain for each alphabet that its samples
show (digits and a-f, digits and A-F, one case with digits, all); a run takes
the best. A run is a secret where the log-likelihood ratio to the ordinary
chain passes a threshold, in all and for each character. Of a run that doesn't
pass as a whole, its best parts are judged. What base patterns cover is left out.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voicegauge.llm import _words as W
from voicegauge.llm._store import Store

# The base patterns of the scan.
ASSIGN = re.compile(r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")
_KEYS = re.compile(rb"password|passwd|secret|token|api_?key")

ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
_ALPHABETS = (b"0123456789abcdef", b"0123456789ABCDEF", b"0123456789abcdefghijklmnopqrstuvwxyz", b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PARTS = "get set user name file path list data index value key map node tree array string number count first last next time date page view model table query join group order sort filter parse write read open close start stop create delete update insert select from where with request response server client session config option default error message handler manager factory service context thread process memory buffer stream channel socket address network protocol version system module package import export function method class object property attribute element container window document application information international administration configuration implementation transformation representation understanding communication characteristic responsibility environment development management performance experience opportunity government particular different available important following according although however therefore nevertheless schule lichkeit gesellschaft verwaltung entwicklung wissenschaft tionnement gouvernement naturellement ensemble conocimiento informaciones desarrollo".split()


def ordinary_words(docs: DataFrame, text: str, most: int, held_out: bool = False) -> list[str]:
    """At most `most` words of 3 to 24 letters that stand in three documents or more, chosen by a hash.

    Counted over whole texts of all documents. One word in five (crc32 modulo 5
    is 0) is held out: nothing learns from it, and tests measure with it.
    """
    own = docs.select(F.explode(F.array_distinct(F.split(text, "[^A-Za-z]+"))).alias("word"))
    own = own.where(F.length("word").between(3, 24)).where((F.crc32("word") % 5 == 0) == F.lit(held_out))
    counts = Store(docs.sparkSession, "words").keep(own.groupBy("word").agg(F.count("*").alias("n")).where("n >= 3"))
    share = -(-counts.count() // most)  # so many words for each that is taken
    taken = counts.where(F.pmod(F.xxhash64("word"), F.lit(max(1, share))) == 0)
    return sorted(r.word for r in taken.select("word").collect())[:most]


def labelled_samples(words: list[str] = (), seed: int = 7, n: int = 8000) -> list[tuple[str, int]]:
    """(string, 1 for random or 0 for an ordinary identifier), made from the seed; identifiers are put together of words and of parts of program names."""
    r = random.Random(seed)
    base = ALPHABET[:62].decode()
    known = [*words, *_PARTS * max(1, len(words) // (3 * len(_PARTS)))]
    out = []
    for i in range(n):
        chars = [*(a.decode() for a in _ALPHABETS), base, base + "+/", base + "_-"][i % 7]
        out.append(("".join(r.choices(chars, k=r.randint(20, 48))), 1))
        parts = [r.choice(known) for _ in range(r.randint(1, 6))]
        out.append((identifier(parts, i % 7) + (str(r.randint(1, 99)) if i % 9 == 0 else ""), 0))
    return out


def identifier(parts: list[str], style: int) -> str:
    """Words run together, with marks between them, with capitals, or as a path."""
    if style < 2:
        return "".join(parts)
    if style == 4:
        return "".join(p.title() for p in parts)
    name = {2: "_", 3: "-", 5: "_", 6: "/"}[style].join(parts)
    return name.upper() if style == 5 else name


@dataclass
class Markov:
    """Log probabilities: of each alphabet's random chain and of the ordinary one, first characters in the last row."""

    random: np.ndarray
    ordinary: np.ndarray

    def ratio(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The log-likelihood ratio of each run data[start:end]."""
        if not len(start):
            return np.zeros(0)
        size = end - start
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(size.sum()) - np.repeat(first - start, size)
        code = _CODE[data[at]]
        before = np.append(len(ALPHABET), code[:-1])
        before[first] = len(ALPHABET)
        return np.max([np.add.reduceat(chain[before, code], first) for chain in self.random], 0) - np.add.reduceat(self.ordinary[before, code], first)


    def parts(self, run: np.ndarray, least: int, total: float, each: float) -> list[tuple[int, int]]:
        """(start, end) of what passes in a run that doesn't as a whole: its pieces between marks, and each chain's best segments, out to the marks around them where those pass too."""
        code = _CODE[run]
        gain = np.stack([c[:-1][code[:-1], code[1:]] for c in self.random]) - self.ordinary[:-1][code[:-1], code[1:]]
        first = (self.random[:, -1, code] - self.ordinary[-1, code])
        marks = np.flatnonzero(code >= 62)
        found = []

        def passes(a, b):
            if b - a < least:
                return False
            got = (first[:, a] + gain[:, a : b - 1].sum(1)).max()
            return got >= total and got >= each * (b - a)

        edges = [-1, *marks.tolist(), len(run)]
        found += [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if passes(a + 1, b)]
        for own in gain:
            stack = [(0, len(run))]
            while stack:
                a, b = stack.pop()
                if b - a < least:
                    continue
                if _best(own[a : b - 1])[2] + np.abs(first[:, a:b]).max() < total:
                    continue
                x, y, _ = _best(own[a : b - 1] - each)
                if y == x:
                    continue
                x, y = a + x, a + y + 1
                at = np.searchsorted(marks, x), np.searchsorted(marks, y)
                out = (int(marks[at[0] - 1]) + 1 if at[0] else 0, int(marks[at[1]]) if at[1] < len(marks) else len(run))
                found += [out] if passes(*out) else [(x, y)] if passes(x, y) else []
                stack += [(a, x), (y, b)]
        joined: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        return joined


def _best(x: np.ndarray) -> tuple[int, int, float]:
    """(start, end, sum) of the segment of the greatest sum; an empty one where none is above 0."""
    run = np.concatenate([[0.0], np.cumsum(x)])
    rise = run - np.minimum.accumulate(run)
    end = int(rise.argmax())
    return int(run[: end + 1].argmin()), end, float(rise[end])


def fit(samples: list[tuple[str, int]], back: float = 0.3) -> Markov:
    """Chains of the labelled samples.

    A transition's probability is by `back` that of the kinds of its characters
    (upper, lower, digit, mark), evenly over a kind. Letters that never
    followed each other in the samples, as in words not among them, tell little
    against a run of letters; changes between kinds tell much.
    """
    n = len(ALPHABET)
    kind = np.array([0] * 26 + [1] * 26 + [2] * 10 + [3] * 5)

    def chain(strings, allowed=None):
        c = np.zeros((n + 1, n))
        for s in strings:
            code = _CODE[np.frombuffer(s.encode("ascii", "ignore"), np.uint8)]
            code = code[code < n]
            if len(code):
                c[n, code[0]] += 1
                np.add.at(c, (code[:-1], code[1:]), 1)
        by = np.zeros((n + 1, n))
        kinds = np.append(kind, 4)
        for a in range(5):
            rows = c[kinds == a].sum(0) + 1e-9
            for b in range(4):
                by[np.ix_(kinds == a, kind == b)] = (rows[kind == b].sum() + 1) / (kind == b).sum()
        by /= by.sum(1, keepdims=True)
        total = c.sum(1, keepdims=True)
        p = (1 - back) * (c + 6 * by) / (total + 6) + back * by
        if allowed is not None:
            out = np.ones(n, bool)
            out[_CODE[list(allowed)]] = False
            p[:, out] = 1e-9
        return np.log(p)

    ones = [s for s, y in samples if y == 1]
    sets = []
    for a in (*_ALPHABETS, ALPHABET):
        own = [s for s in ones if set(s.encode("ascii", "ignore")) <= set(a)] if a is not ALPHABET else ones
        if own:
            sets.append(chain(own, None if a is ALPHABET else a))
    return Markov(np.stack(sets), chain([s for s, y in samples if y == 0]))


def _runs(ok: np.ndarray, cut: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of at least `least`; none goes over a cut."""
    here = np.zeros(len(ok) + 1, bool)
    here[cut] = True
    start = np.flatnonzero(ok & (np.append(True, ~ok[:-1]) | here[:-1]))
    end = np.flatnonzero(ok & (np.append(~ok[1:], True) | here[1:])) + 1
    long = end - start >= least
    return start[long], end[long]


def _lut(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_HEX, _IS_RUN = _lut(b"0123456789abcdef"), _lut(ALPHABET)


def scan(w: W.Words, model: Markov, least: int = 20, total: float = 12.0, each: float = 0.35) -> dict[int, list[tuple[int, int, int]]]:
    """Of texts with any: the spans (start, end, number of the kind) in code points, by start, then kind."""
    data, offsets = w.data, w.offsets
    raw = data.tobytes()
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not raw:
        return out
    doc_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])

    def add(doc, start, end, kind):
        base = point[offsets[doc]]
        out.setdefault(int(doc), []).append((int(point[start] - base), int(point[end] - base), kind))

    taken = []
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    for doc in {int(doc_of(m.start())) for m in _KEYS.finditer(raw.lower())}:
        text = raw[offsets[doc] : offsets[doc + 1]].decode("utf-8", "surrogateescape")
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                out.setdefault(doc, []).append((m.start(), m.end(), 0))
                a, b = (offsets[doc] + len(text[: m.start(g)].encode("utf-8", "surrogateescape")) for g in (0, 2))
                taken.append((a, b + len(m[2])))
    at = raw.find(b"AKIA")
    docs = set()
    while at >= 0:
        docs.add(int(doc_of(at)))
        at = raw.find(b"AKIA", at + 4)
    for doc in docs:
        text = raw[offsets[doc] : offsets[doc + 1]]
        for m in ACCESS.finditer(text):
            if len(m[0]) >= 18:
                add(doc, offsets[doc] + m.start(), offsets[doc] + m.end(), 1)
                taken.append((offsets[doc] + m.start(), offsets[doc] + m.end()))
    start, end = _runs(_IS_HEX[data], cut, 16)
    for a, b, doc in zip(start, end, doc_of(start), strict=True):
        add(doc, a, b, 2)
        taken.append((a, b))
    start, end = _runs(_IS_RUN[data], cut, least)
    if len(start):
        # base spans stay; what they leave of a run is judged by itself
        covered = np.zeros(len(data) + 1, np.int32)
        for a, b in taken:
            covered[a] += 1
            covered[b] -= 1
        covered = np.cumsum(covered[:-1]) > 0
        start, end = _runs(_IS_RUN[data] & ~covered, cut, least)
    ratio = model.ratio(data, start, end)
    for a, b, got, doc in zip(start, end, ratio, doc_of(start), strict=True):
        whole = got >= total and got >= each * (b - a)
        for x, y in [(0, b - a)] if whole else model.parts(data[a:b], least, total, each):
            add(doc, a + x, a + y, 3)
    for found in out.values():
        found.sort(key=lambda s: (s[0], s[2], s[1]))
    return out


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: list[tuple[str, int]] | None = None, words: int = 20_000) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)) of every row of docs; start and end count code points, end exclusive.

    Kinds: assign, access and hex by the base patterns, leftmost and not
    overlapping within a kind; markov: further runs that the model trained on
    samples takes for random. Ordered by start, then kind. The default samples
    are random strings, and identifiers of at most `words` ordinary_words() of
    docs; the bound is on what is learnt from, and every row is scanned.

    Null and empty texts have none. Repeated rows are each scanned. Further
    columns are ignored, whatever their names. Empty table: empty result.
    """
    Store(docs.sparkSession, "secrets")
    if samples is None:
        samples = labelled_samples(ordinary_words(docs, text, words))
    model = docs.sparkSession.sparkContext.broadcast(fit(samples))

    def rows(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for lo, hi, w in W.chunks(b.column(1), hashed=False):
                found = scan(w, model.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([[{"kind": KINDS[k], "start": a, "end": z} for a, z, k in found.get(i, ())] for i in range(hi - lo)], kind)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(rows, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")
