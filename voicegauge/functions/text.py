"""Text measures as Spark columns. Only folded() leaves the JVM; what else can't be said in built-ins is in kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voicegauge.functions.kernels import nfkc

# Word pattern and word lists of the measures.
WORD = r"[0-9]+(?:[.,][0-9]+)*|\p{L}+(?:['’]\p{L}+)*"
ENGLISH_MARKERS = "the of and to in is it you that for on with as are this be have from or an but not they which was can your if there their what when how would should could about more".split()
STOPWORDS = (
    "a an the and or but if then than so as of to in on at by for with from into about is are was were be been being am do does did have has had can could will would shall should may might must "
    "i me my you your he she it its we they them their this that these those there here what which who whom how when where why not no yes please tell s t "
    "hello hi hey thanks thank okay ok well just like want need know think say said get give make good also some any much many more most"
).split()
SUFFIXES = ("ing", "edly", "ies", "ied", "es", "ed", "ly", "s")
ARTICLES = ("a", "an", "the")
SENTENCE_STARTERS = "The This That These Those It There They He She We You I A An As At But And Or If When While Although However Both Its Their Machine Start Absolutely Answer Yes No Sure Okay".split()
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
QUANTITY = r"(?i)\b\d+(?:[.,]\d+)*\s*(?:%|percent|kg|mg|ml|km|m|cm|hours?|minutes?|days?|weeks?|months?|years?)?\b"
NAME_SPAN = r"\b(?:[A-Z][a-z]+(?:\s+(?:of|de|van|der|the)\s+)?)(?:\s+[A-Z][a-z]+)+\b"


def bound(x: Column, f) -> Column:
    """f of x, which is computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def folded(text: Column) -> Column:
    """The text in NFKC; what is measured is measured of it. A kernel sees only texts with a character outside ASCII."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def plain_marks(text: Column) -> Column:
    """Curly quotes and dashes as straight ones."""
    return F.translate(text, "’‘“”–—", "''\"\"--")


def words(text: Column) -> Column:
    """Word tokens; numbers keep inner marks, letters inner apostrophes."""
    return F.regexp_extract_all(plain_marks(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def english_ratio(tokens: Column) -> Column:
    """Share of tokens that are frequent English function words; 0 without tokens."""
    hits = F.size(F.filter(tokens, lambda w: F.lower(w).isin(*ENGLISH_MARKERS)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(hits / F.size(tokens))


def estimated_tokens(n_words: Column, n_chars: Column) -> Column:
    """The larger of two rates, rounded half to even."""
    return F.bround(F.greatest(n_words * 1.33, n_chars / 6.0)).cast("long")


def spoken_seconds(n_words: Column, rate: float = 2.5) -> Column:
    return n_words / F.lit(rate) if rate > 0 else F.lit(0.0)


# The patterns of silent endings and vowel groups.
def syllables(word: Column) -> Column:
    """Vowel groups of at most two letters after silent endings; words of up to three letters have one."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    core = F.regexp_replace(F.regexp_replace(letters, "(?:[^laeiouy]es|[^laeiouy]e|ed)$", ""), "^y", "")
    groups = F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]{1,2}")))
    return F.when(letters == "", 0).when(F.length(letters) <= 3, 1).otherwise(groups)


def reading_ease(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)


def grade_level(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return 0.39 * (n_words / n_sentences) + 11.8 * (n_syllables / n_words) - 15.59


def rough_sentences(text: Column) -> Column:
    """Sentences by closing marks before a blank or the end; kernels.sentences knows abbreviations."""
    return F.filter(F.split(F.trim(plain_marks(text)), r"[.!?][\"')\]}…]*(?:\s+|$)"), lambda s: F.trim(s) != "")


def answer_tokens(text: Column) -> Column:
    """Lower case, without apostrophes and articles."""
    plain = F.transform(words(text), lambda w: F.translate(F.lower(w), "'’", ""))
    return F.filter(plain, lambda w: (w != "") & ~w.isin(*ARTICLES))


def stem(token: Column) -> Column:
    """The token without the first suffix of the list that leaves more than three letters."""
    out = token
    for suffix in reversed(SUFFIXES):
        cut = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        out = F.when((F.length(token) > len(suffix) + 3) & token.endswith(suffix), cut).otherwise(out)
    return out


def content_tokens(text: Column) -> Column:
    """Stems of the topical words."""
    bare = F.transform(words(text), lambda w: F.regexp_replace(F.lower(w), "['’]s?$", ""))
    return F.transform(F.filter(bare, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS)), stem)


def audit_atoms(text: Column) -> Column:
    """struct(years, quantities, names): spans that commit to something checkable, sorted and distinct."""
    plain = plain_marks(text)
    found = lambda pattern, group: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(pattern), F.lit(group)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))))
    years = found(YEAR, 1)
    quantities = F.filter(found(QUANTITY, 0), lambda q: (q != "") & ~q.rlike("^(1[0-9]{3}|20[0-9]{2})$"))
    names = F.filter(found(NAME_SPAN, 0), lambda s: ~(F.split(s, r"\s+")[0].isin(*SENTENCE_STARTERS) & (F.size(F.split(s, r"\s+")) < 3)))
    return F.struct(years.alias("years"), quantities.alias("quantities"), names.alias("names"))


def excerpt(text: Column, most: int = 60) -> Column:
    """A text on one line, cut with three dots where it is longer."""
    flat = F.trim(F.regexp_replace(plain_marks(folded(text)), r"\s+", " "))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 3), F.lit("...")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def item_key(path: Column) -> Column:
    """A path's stem."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1), r"(?<=.)\.[^.]*$", "")


def sweep_tokens(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9' ]", " ")), " +"), lambda w: w != "")


# The patterns of formatting marks and lead-ins.
def loose_variants(text: Column) -> Column:
    """The text and seven rewrites that change its formatting only."""
    bold = F.regexp_replace(text, r"(?s)\*\*(.+?)\*\*", "$1")
    italic = F.regexp_replace(bold, r"(?s)(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "$1")
    plain = F.regexp_replace(F.regexp_replace(italic, r"(?m)^\s{0,3}#{1,6}\s*", ""), r"(?m)^\s*[-*+]\s+", "")
    no_lead = lambda t: F.regexp_replace(t, r"(?i)^\s*(?:answer|response|assistant|sure|okay)\s*[:\-]\s*", "")
    lines = lambda t: F.split(F.trim(t), r"\r\n|\n|\r")
    part = lambda t, first: F.when(F.size(lines(t)) > 1, F.trim(F.array_join(F.slice(lines(t), F.lit(2 if first else 1), F.greatest(F.size(lines(t)) - 1, F.lit(0))), "\n"))).otherwise(t)
    return F.array(text, plain, no_lead(text), part(text, True), part(text, False), no_lead(plain), part(plain, True), part(part(plain, True), False))
