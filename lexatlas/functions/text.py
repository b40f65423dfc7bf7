"""Text expressions: cleaning, tokens, counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters that count as white space when a URL ends, beside the ASCII ones.
SPACE_CLASS = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
URL_PATTERN = f"http[^{SPACE_CLASS}]+|www[^{SPACE_CLASS}]+"
SENTENCE_END = r"[.!?]+"

# The English list of Spark's StopWordsRemover without the contractions, which
# cannot survive the cleaning, and without one-letter words, which the tokeniser drops.
STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom "
    "this that these those am is are was were be been being have has had having do does did "
    "doing an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very can will just don should now "
    "cannot could ought would"
).split()


def text_length(text: str | Column) -> Column:
    return F.length(text).cast("double")


def sentence_count(text: str | Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END)).cast("double")


def clean_text(text: str | Column, keep: str = "a-z") -> Column:
    """Lower case, URLs out, everything but letters to blanks, blanks squeezed.

    ``keep`` is the class of letters to keep; widen it (``a-zà-ÿ``) for accented languages.
    """
    c = F.lower(text)
    c = F.regexp_replace(c, URL_PATTERN, "")
    c = F.regexp_replace(c, rf"[^{keep}]+", " ")
    return F.trim(c)


def tokens(clean: str | Column, stop_words=STOP_WORDS) -> Column:
    """Words of at least two letters that are no stop words."""
    words = F.split(clean, " ")
    if not stop_words:
        return F.filter(words, lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(list(stop_words)))


def unigrams_and_bigrams(words: Column) -> Column:
    """The words followed by the pairs of neighbours inside the same document."""
    n = F.size(words)
    pairs = F.when(
        n >= 2,
        F.zip_with(
            F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def prefixed(text: str | Column, prefix: str) -> Column:
    """Fixed instruction or role prefix in front of the text to be embedded."""
    return F.concat(F.lit(prefix), F.col(text) if isinstance(text, str) else text)
