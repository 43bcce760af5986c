"""Text functions: cleaning, sentences, tokens."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F

from pagemill.functions.patterns import ARTEFACT_LINES, PLAIN_QUOTES, QUOTES, STOPWORDS, WORD_TOKEN


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _two_places(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


def two_places(number: Column) -> Column:
    """A double with two decimals, rounded by its exact binary value: 0.595 lies below the half. Java's formats round 0.595 up."""
    return F.pandas_udf(_two_places, "string")(number.cast("double"))


#: what Unicode counts as white space
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends. Texts with plain letters there stay as they are."""
    plain = F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)
    return F.when(plain, text).otherwise(F.btrim(text, F.lit(SPACES)))


def compatible(text: Column) -> Column:
    """NFKC. ASCII texts don't change under it: Python gets a null for them."""
    nfkc = F.pandas_udf(_nfkc, "string")
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def plain_quotes(text: Column) -> Column:
    return F.translate(text, QUOTES, PLAIN_QUOTES)


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def without_artefacts(text: Column) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, f"(?imdU){p}", ""), ARTEFACT_LINES, text)


def single_spaces(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "\t", " "), " {2,}", " ")


def double_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


CLEANERS = [compatible, plain_quotes, without_controls, without_artefacts, single_spaces, double_newlines, strip]


def clean(text: Column, cleaners=CLEANERS) -> Column:
    """All cleaners in order. A custom list of column functions may be given."""
    return reduce(lambda t, f: f(t), cleaners, text)


def sentences(text: Column) -> Column:
    """Sentences: parts after a stop and white space, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(text, r"(?U)(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?U){WORD_TOKEN}"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+", -1), lambda w: w != ""))


def query_tokens(text: Column) -> Column:
    """Distinct query words without stop words and single letters; all words if none is left."""
    every = space_tokens(text)
    chosen = F.filter(every, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))
    return F.when(F.size(chosen) > 0, chosen).otherwise(every)


def normal_value(value: Column) -> Column:
    """Lower case without white space and commas."""
    return F.translate(F.lower(value), SPACES + ",", "")


def truncated(text: Column, size: int, keep: int | None = None) -> Column:
    keep = size if keep is None else keep
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def title_of(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")
