"""The language of a text by its most frequent small words, inside the JVM. A plain profile for filters; it needs no training."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrove.functions.text import let, text

#: Frequent small words of each language (fixed values).
SMALL_WORDS = {
    "de": "aber als am an auf aus bei das dass dem den der des die durch ein eine einer es für ihre im ist mit nach nicht oder sich sind und von war werden wie wird zu zur",
    "en": "and are as at be been by for from has have in is it its more not of on or such than that the their these this to was we were which with",
    "es": "al como con de del el en entre es esta este la las lo los más no o para pero por que se sobre su sus también un una y",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il la le les leur mais ne ont ou par pas plus pour qui que sa ses son sont sur un une",
    "it": "al alla anche che come con da dal dei del della delle di e è gli ha i il in la le lo nel nella non per più questo si sono su tra un una",
    "pt": "a ao aos as com como da das de do dos e em entre é foi mais na nas no nos não o os ou para pela pelo por que se seu sua são um uma",
}


def small_words(code: str) -> tuple[str, ...]:
    return tuple(SMALL_WORDS[code].split())


def detected(c: Column | str, least: int = 2) -> Column:
    """A struct (language, share): the language most of whose small words a text has, and their share of its words.

    Repeated words count as often; of equal languages the first code is taken. Null and empty texts, and those with
    fewer than ``least`` such words, have no language and share 0.
    """

    def of(words: Column, code: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*small_words(code))))

    def judged(words: Column) -> Column:
        scores = F.array(*(F.struct(of(words, code).alias("n"), F.lit(-i).alias("order"), F.lit(code).alias("language")) for i, code in enumerate(sorted(SMALL_WORDS))))
        return let(F.array_max(scores), lambda s: F.struct(F.when(s["n"] >= least, s["language"]).alias("language"), F.when(s["n"] >= least, F.round(s["n"] / F.size(words), 6)).otherwise(0.0).alias("share")))

    return let(F.regexp_extract_all(F.lower(text(c)), F.lit(r"(\p{L}+)"), 1), judged)
