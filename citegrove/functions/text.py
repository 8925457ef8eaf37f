"""Text normalisation as Column expressions (whole-stage codegen, no Python at run time).

Nulls: every function reads null as the empty text; what it returns for that is stated per function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks: Unicode white space and the four ASCII separators.
ODD_BLANK = r"[\t-\r\u001c-\u001f\u0085   -     　]"
BLANK = "[ " + ODD_BLANK[1:]
#: What collapsing changes: runs with a blank other than a space, or of two spaces. Single spaces are left alone.
BLANK_RUN = f" *+{ODD_BLANK}{BLANK}*+| {{2,}}+"
NOT_BLANK_PAREN = "[^()" + BLANK[1:]
#: A DOI name in running text: brackets count only as balanced groups (two levels), so a closing bracket around the
#: name is never taken for a part of it. Possessive and bounded, so that no text makes the matcher recurse deeply.
DOI = rf"(?<![0-9])10\.[0-9]+{BLANK}*/{BLANK}*(?:{NOT_BLANK_PAREN}++|\((?:{NOT_BLANK_PAREN}++|\({NOT_BLANK_PAREN}*+\)){{0,50}}\)){{1,200}}"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def squeeze(c: Column | str) -> Column:
    """Blanks trimmed and collapsed to one space; null gives ''."""
    return F.trim(F.regexp_replace(text(c), BLANK_RUN, " "))


def plain(c: Column | str) -> Column:
    """Blanks trimmed and collapsed, lower case; null gives ''."""
    return squeeze(F.lower(text(c)))


def doi_name(c: Column | str) -> Column:
    """The DOI name in a field, in lower case, or null where there is none.

    Read through: URL and ``doi:`` forms, %-escapes, zero-width characters, blanks around the slash, brackets,
    quotes and final marks around the name.
    """
    decoded = lambda s: F.when(s.contains("%"), F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)).otherwise(s)
    s = F.lower(let(F.regexp_replace(text(c), r"\p{Cf}+", ""), decoded))
    hit = F.regexp_replace(F.regexp_extract(s, DOI, 0), r"[^\p{L}\p{N})]+$|" + BLANK + "+", "")
    return let(hit, lambda h: F.when(h.rlike(r"^10\.[0-9]+/."), h))


#: A DOI name as most references write it, which needs no further reading.
BARE_DOI = r"^ *10\.[0-9]+/[a-z0-9._:/-]*[a-z0-9] *$"


def ref_name(c: Column | str) -> Column:
    """A cited reference: its DOI name, else its plain text. Bare names and texts without any are settled first."""
    x = text(c)
    return F.when(x.rlike(BARE_DOI), F.trim(x)).when(~x.contains("10.") & ~x.rlike(r"[%\p{Cf}]"), plain(x)).otherwise(F.coalesce(doi_name(x), plain(x)))


def split_auto(c: Column | str) -> Column:
    """Split on ``;`` if the field has one, else on ``,``; values trimmed, empty ones dropped."""
    s = text(c)
    return _trimmed(F.split(s, F.when(s.contains(";"), F.lit(";")).otherwise(F.lit(","))))


def split_semicolon(c: Column | str) -> Column:
    """Split on ``;``; values trimmed, empty ones dropped."""
    return _trimmed(F.split(text(c), F.lit(";")))


#: Blanks that are trimmed around list values.
EDGE_BLANKS = " \t\n\r\x0b\x0c\u00a0"


def trimmed(c: Column | str) -> Column:
    return F.btrim(text(c), F.lit(EDGE_BLANKS))


def _trimmed(values: Column) -> Column:
    return F.filter(F.transform(values, lambda x: F.btrim(x, F.lit(EDGE_BLANKS))), lambda x: x != "")


def field_values(field: str, c: Column | str) -> Column:
    """The item list of ``keywords`` (plain), ``authors`` (case kept) or ``refs`` (references), repeats kept."""
    s = text(c)
    if field == "keywords":
        values = F.split(plain(s), F.when(s.contains(";"), F.lit(";")).otherwise(F.lit(",")))
        return _trimmed(values)
    if field == "authors":
        return _trimmed(F.split(squeeze(s), F.lit(";")))
    if field == "refs":
        return F.filter(F.transform(F.split(s, F.lit(";")), ref_name), lambda x: x != "")
    raise ValueError(f"no item field: {field}")


def strip_tags(c: Column | str) -> Column:
    """Markup tags replaced by a blank, blanks collapsed and trimmed."""
    s = text(c)
    return squeeze(F.when(s.contains("<"), F.regexp_replace(s, r"<[^>]+>", " ")).otherwise(s))


#: Texts that only say that there is none, compared after lower case and without marks (fixed values).
NO_ABSTRACT = (
    "", "none", "na", "nan", "null", "nil", "missing", "empty", "unknown", "not available", "unavailable", "abstract", "summary",
    "no abstract", "no abstract available", "no abstract provided", "no abstract found", "abstract not available", "abstract unavailable",
    "abstract missing", "abstract not provided", "missing abstract", "no summary", "no summary available", "not provided",
    "sem resumo", "resumo indisponível", "resumo não disponível", "resumo nao disponivel", "sem resumo disponível",
    "sin resumen", "resumen no disponible", "sans résumé", "pas de résumé", "résumé non disponible", "aucun résumé",
    "kein abstract", "keine zusammenfassung", "kein abstract verfügbar", "abstract nicht verfügbar", "ohne zusammenfassung",
    "nessun abstract", "senza abstract", "riassunto non disponibile", "abstract non disponibile", "nessun riassunto",
)


#: Longer texts say more than that there is none.
LONGEST_NOTE = 60


def real_abstract(c: Column | str) -> Column:
    """The abstract without tags; null where it is missing or only says that there is none."""

    def kept(s: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"n\s*/\s*a|n\.\s*a\.?", "na"), r"[^\p{L}\p{N}]+", " "))
        return F.when((F.length(s) > LONGEST_NOTE) | ~bare.isin(*NO_ABSTRACT), s)

    return let(strip_tags(c), kept)


def normalised_doi(c: Column | str) -> Column:
    """The simple DOI form of the corpus tools: lower, trim, five prefixes removed in order, final slashes removed."""
    s = trimmed(F.lower(text(c)))
    for prefix in ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"):
        s = F.regexp_replace(s, f"^{prefix}[ ]*", "")
    return F.regexp_replace(s, "/+$", "")


def normalised_title(c: Column | str) -> Column:
    """Lower case, everything but letters, digits, underscores and blanks removed, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{M}\p{N}_\s]", ""), r"\s+", " "))


def dedup_key(c: Column | str) -> Column:
    """Lower case, marks replaced by a blank, blanks collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{M}\p{N}_\s]|_", " "), r"\s+", " "))


def first_surname(c: Column | str) -> Column:
    """The text before the first ``;`` and then before the first ``,``, trimmed, lower case."""
    return F.lower(trimmed(F.substring_index(F.substring_index(text(c), ";", 1), ",", 1)))


def year_of(c: Column | str) -> Column:
    """The first whole number 1900-2099 in a text, else 0."""
    found = F.regexp_extract(text(c), r"\b((?:19|20)[0-9]{2})\b", 1)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("int"))


def label_answers(c: Column | str) -> Column:
    """An array of structs (cluster_id, label) from lines "number: label" of an answer; other lines are left out."""
    found = F.regexp_extract_all(text(c), F.lit(r"(?m)^[ \t]*([0-9]+[ \t]*:[ \t]*.+)$"), 1)
    one = lambda x: F.struct(F.regexp_extract(x, r"^([0-9]+)", 1).try_cast("int").alias("cluster_id"), F.trim(F.regexp_extract(x, r"^[0-9]+[ \t]*:[ \t]*(.+)$", 1)).alias("label"))
    return F.filter(F.transform(found, one), lambda x: x["cluster_id"].isNotNull() & (x["label"] != ""))
