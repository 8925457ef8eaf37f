"""Language labels in their many notations, read as two-letter codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citegrove.functions.text import plain

LANGUAGES = ("en", "pt", "es", "fr", "de", "it")
#: Names and three-letter codes of the languages, English and own names (fixed values).
NOTATIONS = {
    "en": ("en", "eng", "english", "inglês", "inglés", "anglais", "englisch", "inglese"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "es": ("es", "spa", "esp", "spanish", "castilian", "español", "espanol", "castellano"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "it": ("it", "ita", "italian", "italiano"),
    "zh": ("zh", "zho", "chi", "chinese", "中文"),
    "zxx": ("zxx",),
}


def label_code(c: Column | str) -> Column:
    """en, pt, es, fr, de, it, zh or zxx; null where the label (or null) names none of them. Regions are ignored."""
    bare = F.regexp_extract(plain(c), r"^[^\p{L}]*(\p{L}+)(?:[-_ (].*)?$", 1)
    code = F.lit(None).cast("string")
    for name, forms in NOTATIONS.items():
        code = F.when(bare.isin(*forms), F.lit(name)).otherwise(code)
    return code
