"""Several values packed in one field: the dialect of each field is the parse with the shortest description.

Every field is parsed by every dialect (delimiters, quotes, conjunctions) that its text allows; different parses of a
field compete. The length of a parse is that of its dialect, of its delimiters and of its values. A value's code is
its share among the values of trusted fields (those with one unmistakable delimiter), or, where that is shorter,
its shape's share and its letters spelled out. Value and shape counts are taken over the whole table and joined to the
parses; nothing about single values is gathered on the driver.

Null, empty and blank fields, and fields of delimiters only, have no values. Quotes and blanks around a value are no
part of it; doubled or escaped characters are read as the one they stand for.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrove.plans.tables import cut, lookup_join, salted_join

#: Delimiters that hardly occur within a value; "/" only counts with blanks around it or doubled.
STRONG = {"semicolon": ";", "wide": "；", "bar": r"\|", "line": r"\r\n|\n|\r", "tab": r"\t", "bullet": "•", "dot": "·", "slashes": "//", "slash": r"(?<=\s)/(?=\s)"}
CONJUNCTION = r"(?:,\s*)?(?:&|(?<=\s)and(?=\s)|(?<=\s)und(?=\s)|(?<=\s)et(?=\s)|(?<=\s)y(?=\s)|(?<=\s)e(?=\s))"
#: Bits of a dialect's name.
DIALECT_BITS = {"single": 1.0, "list": 2.0, "strong": 4.0, "comma": 2.0, "initials": 3.0, "pairs": 4.0, "blank": 5.0}
CONJUNCTION_BITS = 2.0
#: Bits to say that a value is spelled out, of a letter, to say that a shape is new, and of a symbol of a new shape.
ESCAPE_BITS, LETTER_BITS, NEW_SHAPE_BITS, SYMBOL_BITS = 3.0, 4.3, 4.0, 3.0
#: Fields whose values may be joined by a word or "&": names of persons.
PERSONS = frozenset({"authors"})
#: Fields of citations, whose values may be identifiers separated by blanks alone.
CITATIONS = frozenset({"refs"})

_INITIALS = re.compile(r"(?:[^\W\d_]\.?[\s-]?){1,4}\Z")
_SPLIT: dict[str, re.Pattern[str]] = {}


def shape(value: str) -> str:
    """Letters by case, digits and marks, each run as one: 'Aa, A.' for a surname with initials."""
    s = re.sub(r"[^\W\d_][^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", value)
    s = re.sub(r"(?<![^\W\d_])[^\W\d_](?![^\W\d_])", lambda m: "I" if m[0].isupper() else "i", s)
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", s))


def _cleaned(part: str) -> str:
    part = part.strip("​﻿ \t\r\n\f\v ")
    if len(part) > 1 and part[0] == part[-1] and part[0] in "\"'":
        quote, inner = part[0], part[1:-1]
        if quote not in inner.replace(quote * 2, "").replace("\\" + quote, ""):
            return inner.replace("\\" + quote, quote).replace(quote * 2, quote).strip()
    return part


def _parts(text: str, delimiter: str) -> list[str]:
    """Split at a delimiter pattern outside of quotes; a quote opens at the start of a part and closes at its end."""
    pattern = _SPLIT.get(delimiter)
    if pattern is None:
        quoted = r"""\s*"(?:[^"\\]|""|\\.)*"(?=\s*(?:{0}|\Z))|\s*'(?:[^'\\]|''|\\.)*'(?=\s*(?:{0}|\Z))"""
        pattern = _SPLIT[delimiter] = re.compile(rf"(?:{quoted.format(delimiter)})|({delimiter})", re.DOTALL)
    if '"' not in text and "'" not in text:
        return re.split(delimiter, text)
    out, start, at = [], 0, 0
    while m := pattern.search(text, at):
        if m[1] is not None:
            out.append(text[start : m.start()])
            start = at = m.end()
        elif text[start : m.start()].strip():  # a quote within a part
            at = m.start() + max(1, len(m[0]) - len(m[0].lstrip())) + (not m[0][:1].isspace())
        else:
            at = m.end()
    return [*out, text[start:]]


def parses(field: str, text: str) -> Iterator[tuple[str, float, list[str]]]:
    """(dialect, bits of the dialect and its delimiters, values) of every dialect the text allows; equal parses once."""
    seen: set[tuple[str, ...]] = set()

    def once(name: str, bits: float, parts: list[str]) -> Iterator[tuple[str, float, list[str]]]:
        values = [v for v in map(_cleaned, parts) if v]
        if tuple(values) not in seen:
            seen.add(tuple(values))
            yield name, bits + 2 * math.log2(len(values) + 1) + LETTER_BITS * max(0, len(values) - 1), values

    bare = text.strip()
    if bare[:1] == "[" and bare[-1:] == "]":
        try:
            values = json.loads(bare)
            if isinstance(values, list):
                yield from once("list", DIALECT_BITS["list"], [v if isinstance(v, str) else json.dumps(v) for v in values if v is not None])
                return
        except ValueError:
            pass
    here = [name for name, pattern in STRONG.items() if re.search(pattern, text)]
    sets = [[name] for name in here]
    if len(here) > 1:
        sets.append(here)
    joins = [""] + (["and"] if field in PERSONS and re.search(CONJUNCTION, text) else [])
    for names in sets:
        for join in joins:
            delimiter = "|".join(STRONG[n] for n in names) + ("|" + CONJUNCTION if join else "")
            parts = _parts(text, delimiter)
            every = math.log2(len(names) + bool(join)) * len(parts)
            yield from once("+".join([*names, *([join] if join else [])]), DIALECT_BITS["strong"] + CONJUNCTION_BITS * bool(join) + every, parts)
    for join in joins:
        delimiter = f"{CONJUNCTION}|," if join else ","
        extra = CONJUNCTION_BITS * bool(join)
        if join:
            yield from once("and", DIALECT_BITS["strong"] + extra, _parts(text, CONJUNCTION))
        if "," in text:
            parts = _parts(text, delimiter)
            yield from once("comma" + join, DIALECT_BITS["comma"] + extra, parts)
            if field in PERSONS:
                names: list[str] = []
                for p in parts:
                    if names and _INITIALS.match(p.strip()) and "," not in names[-1]:
                        names[-1] += "," + p
                    elif p.strip():
                        names.append(p)
                yield from once("initials" + join, DIALECT_BITS["initials"] + extra, names)
                filled = [p for p in parts if p.strip()]
                if len(filled) % 2 == 0:
                    yield from once("pairs" + join, DIALECT_BITS["pairs"] + extra, [",".join(filled[i : i + 2]) for i in range(0, len(filled), 2)])
    if field in CITATIONS and re.search(r"\S\s+\S", bare):
        yield from once("blank", DIALECT_BITS["blank"], bare.split())
    yield from once("single", DIALECT_BITS["single"], [text])


def trusted(name: str, text: str) -> bool:
    """Whether a parse may teach: a list notation, or the only strong delimiter of a text without quotes or other hints."""
    if name == "list":
        return True
    return name in STRONG and '"' not in text and "'" not in text and sum(bool(re.search(p, text)) for p in STRONG.values()) == 1 and not re.search(r"&|\sand\s", text)


def _scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "field", "dialect", "bits", "value", "shape", "letters", "teaches", "own"]
    for batch in batches:
        columns: list[list] = [[] for _ in names]
        for row_id, field, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = list(parses(field, text))
            taught = Counter(v for name, _, values in found if trusted(name, text) for v in values)
            for name, bits, values in found:
                teaches = trusted(name, text)
                for k, value in enumerate(values or [""]):
                    for column, x in zip(columns, (row_id, field, name, bits if not k else 0.0, value, shape(value), len(value), int(teaches and bool(value)), taught[value]), strict=True):
                        column.append(x)
        types = [pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, field, text, dialect) to the values by that dialect."""
    names = ["id", "field", "pos", "item", "dialect"]
    for batch in batches:
        rows: list[tuple] = []
        for row_id, field, text, dialect in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = {name: v for name, _, v in parses(field, text)}
            values = found[dialect] if dialect in found else next(reversed(found.values()))
            rows += [(row_id, field, k, v, dialect) for k, v in enumerate(values, 1)]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)


def packed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, text) of the fields that hold anything but blanks."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields))
    return df.select(F.col(id_col).alias("id"), F.inline(each)).filter(F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s ​﻿]+", ""))) > 0)


def dialects(fields: DataFrame) -> DataFrame:
    """(id, field, dialect, bits): the cheapest dialect of each field of (id, field, text); ties go to the first by name.

    One shuffle by value and one by field. A value's rows are counted before the shuffle, hot values are salted. Every
    shape that any field has keeps its count, whatever the size of the table; the counts are broadcast while they are
    small and joined by salted keys beyond.
    """
    schema = "id long, field string, dialect string, bits double, value string, shape string, letters long, teaches long, own long"
    rows = fields.select("id", "field", "text").mapInArrow(_scored_rows, schema)
    rows = rows.withColumn("k1", F.xxhash64(F.lit("v1"), "field", "value")).withColumn("k2", F.xxhash64(F.lit("v2"), "field", "value"))
    rows = cut(rows.select("id", "field", "dialect", "bits", "k1", "k2", "shape", "letters", "teaches", "own"), "parses")
    values = cut(rows.groupBy("k1", "k2").agg(F.sum("teaches").alias("known"), F.count(F.lit(1)).alias("_rows")), "values")
    shapes = cut(rows.groupBy("field", "shape").agg(F.sum("teaches").alias("shaped"), F.count(F.lit(1)).alias("_rows")), "shapes")
    totals = rows.groupBy("field").agg(F.sum("teaches").alias("taught"))  # a row per field
    known = salted_join(rows, values, ["k1", "k2"], "_rows").drop("k1", "k2", "_rows")
    known = lookup_join(known, shapes, ["field", "shape"], "_rows").drop("_rows").withColumn("shaped", F.when(F.col("shaped") > 0, F.col("shaped"))).join(F.broadcast(totals), "field")
    other = F.col("known") - F.col("own")  # a field does not vouch for itself
    of_value = F.when(other > 0, F.log2((F.col("taught") + 1) / other) + 1)
    of_shape = F.coalesce(F.log2((F.col("taught") + 1) / F.col("shaped")), NEW_SHAPE_BITS + SYMBOL_BITS * F.length("shape"))
    spelled = ESCAPE_BITS + of_shape + LETTER_BITS * F.col("letters")
    bits = F.col("bits") + F.when(F.col("letters") > 0, F.least(spelled, of_value)).otherwise(0.0)
    lengths = known.groupBy("id", "field", "dialect").agg(F.sum(bits).alias("bits"))
    best = Window.partitionBy("id", "field").orderBy(F.round("bits", 6), "dialect")
    return lengths.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def split_values(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, pos, item, dialect): one row per value, pos from 1 in the order of the field.

    A dialect is chosen once for each different text of a field (told apart by 128 bits), so repeated rows, and null or
    repeated ids, do no harm.
    """
    texts = packed(df, id_col, fields).withColumn("k1", F.xxhash64(F.lit("t1"), "field", "text")).withColumn("k2", F.xxhash64(F.lit("t2"), "field", "text"))
    unique = texts.groupBy("k1", "k2").agg(F.any_value("field").alias("field"), F.any_value("text").alias("text"), F.count(F.lit(1)).alias("rows"))
    unique = cut(unique.withColumn("number", F.monotonically_increasing_id()), "texts")  # the numbers are fixed once they are written
    chosen = dialects(unique.select(F.col("number").alias("id"), "field", "text")).select("id", "dialect")
    chosen = cut(chosen.join(unique.select(F.col("number").alias("id"), "k1", "k2", "rows"), "id").drop("id"), "chosen")
    schema = "id long, field string, pos long, item string, dialect string"
    return salted_join(texts, chosen, ["k1", "k2"], "rows").select("id", "field", "text", "dialect").mapInArrow(_parsed, schema)
