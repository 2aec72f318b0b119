"""Problem 4: several values packed in one field become one row per value, with its position.

Everything is a Spark expression, so one narrow pass does it, without a shuffle:

1. spans in double quotes that fill a whole value are cut out and an indexed placeholder
   stands for each; the placeholder character is escaped in the text first, so no text can
   look like a placeholder,
2. what is left is split at the delimiters,
3. the spans come back by array lookup, and the values are exploded with their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK, END, ESCAPED = "", "", ""

#: What separates values. A slash counts only with blanks around it.
NAME_DELIMITERS = "[,;|]| / "
LIST_DELIMITERS = "[;|]"


def _quoted_span(delimiters: str) -> str:
    """A double-quoted span that starts where a value starts and ends where it ends."""
    before = "|".join(f"(?<={d})" for d in _parts(delimiters))
    return rf'(?:^|{before}) *"((?:[^"]|"")*+)" *(?=$|{delimiters})'


def _parts(delimiters: str) -> list[str]:
    """The alternatives of a delimiter pattern made of one class and literal strings."""
    close = delimiters.index("]") + 1
    return [delimiters[:close], *(d for d in delimiters[close:].split("|") if d)]


def split_values(field: Column, delimiters: str) -> Column:
    """The non-blank values of ``field`` in order; null for null.

    A field in square brackets that parses as a JSON array of strings gives its elements. A
    value that starts with a double quote is quoted up to the matching quote, a doubled quote
    is one; a quote that is never closed is ordinary text. U+0020 at both ends is removed.
    """
    span = _quoted_span(delimiters)
    text = F.replace(field, F.lit(MARK), F.lit(MARK + ESCAPED))
    pieces = F.split(text, span, -1)
    quoted = F.regexp_extract_all(text, F.lit(span), F.lit(1))
    last = F.size(pieces) - 1
    held = F.array_join(
        F.transform(pieces, lambda p, i: F.when(i < last, F.concat(p, F.lit(MARK), i.cast("string"), F.lit(END))).otherwise(p)), ""
    )
    held = F.when(text.contains('"'), held).otherwise(text)

    def restored(value: Column) -> Column:
        index = F.regexp_extract(value, f"^ *{MARK}([0-9]+){END} *$", 1)
        whole = F.replace(F.get(quoted, index.try_cast("int")), F.lit('""'), F.lit('"'))
        return F.trim(F.replace(F.when(index == "", value).otherwise(whole), F.lit(MARK + ESCAPED), F.lit(MARK)))

    plain = F.transform(F.split(held, delimiters, -1), restored)
    trimmed = F.trim(field)
    listed = F.when(trimmed.startswith("[") & trimmed.endswith("]"), F.from_json(trimmed, "array<string>"))
    values = F.coalesce(F.transform(listed, lambda v: F.trim(F.coalesce(v, F.lit("")))), plain)
    return F.filter(values, lambda v: v != "")


def explode_values(df: DataFrame, tab: str, rec_id: str, field: str, delimiters: str) -> DataFrame:
    """One row (tab, rec_id, pos, val) per value of each ``field`` that holds two or more.

    Null, blank and single-valued fields give no row; repeated rows each give their own; other
    columns of ``df``, whatever their names, are not read.
    """
    packed = df.select(F.col(rec_id).alias("rec_id"), F.col(field).alias("field")).filter(F.col("field").rlike(rf"{delimiters}|\["))
    held = packed.select("rec_id", split_values(F.col("field"), delimiters).alias("values")).filter(F.size("values") >= 2)
    return held.select(
        F.lit(tab).alias("tab"), "rec_id", F.posexplode("values").alias("at", "val")
    ).select("tab", "rec_id", (F.col("at") + 1).cast("long").alias("pos"), "val")
