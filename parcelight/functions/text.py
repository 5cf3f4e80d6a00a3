"""Compatibility normalisation (NFKC), white space and case folding of whole columns.

No JVM function unfolds characters, so columns pass through Arrow once, and each different text of a record batch is folded once.
Arrow's own normalisation kernel leaves characters decomposed (e and an accent stay two), so Python's does the folding.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .scalars import ASCII_MARKS, CJK_MARKS

SPACES = re.compile(r"\s+")
MARKS = str.maketrans(CJK_MARKS, ASCII_MARKS)


def text_form(text: str) -> str:
    """NFKC, then without white space at either end."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).strip()


def lookup_form(text: str) -> str:
    """:func:`text_form` as a lookup key: CJK marks as ASCII, runs of white space as one space, case folded."""
    return SPACES.sub(" ", unicodedata.normalize("NFKC", text).translate(MARKS)).strip().casefold()


def folded(values: pa.Array, form: Callable[[str], str]) -> pa.Array:
    coded = pc.dictionary_encode(values)
    return pa.DictionaryArray.from_arrays(coded.indices, pa.array(map(form, coded.dictionary.to_pylist()), pa.string())).cast(pa.string())


FORMS = {"text": text_form, "lookup": lookup_form}


def unfolded(df: DataFrame, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column more for each of ``wanted``: its name to (column, form), of :data:`FORMS`.  A null stays null; other columns
    pass as they are."""
    at = {name: (df.columns.index(c), form) for name, (c, form) in wanted.items()}
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.StringType()) for name in wanted)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [folded(b.column(i).cast(pa.string()), FORMS[form]) for i, form in at.values()]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
