"""The score-coercion policies, each a Column from the JSON text of a score cell.

A cell is an object with a field "score", or a bare value. strict: numbers and booleans of objects and bare values;
lenient: of objects, and strings of digits and dots; elo: of objects, and strings of digits; cast: whatever a cast to
a floating number takes; none: numbers and booleans as they are, while a string is an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _parts(cell: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Whether the cell is an object; the kind, number and text of its score; whether a bare value stands for it."""
    v = F.try_parse_json(cell)
    kind = F.schema_of_variant(v)
    is_object = kind.startswith("OBJECT")
    score = F.try_variant_get(v, "$.score", "variant")
    value = F.when(is_object, score).otherwise(v)
    value_kind = F.when(is_object, F.schema_of_variant(score)).otherwise(kind)
    number = F.when(value_kind.rlike(NUMERIC), F.try_variant_get(value, "$", "double")).when(value_kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    text = F.when(value_kind == "STRING", F.trim(F.try_variant_get(value, "$", "string")))
    return is_object, value_kind, number, text, value


def strict(cell: Column) -> Column:
    return _parts(cell)[2]


def lenient(cell: Column) -> Column:
    is_object, _, number, text, _ = _parts(cell)
    return F.when(is_object, F.coalesce(number, F.when(text.rlike(r"^[0-9.]*[0-9][0-9.]*$"), text.try_cast("double"))))


def elo(cell: Column) -> Column:
    is_object, _, number, text, _ = _parts(cell)
    return F.when(is_object, F.coalesce(number, F.when(text.rlike(r"^[0-9]+$"), text.try_cast("double"))))


def cast(cell: Column) -> Column:
    _, _, number, text, _ = _parts(cell)
    return F.coalesce(number, F.when(~text.rlike(r"[dDfF]\s*$") | F.lower(text).isin("inf", "-inf", "+inf"), text.try_cast("double")))


def none(cell: Column) -> Column:
    _, _, number, text, _ = _parts(cell)
    return F.when(text.isNotNull(), F.raise_error(F.concat(F.lit("a score is a text: "), text)).cast("double")).otherwise(number)


POLICIES = {"lenient": lenient, "elo": elo, "strict": strict, "cast": cast, "none": none}
