"""Structured answers: a model's JSON checked against a schema, with what is wrong in it, path by path.

A schema is a StructType. A field that is not nullable must be there; a field's metadata may name its values ("one_of"), and a struct field's
whether others than the named are wrong ("closed"). Numbers do not pass for texts, nor texts for numbers.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.storage import materialise
from newsloom.functions.text import unfence

_NAMES = {T.StringType: "a text", T.BooleanType: "true or false", T.LongType: "a whole number", T.DoubleType: "a number"}
_KINDS = {T.StringType: str, T.BooleanType: bool, T.LongType: int, T.DoubleType: int | float}


def required(name: str, kind: T.DataType | str, **metadata: object) -> T.StructField:
    return T.StructField(name, _kind(kind), False, metadata)


def optional(name: str, kind: T.DataType | str, **metadata: object) -> T.StructField:
    return T.StructField(name, _kind(kind), True, metadata)


def _kind(kind: T.DataType | str) -> T.DataType:
    named = {"string": T.StringType(), "boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType()}
    if isinstance(kind, str) and kind.startswith("array<"):
        return T.ArrayType(_kind(kind.removeprefix("array<").removesuffix(">")))
    return kind if isinstance(kind, T.DataType) else named[kind]


def wrong(value: object, field: T.StructField, path: str) -> list[str]:
    """What is wrong with a JSON value that stands for a field."""
    kind = field.dataType
    if value is None:
        return [] if field.nullable else [f"{path}: missing"]
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return [f"{path}: not an object"]
        inner = [x for f in kind.fields for x in wrong(value.get(f.name), f, f"{path}.{f.name}")]
        more = sorted(value.keys() - {f.name for f in kind.fields}) if field.metadata.get("closed") else []
        return inner + [f"{path}.{k}: not known" for k in more]
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return [f"{path}: not a list"]
        one = T.StructField("element", kind.elementType, False, field.metadata)
        return [x for i, v in enumerate(value) for x in wrong(v, one, f"{path}[{i}]")]
    if not isinstance(value, _KINDS[type(kind)]) or isinstance(value, bool) != isinstance(kind, T.BooleanType):
        return [f"{path}: not {_NAMES[type(kind)]}"]
    values = field.metadata.get("one_of")
    return [f"{path}: none of {', '.join(values)}"] if values and value not in values else []


def _loose(kind: T.DataType) -> T.DataType:
    """The type with all fields nullable, as a parser gives them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind.fields])
    return T.ArrayType(_loose(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def decode(answer: Column, schema: T.StructType, closed: bool = False) -> Column:
    """A struct of value (null unless all is right) and violations, of an answer in JSON, fenced or not. A null answer, and what is no JSON, violates as a whole."""
    root = T.StructField("$", schema, False, {"closed": closed})

    @F.pandas_udf("array<string>")
    def check(answers: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[str]:
            try:
                return wrong(json.loads(text or ""), root, "$")
            except ValueError:
                return ["$: not JSON"]

        return answers.map(one, na_action=None)

    text = unfence(answer)
    found = check(text)
    return F.struct(F.when(F.size(found) == 0, F.from_json(text, _loose(schema))).alias("value"), found.alias("violations"))


def structured(df: DataFrame, prompt: Column, schema: T.StructType, ask: Callable[[DataFrame, Column, str, Column], DataFrame], closed: bool = False) -> DataFrame:
    """df with value, violations and tries (1 or 2): answers that violate the schema are asked for once more, with what was wrong.

    ask(df, prompt, out, when) gives df with the answers in out; a null prompt is not asked and has neither value nor violations (tries 0). Raises ValueError
    where df has a column of one of the new names.
    """
    if taken := {"value", "violations", "tries"} & set(df.columns):
        raise ValueError(f"columns {sorted(taken)} are taken")
    # An answer costs a call: it is written before it is read, and so never asked for again.
    asked = materialise(ask(df.withColumn("__prompt", prompt), F.col("__prompt"), "__first", F.col("__prompt").isNotNull()))
    once = asked.withColumn("__one", decode(F.col("__first"), schema, closed)).withColumn("__one", F.when(F.col("__prompt").isNotNull(), F.col("__one")))
    again = F.size("__one.violations") > 0
    said = F.concat(F.col("__prompt"), F.lit("\n\n"), F.array_join("__one.violations", "\n"))
    twice = materialise(ask(materialise(once.withColumn("__said", F.when(again, said))), F.col("__said"), "__second", F.col("__said").isNotNull()))
    best = F.when(F.coalesce(again, F.lit(False)), F.col("__two")).otherwise(F.col("__one"))
    tries = F.when(F.col("__prompt").isNull(), 0).when(again, 2).otherwise(1)
    return twice.withColumn("__two", decode(F.col("__second"), schema, closed)).withColumn("__best", best).withColumns({"value": F.col("__best.value"), "violations": F.col("__best.violations"), "tries": tries}).drop("__prompt", "__first", "__one", "__said", "__second", "__two", "__best")
