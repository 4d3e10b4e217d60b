"""The types of a file as a Spark schema, with the id of each column in the fields' metadata."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import InvalidSchema, TypeNotSupported, UnsupportedDecimal, UnsupportedUnion
from .wire import TYPES

_PLAIN = {
    "BOOLEAN": T.BooleanType(), "BYTE": T.ByteType(), "SHORT": T.ShortType(), "INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BINARY": T.BinaryType(), "TIMESTAMP": T.TimestampType(), "TIMESTAMP_INSTANT": T.TimestampType(),
    "DATE": T.DateType(), "VARCHAR": T.StringType(), "CHAR": T.StringType(),
}
_CHILDREN = {"LIST": 1, "MAP": 2}
#: A tag is one signed byte.
UNION_VARIANTS = 127


def validate(types: list[dict]) -> None:
    """Raises InvalidSchema unless types is the pre-order list of a tree under a struct."""
    if not types:
        raise InvalidSchema("a file without types")
    if _kind(types[0]) != "STRUCT":
        raise InvalidSchema("the root is not a struct")
    for i, t in enumerate(types):
        kind, children = _kind(t), t["subtypes"]
        if kind == "STRUCT" and len(t["names"]) != len(children):
            raise InvalidSchema(f"struct {i} has {len(children)} columns and {len(t['names'])} names")
        if kind in _CHILDREN and len(children) != _CHILDREN[kind]:
            raise InvalidSchema(f"{kind.lower()} {i} has {len(children)} children")
        if kind in ("STRUCT", "UNION") and not children and i:
            raise InvalidSchema(f"{kind.lower()} {i} has no children")
        for before, child in zip([i, *children], children, strict=False):
            if child <= before:
                raise InvalidSchema(f"child {child} of {i} does not come after {before}")
            if child >= len(types):
                raise InvalidSchema(f"child {child} of {i} is not there")


def _kind(t: dict) -> str:
    n = t.get("kind", 0)
    if n >= len(TYPES):
        raise TypeNotSupported(f"type {n}")
    return TYPES[n]


def data_type(types: list[dict], i: int, nullable: dict[int, bool] | None = None) -> T.DataType:
    kind, t = _kind(types[i]), types[i]
    if kind in _PLAIN:
        return _PLAIN[kind]
    if kind == "DECIMAL":
        precision, scale = t.get("precision", 0), t.get("scale", 0)
        if precision > 38 or scale > 38:
            raise UnsupportedDecimal(f"decimal({precision}, {scale})")
        # files of format 0.11 do not say; their values have up to 38 digits and any scale
        return T.DecimalType(precision, scale) if precision else T.DecimalType(38, 18)
    if kind == "LIST":
        return T.ArrayType(data_type(types, t["subtypes"][0], nullable), True)
    if kind == "MAP":
        return T.MapType(data_type(types, t["subtypes"][0], nullable), data_type(types, t["subtypes"][1], nullable), True)
    if kind == "UNION":
        if len(t["subtypes"]) > UNION_VARIANTS:
            raise UnsupportedUnion(f"{len(t['subtypes'])} variants")
        fields = [_field(f"field{k}", types, c, nullable) for k, c in enumerate(t["subtypes"])]
        return T.StructType([T.StructField("tag", T.ByteType()), *fields])
    return T.StructType([_field(n, types, c, nullable) for n, c in zip(t["names"], t["subtypes"], strict=True)])


def _field(name: str, types: list[dict], i: int, nullable: dict[int, bool] | None) -> T.StructField:
    meta: dict = {"column_id": i}
    t = types[i]
    if _kind(t) in ("CHAR", "VARCHAR"):
        meta["maximum_length"] = t.get("maximum_length", 0)
    if _kind(t) in ("LIST", "MAP"):
        meta["child_ids"] = list(t["subtypes"])
    return T.StructField(name, data_type(types, i, nullable), True if nullable is None else nullable.get(i, True), meta)


def schema(types: list[dict], nullable: dict[int, bool] | None = None) -> T.StructType:
    """The root struct. `nullable` says of a column id whether its statistics count nulls."""
    validate(types)
    return data_type(types, 0, nullable)


def column_id(field: T.StructField) -> int:
    return field.metadata["column_id"]


def leaf_paths(types: list[dict]) -> dict[int, str]:
    """Column id -> dotted path; list items are `element`, map sides `key` and `value`, union variants `field0`, ..."""
    out = {0: ""}
    for i, t in enumerate(types):
        kind = _kind(t)
        names = {"STRUCT": t["names"], "LIST": ["element"], "MAP": ["key", "value"]}.get(kind) or [f"field{k}" for k in range(len(t["subtypes"]))]
        for n, c in zip(names, t["subtypes"], strict=False):
            out[c] = f"{out[i]}.{n}".lstrip(".")
    return out
