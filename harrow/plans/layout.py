"""Field types of the engine's own tables: int and varchar(n), their Spark types and fixed-slot layout."""

from __future__ import annotations

from pyspark.sql import types as T

from ..errors import TypeMismatch
from .ast import FieldDef, Literal

# Fixed values of the catalog format: type codes, bytes of the slot flag, of an int and of a string's
# length, and bytes of a UTF-16 code unit; the length of names and of view texts in the catalog tables.
INT_CODE, STRING_CODE = 0, 1
FLAG_BYTES, INT_BYTES, LENGTH_BYTES, UNIT_BYTES = 4, 4, 4, 2
NAME_LENGTH, VIEW_LENGTH = 16, 100
BLOCK_BYTES = 400


def spark_schema(fields: tuple[FieldDef, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.IntegerType() if f.length is None else T.StringType()) for f in fields])


def default_of(f: FieldDef) -> int | str:
    """What a field holds that an INSERT does not name: the engine has no null."""
    return 0 if f.length is None else ""


def check_value(f: FieldDef, value: Literal) -> None:
    """Raise TypeMismatch unless the literal has the field's type and fits its length."""
    if isinstance(value.value, str) != (f.length is not None):
        raise TypeMismatch(f"{value} does not fit {f}")
    if f.length is not None and len(value.value.encode("utf-16-le")) // 2 > f.length:
        raise TypeMismatch(f"{value} is longer than {f} allows")


def field_bytes(f: FieldDef) -> int:
    return INT_BYTES if f.length is None else LENGTH_BYTES + UNIT_BYTES * f.length


def offsets(fields: tuple[FieldDef, ...]) -> tuple[list[int], int]:
    """The offset of each field in a slot, and the size of the slot."""
    found, at = [], FLAG_BYTES
    for f in fields:
        found.append(at)
        at += field_bytes(f)
    return found, at


# The catalog tables and their fields.
SYSTEM_TABLES: dict[str, tuple[FieldDef, ...]] = {
    "tblcat": (FieldDef("tblname", NAME_LENGTH), FieldDef("slotsize")),
    "fldcat": (
        FieldDef("tblname", NAME_LENGTH),
        FieldDef("fldname", NAME_LENGTH),
        FieldDef("type"),
        FieldDef("length"),
        FieldDef("offset"),
    ),
    "viewcat": (FieldDef("viewname", NAME_LENGTH), FieldDef("viewdef", VIEW_LENGTH)),
    "idxcat": (
        FieldDef("indexname", NAME_LENGTH),
        FieldDef("tablename", NAME_LENGTH),
        FieldDef("fieldname", NAME_LENGTH),
    ),
}
