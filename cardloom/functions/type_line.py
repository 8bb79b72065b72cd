"""Parser for type lines such as ``Legendary Creature — Elf // Sorcery``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardloom.functions.common import bind, strip, words_between_spaces

# The types that are not supertypes.
CANONICAL_TYPES = (
    "Artifact",
    "Battle",
    "Creature",
    "Enchantment",
    "Instant",
    "Kindred",
    "Land",
    "Planeswalker",
    "Sorcery",
)

TYPE_ARRAYS = ("basic_types", "super_types", "sub_types")

_FACE_TYPE = (
    "array<struct<raw_face_type_line:string,basic_types:array<string>,"
    "super_types:array<string>,sub_types:array<string>>>"
)


def _main_and_sub(face: Column) -> Column:
    """``[main, sub]``: cut once at a long dash, else a spaced hyphen, else a hyphen."""
    return (
        F.when(face.contains("—"), F.split(face, "—", 2))
        .when(face.contains(" - "), F.split(face, " - ", 2))
        .when(face.contains("-"), F.split(face, "-", 2))
        .otherwise(F.array(face, F.lit("")))
    )


def _face(face: Column, types: Sequence[str]) -> Column:
    def record(parts: Column) -> Column:
        main = words_between_spaces(strip(parts[0]))
        sub = words_between_spaces(strip(parts[1]))
        return F.struct(
            face.alias("raw_face_type_line"),
            F.filter(main, lambda t: t.isin(*types)).alias("basic_types"),
            F.filter(main, lambda t: ~t.isin(*types)).alias("super_types"),
            sub.alias("sub_types"),
        )

    return bind(_main_and_sub(face), record)


def type_faces(type_line: Column, types: Sequence[str] = CANONICAL_TYPES) -> Column:
    """One record per face; a null or empty line has none."""
    faces = F.transform(F.split(type_line, "//"), lambda f: _face(strip(f), types))
    none = F.array().cast(_FACE_TYPE)
    return F.when(type_line.isNull() | (type_line == ""), none).otherwise(faces)


def over_faces(faces: Column, field: str) -> Column:
    """Concatenate one array of all faces, keeping order and duplicates."""
    return F.flatten(F.transform(faces, lambda f: f[field]))
