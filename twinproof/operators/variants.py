"""Row images as VARIANT: fields that no schema knows are found, counted and kept, and read once a schema names them.

The type of all images of a table is merged by ``schema_of_variant_agg``, on the map side first, so what comes to the driver is one type a table and not one
a row. An unknown field is one that the declared type lacks, at any depth of nested objects; elements of arrays are taken as the array's own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinproof.functions.canon import quoted

BROKEN = "malformed image"


def as_variant(images: DataFrame, column: str, name: str = "image") -> DataFrame:
    """Add the image as VARIANT and ``reason``, set where the text is no JSON object. A null image stays null and is not rejected."""
    parsed = F.try_parse_json(quoted(column))
    out = images.withColumn(name, parsed)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(quoted(name)), F.lit("OBJECT<")), F.lit(False))
    bad = quoted(column).isNotNull() & ~is_object
    return out.withColumns({"reason": F.when(bad, F.lit(BROKEN)), name: F.when(~bad, quoted(name))})


def observed_type(images: DataFrame, name: str = "image") -> str:
    """The merged type of all images, as the text that ``schema_of_variant_agg`` gives; ``VOID`` without any."""
    return images.agg(F.schema_of_variant_agg(quoted(name))).first()[0] or "VOID"


def _fields(text: str) -> Iterator[tuple[str, str]]:
    """Names and type texts of an object's fields. Names that need quotes come in backticks."""
    inner, depth, quotes, start = text[len("OBJECT<") : -1], 0, False, 0
    parts = []
    for i, c in enumerate(inner):
        if c == "`":
            quotes = not quotes
        elif not quotes and c in "<(":
            depth += 1
        elif not quotes and c in ">)":
            depth -= 1
        elif not quotes and depth == 0 and c == ",":
            parts.append(inner[start:i])
            start = i + 1
    parts.append(inner[start:])
    for part in filter(None, map(str.strip, parts)):
        if part.startswith("`"):
            end = part.index("`: ", 1)
            yield part[1:end].replace("``", "`"), part[end + 3 :]
        else:
            field, kind = part.split(": ", 1)
            yield field, kind


def unknown_paths(observed: str, declared: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], str]]:
    """Paths in the observed type that the declared one lacks, each with its type; an unknown object is one path."""
    out = []
    if not observed.startswith("OBJECT<"):
        return out
    known = {f.name: f.dataType for f in declared.fields}
    for field, kind in _fields(observed):
        if field not in known:
            out.append(((*path, field), kind))
        elif isinstance(known[field], T.StructType):
            out += unknown_paths(kind, known[field], (*path, field))
    return sorted(out)


def json_path(path: tuple[str, ...]) -> str:
    """Path text for ``variant_get``. A name with both kinds of quotes cannot be written and is refused."""
    steps = []
    for step in path:
        if "'" in step and '"' in step:
            raise ValueError(f"field name with both quotes: {step}")
        quote = '"' if "'" in step else "'"
        steps.append(f"[{quote}{step}{quote}]")
    return "$" + "".join(steps)


def unknown_fields(images: DataFrame, declared: T.StructType, name: str = "image", pos: str = "pos") -> DataFrame:
    """(path, type, images, first_pos) of every field outside the declared type, counted in one pass. ``pos`` is a long."""
    found = unknown_paths(observed_type(images, name), declared)
    spark = images.sparkSession
    if not found:
        return spark.createDataFrame([], "path string, type string, images long, first_pos long")
    has = [F.try_variant_get(quoted(name), json_path(p), "variant").isNotNull() for p, _ in found]
    totals = images.agg(*[F.struct(F.count_if(h).alias("images"), F.min(F.when(h, quoted(pos))).alias("first_pos")).alias(f"c{i}") for i, h in enumerate(has)])
    rows = F.array(*[F.struct(F.lit(".".join(p)).alias("path"), F.lit(kind).alias("type"), F.col(f"c{i}.images"), F.col(f"c{i}.first_pos")) for i, (p, kind) in enumerate(found)])
    return totals.select(F.inline(rows))


def open_variant(images: DataFrame, declared: T.StructType, name: str = "image") -> DataFrame:
    """The image's declared fields as columns, beside all others, and ``misfit``: the declared fields that hold a value of another type.

    The image stays, so that it can be opened again with a wider schema.
    """
    values = {f.name: F.try_variant_get(quoted(name), json_path((f.name,)), f.dataType.simpleString()) for f in declared.fields}
    lost = [
        F.when(
            F.try_variant_get(quoted(name), json_path((c,)), "variant").isNotNull()
            & ~F.is_variant_null(F.try_variant_get(quoted(name), json_path((c,)), "variant"))
            & v.isNull(),
            F.lit(c),
        )
        for c, v in values.items()
    ]
    return images.withColumns({**values, "misfit": F.array_compact(F.array(*lost))})
