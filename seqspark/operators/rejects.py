"""Separate rows that fail to parse from typed rows, with the reason for failure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import lookup, store

QUOTING, COLUMNS, VALUE = "quoting", "columns", "value"

#: Kinds of values: the pattern of the text and the type it is cast to.
WHOLE = ("whole", r"^0*[1-9][0-9]*$", "decimal(38,0)")
SCORE = ("score", r"^[+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$|^-0*([.]0*)?([eE][+-]?[0-9]+)?$", "double")


@dataclass(frozen=True)
class Field:
    """One column of the line: ``check`` names the kind its values must be of, else they are only cast, null where that fails."""

    name: str
    type: str = "string"
    check: tuple[str, str, str] | None = None


#: Twelve columns of tabular search output.
HIT_FIELDS = [
    Field("c0", "decimal(38,0)", WHOLE),
    Field("c1"),
    Field("c2", "double"),
    *[Field(f"c{i}", "int") for i in range(3, 10)],
    Field("c10", "double"),
    Field("c11", "double", SCORE),
]

_T, _Q, _ESC = "\t", '"', "\u0001"


def _outside(i: Column) -> Column:
    return i % 2 == 0


def _structure(line: Column) -> tuple[Column, Column, Column]:
    """Quoting holds, number of fields, and the fields still quoted and with inner tabs escaped.

    The line is cut at its double quotes. Pieces at even positions lie outside quotes: each must be empty (a doubled quote) or begin and
    end with a tab, once a tab stands before and after the line. That is linear in the line's length and needs no recursion.
    """
    quoted = line.contains(_Q)
    pieces = F.split(F.concat(F.lit(_T), line, F.lit(_T)), _Q, -1)
    bad = F.filter(pieces, lambda x, i: _outside(i) & (x != "") & ~(x.startswith(_T) & x.endswith(_T)))
    fine = ~quoted | ((F.size(pieces) % 2 == 1) & (F.size(bad) == 0))
    plain = F.array_join(F.filter(pieces, lambda x, i: _outside(i)), "")
    tabs = lambda s: F.length(s) - F.length(F.replace(s, F.lit(_T), F.lit("")))
    n = F.when(quoted, tabs(plain) - 1).otherwise(tabs(line) + 1)
    esc = lambda s: F.replace(s, F.lit(_ESC), F.lit(_ESC + "a"))
    safe = F.array_join(F.transform(pieces, lambda x, i: F.when(_outside(i), esc(x)).otherwise(F.replace(esc(x), F.lit(_T), F.lit(_ESC + "b")))), _Q)
    fields = F.when(quoted, F.split(F.substr(safe, F.lit(2), F.length(safe) - 2), _T, -1)).otherwise(F.split(line, _T, -1))
    return fine, n, fields


def _unquoted(field: Column, quoted: Column) -> Column:
    inner = F.when(field.startswith(_Q), F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit(_Q * 2), F.lit(_Q))).otherwise(field)
    plain = F.replace(F.replace(inner, F.lit(_ESC + "b"), F.lit(_T)), F.lit(_ESC + "a"), F.lit(_ESC))
    return F.regexp_replace(F.when(quoted, plain).otherwise(field), r"(?U)^\s+|\s+\z", "")


def parse_rows(df: DataFrame, line: str = "line", fields: list[Field] | None = None, broadcast_mb: float = 16.0) -> DataFrame:
    """All rows of ``df`` that are data, with ``reason`` (null for a good row) and the typed ``row``, a struct of ``fields``.

    Method: every distinct value of a checked column is tested and cast once; the values that fail make a dictionary with their reason,
    which is joined back beside the structural checks (broadcast only if its measured size is under ``broadcast_mb``).

    ``reason`` is the first that applies: ``quoting`` (a field neither free of double quotes nor wholly enclosed, inner ones doubled),
    ``columns`` (not as many fields as asked for), ``value`` (a checked value is not of its kind). ``row`` is null for a failing row.
    One carriage return at the end is no part of a line. Lines that are null, of white space only or start with ``#`` are no data and do
    not come out. Repeated lines come out as often as they occur. Values of unchecked columns that cannot be cast are null in ``row``. A valid
    value too large for its type (a whole number of more than 38 digits) is null there too, and stands as text in its field ``wide``, a
    map that is null otherwise. Other columns of ``df`` pass through; one named ``reason`` or ``row`` is replaced.
    """
    fields = fields or HIT_FIELDS
    # the rows' own columns travel in one struct, where no name can clash with those made here
    names = [c for c in df.columns if c.lower() not in ("reason", "row")]
    data = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__in"), F.regexp_replace(F.col(f"`{line}`"), "\r\\z", "").alias("__text"))
    data = data.filter(F.col("__text").isNotNull() & ~F.col("__text").startswith("#") & F.col("__text").rlike(r"(?U)\S"))
    fine, n, parts = _structure(F.col("__text"))
    data = data.withColumn("__why", F.when(~fine, QUOTING).when(n != len(fields), COLUMNS)).withColumn("__parts", F.when(F.col("__why").isNull(), parts))
    quoted = F.col("__text").contains(_Q)
    cell = {f.name: _unquoted(F.col("__parts")[i], quoted) for i, f in enumerate(fields)}
    checked = [f for f in fields if f.check]
    data = data.withColumns({f"__v_{f.name}": cell[f.name] for f in checked})

    cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"__v_{f.name}").alias("value")) for f in checked]))
    distinct = data.filter(F.col("__why").isNull()).select(cells.alias("x")).select("x.field", "x.value").distinct()
    ok = F.lit(False)
    for f in checked:
        fine = F.col("value").rlike(f.check[1])
        if f.check[2] == "double":
            fine = fine & (F.col("value").try_cast("double") < float("inf"))
        ok = ok | ((F.col("field") == f.name) & fine)
    dictionary = store(distinct.filter(~F.coalesce(ok, F.lit(False))).withColumn("why", F.lit(VALUE)), "invalid")
    wrong = lookup(dictionary, broadcast_mb)
    for f in checked:
        one = wrong.filter(F.col("field") == f.name).select(F.col("value").alias(f"__v_{f.name}"), F.col("why").alias(f"__w_{f.name}"))
        data = data.join(one, f"__v_{f.name}", "left")
    reason = F.coalesce("__why", *[f"__w_{f.name}" for f in checked])
    cast = {f.name: cell[f.name] if f.type == "string" else cell[f.name].try_cast(f.type) for f in fields}
    # a valid value that its type can't hold is kept as text
    wide = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f.name) for f in checked]), F.array(*[F.when(cast[f.name].isNull(), cell[f.name]) for f in checked])), lambda _, v: v.isNotNull())
    typed = F.struct(*[cast[f.name].alias(f.name) for f in fields], F.when(F.size(wide) > 0, wide).alias("wide"))
    return data.select("__in.*", reason.alias("reason"), F.when(reason.isNull(), typed).alias("row"))


def failed(parsed: DataFrame) -> DataFrame:
    """The failing rows of :func:`parse_rows` with their reason."""
    return parsed.filter(F.col("reason").isNotNull()).drop("row")


def loaded(parsed: DataFrame) -> DataFrame:
    """The good rows of :func:`parse_rows` as typed columns; a column of the rows' own that is named like a field gives way to it."""
    taken = {f.lower() for f in parsed.schema["row"].dataType.names} | {"reason", "row"}
    return parsed.filter(F.col("reason").isNull()).select(*[F.col(f"`{c}`") for c in parsed.columns if c.lower() not in taken], "row.*")
