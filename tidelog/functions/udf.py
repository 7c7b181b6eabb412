"""User functions of three kinds, by name: of a row, of a group, and giving a table. Arguments come in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_KNOWN: dict[tuple[str, tuple[str, ...]], str] = {}
#: Which type an argument of another type may be taken for, nearest first.
_CONVERTS = {"tinyint": ("smallint", "int", "bigint", "double"), "smallint": ("int", "bigint", "double"), "int": ("bigint", "double"), "bigint": ("double", "decimal"), "float": ("double",), "decimal": ("double",), "date": ("timestamp",)}


def register_row(spark: SparkSession, name: str, fn: Callable, returns: str, takes: tuple[str, ...] = ()) -> None:
    """``fn`` of pandas Series, one for each argument, gives a Series."""
    _register(spark, name, F.pandas_udf(fn, returns), takes)


def register_group(spark: SparkSession, name: str, fn: Callable, returns: str, takes: tuple[str, ...] = ()) -> None:
    """``fn`` of the Series of a group (annotated to give a scalar) gives one value."""
    _register(spark, name, F.pandas_udf(fn, returns), takes)


def register_table(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """``handler`` with eval(...) yields rows."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def _register(spark: SparkSession, name: str, udf, takes: tuple[str, ...]) -> None:
    own = name if not takes else f"{name}__{'_'.join(takes)}"
    spark.udf.register(own, udf)
    _KNOWN[name.lower(), takes] = own


def resolve(name: str, types: tuple[str, ...]) -> str:
    """The registered function for arguments of these types: one that takes just them, else one they convert to, the nearest first."""
    name = name.lower()
    if (name, types) in _KNOWN:
        return _KNOWN[name, types]
    best: tuple[int, str] | None = None
    for (n, takes), own in _KNOWN.items():
        if n != name or (takes and len(takes) != len(types)):
            continue
        steps = 0
        for have, want in zip(types, takes, strict=bool(takes)):
            if have == want:
                continue
            if want not in _CONVERTS.get(have, ()):
                steps = -1
                break
            steps += 1 + _CONVERTS[have].index(want)
        if not takes:
            steps = 100
        if steps >= 0 and (best is None or steps < best[0]):
            best = (steps, own)
    if best is None:
        raise LookupError(f"no function {name}({', '.join(types)})")
    return best[1]
