"""Regular-expression matches with offsets, from built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value as a variable: it is computed once and stands in the plan once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of struct(start, end, value); code points, end exclusive.

    What lies between matches (split) and the matches themselves alternate, so running sums of their
    lengths give the offsets. Sums are taken in blocks, which keeps texts with many matches linear.
    """
    rx = F.lit(pattern)

    def width(x: Column) -> Column:
        return x["gap"] + F.length(x["value"])

    def starts(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, b: F.struct((a["at"] + F.aggregate(b, F.lit(0), lambda n, x: n + width(x))).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
            lambda a: a["out"],
        )

    def place(block: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            s, e = a["at"] + x["gap"], a["at"] + width(x)
            return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["value"].alias("value")))).alias("out"))

        return F.aggregate(block, first, step, lambda a: a["out"])

    def spans(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, starts(b), place)))

    def paired(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, rx, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("value")))

    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return let(F.regexp_extract_all(text, rx, F.lit(0)), lambda found: F.when(F.size(found) > 0, let(paired(found), spans)).otherwise(none))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end]."""
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))
