"""Column expressions shared by the operators."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c) -> Column:
    return F.round(c, 6)


def hash_order(*cols, seed: int) -> Column:
    """A seeded order that any engine with md5 can repeat."""
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols], F.lit(str(seed))))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 8 hexadecimal digits of an md5."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)


def ensembl_stable(c) -> Column:
    """The stable identifier inside a label, in capitals; null if there is none. The pattern is a fixed value."""
    found = F.upper(F.regexp_extract(c, r"(?i)(ENS[A-Z]{0,10}G\d{6,})", 1))
    return F.when(found != "", found)


def in_all(spec: list[dict]) -> Column:
    """Conjunction of {column, values}."""
    return reduce(lambda a, b: a & b, (F.col(s["column"]).isin(list(s["values"])) for s in spec), F.lit(True))


def by_substring(c, pairs: list[tuple[str, str]], otherwise: str | None) -> Column:
    """First pair whose text occurs in the lower-cased column."""
    low, out = F.lower(c), None
    for part, name in pairs:
        out = F.when(low.contains(part), name) if out is None else out.when(low.contains(part), name)
    return out.otherwise(F.lit(otherwise))


def mapped(c, mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(c) if isinstance(c, str) else c]


def l2(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def vector_stat(name: str, array, weight=None) -> F.col:
    """Element by element over rows: mean, sum, max of array columns of one length, as an aggregate with partial sums per task."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(array)
    return vector_to_array(getattr(Summarizer, name)(v, weight) if weight is not None else getattr(Summarizer, name)(v))
