"""Rows of both engines in one form."""


def plain(v):
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return str(v)


def rows(df, columns=None):
    cols = columns or sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def same(a, b):
    """Equal but for a last rounded digit."""
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-5 * max(1, abs(a))
    return a == b
