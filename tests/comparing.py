"""Comparing results."""


def same(frame, rows) -> bool:
    """Whether a Spark frame and a DuckDB result hold the same rows, whatever their order."""
    mine, other = frame.toPandas(), rows.df()
    columns = sorted(mine.columns)
    if columns != sorted(other.columns):
        return False
    plain = lambda v: v.item() if hasattr(v, "item") else v
    key = lambda t: sorted(repr(tuple(plain(v) for v in row)) for row in t[columns].itertuples(index=False))
    return key(mine) == key(other)
