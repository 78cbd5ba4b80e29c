import decimal
import math


def plain(v):
    """One spelling for equal values of both engines."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def duck_rows(con, sql, columns):
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    picked = found.project(", ".join(f'"{c}"' for c in columns))
    return sorted((tuple(plain(v) for v in r) for r in picked.fetchall()), key=repr)
