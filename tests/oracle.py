"""Compare a query with its SQL: columns by name, rows in any order."""

from decimal import Decimal


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, Decimal)) else v
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def same(df, con, sql):
    found = con.execute(sql)
    cols = [d[0] for d in found.description]
    expected = found.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, expected)
