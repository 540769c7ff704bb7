from __future__ import annotations


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(str([plain(r[n]) for n in names]) for r in df.collect())


def sql_rows(duck, sql: str) -> tuple[list[str], list[str]]:
    r = duck.execute(sql)
    given = [d[0] for d in r.description]
    names = sorted(given)
    at = [given.index(n) for n in names]
    return names, sorted(str([plain(row[i]) for i in at]) for row in r.fetchall())
