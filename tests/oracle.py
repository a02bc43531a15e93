"""Holds queries against their SQL."""

from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return db


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 5)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)


def rows_in(db, sql):
    names = sorted(db.sql(sql).columns)
    picked = ", ".join(f'"{n}"' for n in names)
    return names, sorted((tuple(plain(x) for x in r) for r in db.sql(f"SELECT {picked} FROM ({sql})").fetchall()), key=repr)
