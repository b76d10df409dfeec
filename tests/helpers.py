import os

import duckdb


def oracle(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def same(df, con, sql):
    """Whether a DataFrame has the rows and columns of an SQL text."""
    r = con.sql(sql)
    assert sorted(df.columns) == sorted(r.columns)
    assert rows(df.columns, df.collect()) == rows(r.columns, r.fetchall())


#: Made up for these tests; tests/test_features.py works out their vectors by hand.
REQUEST_A = {
    "id": "small",
    "transaction": {"amount": 250.0, "installments": 3, "requested_at": "2025-01-06T23:30:00Z"},
    "customer": {"avg_amount": 500.0, "tx_count_24h": 1, "known_merchants": ["bakery", "books"]},
    "merchant": {"id": "books", "mcc": "5912", "avg_amount": 125.0},
    "terminal": {"is_online": True, "card_present": False, "km_from_home": 12.5},
    "last_transaction": None,
}
REQUEST_B = {
    "id": "large",
    "transaction": {"amount": 30000.0, "installments": 24, "requested_at": "2025-06-15T00:00:10Z"},
    "customer": {"avg_amount": 0.0, "tx_count_24h": 50, "known_merchants": []},
    "merchant": {"id": "jewels", "mcc": "7995", "avg_amount": 20000.0},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 5000.0},
    "last_transaction": None,
}
REQUEST_C = REQUEST_A | {"id": "after", "last_transaction": {"timestamp": "2025-01-06T20:21:59Z", "km_from_current": 62.5}}
