"""Every table's contract on rows as vendors send them."""

import pytest
from pyspark.sql import types as T

from barloom.sources.contracts import conform
from barloom.sources.tables import CONTRACTS, TABLES


def test_every_landed_table_has_a_contract(spark):
    assert len(CONTRACTS) == 39 and len(TABLES) == 33
    for c in CONTRACTS.values():
        names = c.schema.names
        assert len(set(names)) == len(names) and set(c.key) <= set(names) and c.day in names and set(c.dates) <= set(names), c.name


def dirty(f, contract, row):
    """A value of a column: good in row 0, for nothing in row 1."""
    if f.name == contract.day and f.name in contract.dates:
        return ["2024-01-05", "20240108 x"][row]
    if f.name in contract.dates:
        return ["2024-02-01", "2024"][row]
    if any(f.name == c for c, _ in contract.allowed):
        return ["s", " R "][row]
    if isinstance(f.dataType, T.StringType):
        return [f"  text {f.name} ", "good" if f.name in (contract.day, contract.key[0]) else "nan"][row]
    return ["7", "n/a"][row] if not isinstance(f.dataType, T.TimestampType) else ["2024-01-05 10:00:00", None][row]


def clean(f, contract, row):
    if f.name == contract.day and f.name in contract.dates:
        return ["20240105", "20240108"][row]
    if f.name in contract.dates:
        return ["20240201", "" if f.name in contract.key else None][row]
    if any(f.name == c for c, _ in contract.allowed):
        return ["S", "R"][row]
    if isinstance(f.dataType, T.StringType):
        good = f"text {f.name}" if row == 0 else "good" if f.name in (contract.day, contract.key[0]) else "" if f.name in contract.key else None
        return good.upper() if good and f.name in contract.upper else good
    if isinstance(f.dataType, T.TimestampType):
        return row == 0
    return 7 if row == 0 else None


@pytest.mark.parametrize("name", sorted(c.name for c in TABLES))
def test_contract(spark, name):
    contract = CONTRACTS[name]
    fields = contract.schema.fields
    source = {t: s for s, t in contract.renames}
    columns = [source.get(f.name, f.name) for f in fields]
    rows = [tuple(dirty(f, contract, r) for f in fields) for r in (0, 1)]
    without_day = tuple("" if f.name == contract.day else v for f, v in zip(fields, rows[0]))
    page = spark.createDataFrame([(*r, "more") for r in [*rows, without_day]], ", ".join(f"`{c}` string" for c in columns) + ", vendor_extra string")
    out = conform(page, contract)
    assert out.schema.names == contract.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in fields]
    got = [tuple(v is not None if isinstance(f.dataType, T.TimestampType) else v for f, v in zip(fields, r)) for r in out.collect()]
    assert got == [tuple(clean(f, contract, r) for f in fields) for r in (0, 1)]
    # Absent columns: '' in a text key, null elsewhere.
    few = [c for c in (contract.day, *(c for c, _ in contract.allowed))]
    lean = conform(page.select(*few), contract).first()
    for f in fields:
        if f.name not in few:
            assert lean[f.name] == ("" if f.name in contract.key and isinstance(f.dataType, T.StringType) else None)
