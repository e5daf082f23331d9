"""Every query with SQL against that SQL, on the smallest tables."""

import duckdb
import pytest

from orrery.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v


def same(x, y):
    """Numbers may differ in their last digit, all else not at all."""
    return x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, sql, name):
    a, b = catalog.QUERIES[name](spark, sf).toPandas(), sql.execute(catalog.ORACLE[name]).fetchdf()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    # Columns without fractions first, so that a last digit does not change the order of the rows.
    exact = [c for c in columns if a[c].dtype.kind != "f"]
    order = exact + [c for c in columns if c not in exact]
    rows = lambda t: sorted((tuple(map(plain, r)) for r in t[order].itertuples(index=False)), key=lambda r: tuple((v is None, str(type(v)), v) for v in r))
    for x, y in zip(rows(a), rows(b), strict=True):
        assert all(map(same, x, y)), (x, y)


def test_the_sql_uses_none_of_the_formulas():
    from pathlib import Path

    text = Path(catalog.O.__file__).read_text()
    assert "orrery.functions" not in text.replace("Nothing of ``orrery.functions`` is used", "") and "import sphere" not in text
