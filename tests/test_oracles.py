"""Each query with an oracle gives the oracle's rows."""

import ast
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from kavyamill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


CASES = {**{n: (f, registry.ORACLES[n]) for n, f in registry.QUERIES.items()}, **registry.GOLDEN}


@pytest.mark.parametrize("name", sorted(CASES))
def test_oracle(spark, sf, duck, name):
    query, sql = CASES[name]
    df = query(spark, sf)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert found == wanted


def test_every_query_has_an_oracle_and_reads_a_table():
    assert set(registry.QUERIES) == set(registry.ORACLES) and not set(registry.QUERIES) & set(registry.GOLDEN)
    assert all(set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split()) & set(TABLES) for sql in registry.ORACLES.values())


@pytest.mark.parametrize("path", sorted(Path(registry.__file__).parent.glob("*.py")), ids=lambda p: p.stem)
def test_no_module_binds_a_name_twice(path):
    """Queries read their module's tables when they run, so a name that is bound again gives them another's cases."""
    bound = Counter()
    for node in ast.parse(path.read_text()).body:
        if isinstance(node, ast.FunctionDef):
            bound[node.name] += 1
        elif isinstance(node, ast.Assign):
            bound.update(x.id for t in node.targets for x in ast.walk(t) if isinstance(x, ast.Name))
    assert [name for name, n in bound.items() if n > 1] == []
