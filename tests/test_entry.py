import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from helpers import as_sorted, rows

import __spark_entry__ as contract
from conftest import TESTDATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01", "sf0.1"])
def oracle(request):
    con = duckdb.connect()
    root = f"{TESTDATA}/{request.param}"
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    return con, root


@pytest.mark.parametrize("name", [n for n in sorted(contract.queries()) if n.startswith("proposal_")])
def test_query_matches_its_sql(spark, oracle, name):
    con, root = oracle
    result = contract.queries()[name](spark, root)
    wanted = con.execute(contract.oracle_sql()[name])
    assert result.columns == [column[0] for column in wanted.description]
    assert rows(result) == as_sorted(wanted.fetchall())


def test_everything_else_works_without_the_llm_subpackage():
    """The package is looked for where it is not, in a process of its own."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'tallyfold.llm' or name.startswith('tallyfold.llm.'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(sorted(e.queries()) == sorted(e.oracle_sql()) == sorted(n for n in e.queries() if n.startswith('proposal_')))\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=Path(contract.__file__).parent, capture_output=True, text=True
    )
    assert done.stdout.strip() == "True", done.stderr


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows_and_a_stable_schema(spark):
    result = contract.entry(spark)
    assert result.dtypes == [
        ("p_brand", "string"),
        ("month", "timestamp_ntz"),
        ("units", "double"),
        ("n_lines", "bigint"),
    ]
    assert result.count() > 0
