"""The driver's contract, with and without the folders that may be deleted."""

import subprocess
import sys

import __spark_entry__ as entry


def test_every_query_is_named_and_has_its_sql():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 50


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.count() == 1100 and "w_tax_euro" in out.columns


def test_entry_works_without_the_llm_subpackage():
    code = "import sys; sys.modules['tankline.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; q = e.queries(); assert 'brands' in q and 'pipeline' not in q and not [k for k in q if k[:2] == 'op']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
