import inspect
import pathlib
import subprocess
import sys

import pytest

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "text", "n"] and out.filter("n > 0").count() > 0


def test_library_does_not_need_the_corpus_package():
    import umbra.plans.catalogue as c

    assert "llm" not in inspect.getsource(c)


@pytest.mark.parametrize("absent", ["umbra.llm", "corpus_pipeline", "public_tokenizers", "xxhash", "tokenizers"])
def test_core_queries_without_an_optional_part(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; assert 'detect_all' in e.queries() and 'detect_all' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=pathlib.Path(entry.__file__).parent)
