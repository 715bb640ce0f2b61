import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).parents[1]


def test_entry_offers_the_engine_when_a_library_is_missing():
    for blocked in ("corpusloom.llm", "zstandard", "corpus_pipeline"):
        code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; assert 'metrics_summary' in e.queries() and 'op1_token_store' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
        subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
