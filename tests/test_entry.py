import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns[:4] == ["query_id", "rank", "score", "chunk_id"] and df.limit(1).count() == 1


def test_every_statement_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_engine_stands_alone(tmp_path):
    shutil.copytree(ROOT / "docquery", tmp_path / "docquery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and 'pipeline' not in e.queries() and not any(q.startswith('op') for q in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
