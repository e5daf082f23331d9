import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ordinal", "category", "distance"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_everything_else_works_without_the_optional_part(tmp_path):
    import shutil

    for name in ("orrery", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "orrery" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_point' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
