import subprocess
import sys

import __spark_entry__


def test_names_and_twins(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_imports_without_the_optional_subpackage(tmp_path):
    """A copy without the subpackage and the pipeline still offers the other queries."""
    import os
    import shutil

    here = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{here}/gaugeworks", tmp_path / "gaugeworks", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
