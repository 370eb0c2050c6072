"""The package reaches workers as a file, without PYTHONPATH and without the repository on their path."""

import os
import subprocess
import sys
import textwrap
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_workers_get_the_package_by_file(tmp_path):
    archive = tmp_path / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in (ROOT / "tidemark").rglob("*.py"):
            z.write(f, f.relative_to(ROOT))
    job = tmp_path / "job.py"
    job.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(archive)!r})
        from tidemark.session import session
        spark = session("local-cluster[1,1,1024]", 2, **{{"spark.ui.enabled": "false", "spark.driver.memory": "1g", "spark.executor.memory": "1g", "spark.submit.pyFiles": {str(archive)!r}}})
        spark.sparkContext.addPyFile({str(archive)!r})
        import tidemark
        assert {str(archive)!r} in tidemark.__file__, tidemark.__file__
        from tidemark.operators.blocks import deal, recursive_averages
        rows = spark.range(50).selectExpr("'a' AS symbol", "id AS date", "CAST(id AS DOUBLE) AS x")
        assert recursive_averages(deal(rows, 10), {{"y": ("x", 0.5, False)}}).count() == 50
        print("shipped")
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(job)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "shipped" in done.stdout, done.stderr[-2000:]
