import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("more", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_llm_folders(tmp_path, more):
    """With the pipeline's file gone too, and with it left behind."""
    for name in ("colinear", "__spark_entry__.py", "bench.py", *more):
        if (REPO / name).exists():
            (shutil.copytree if (REPO / name).is_dir() else shutil.copy)(REPO / name, tmp_path / name)
    shutil.rmtree(tmp_path / "colinear" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pair_coverage' in q and 'maf_rows' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
