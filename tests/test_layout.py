"""The library stands without its optional subpackage."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_outside_imports_the_corpus_operators():
    own = [p for p in (ROOT / "segue").rglob("*.py") if "llm" not in p.relative_to(ROOT / "segue").parts]
    assert own and not [p for p in own if re.search(r"\bllm\b", p.read_text())]


def test_entry_without_them(tmp_path):
    for p in [ROOT / "__spark_entry__.py", *(ROOT / "segue").rglob("*.py")]:
        if "llm" not in p.relative_to(ROOT).parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q); print('fine')"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
    assert got.stdout.strip() == "fine", got.stderr
