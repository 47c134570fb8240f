import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
SAYS = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def told(folder):
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p and p != str(ROOT))})
    return done.returncode, done.stdout.split(), done.stderr


def test_entry_without_the_llm_package(tmp_path):
    shutil.copytree(ROOT / "pagemill", tmp_path / "pagemill", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code, words, _ = told(tmp_path)
    assert code == 0 and int(words[0]) > 60 and words[1:] == ["0", "True"]
    (tmp_path / "pagemill" / "llm" / "__pycache__").mkdir(parents=True)  # a folder without code is no package
    assert told(tmp_path)[:2] == (0, words)
    # a package that is there but broken isn't passed over
    (tmp_path / "pagemill" / "llm" / "__init__.py").write_text("")
    (tmp_path / "pagemill" / "llm" / "queries.py").write_text("import no_such_module\n")
    (tmp_path / "corpus_pipeline.py").write_text("ORACLE_SQL = None\n")
    code, _, error = told(tmp_path)
    assert code != 0 and "no_such_module" in error
