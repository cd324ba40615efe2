"""The driver's three functions, with the corpus operators and without them."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def ask(where):
    return subprocess.run([sys.executable, "-c", ASK], cwd=where, capture_output=True, text=True, check=True).stdout.split()


def test_without_corpus_operators(tmp_path):
    """The other queries stay when the folder, or all but empty folders of it, and the pipeline are gone."""
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    n, corpus, pipeline = ask(tmp_path)
    assert int(n) > 100 and (corpus, pipeline) == ("0", "False")
    (tmp_path / "tidemark/llm/__pycache__").mkdir(parents=True)
    assert ask(tmp_path) == [n, corpus, pipeline]


def test_entry(spark, folder):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["seg", "rev", "n"] and df.count() == 5


def test_nothing_else_imports_the_corpus_operators():
    for file in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"\bllm\b", file.read_text()), file
