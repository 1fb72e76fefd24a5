import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_without_the_llm_folder():
    """With the subpackage gone the other queries are all there."""
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['gapline.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'skill_gaps' in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_llm_folder():
    for folder, _, names in os.walk(os.path.join(REPO, "gapline")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "gapline.llm" not in f.read()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["pair_id", "category", "ord", "span"]
