import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print('pipeline' in e.queries(), 'op1_decontaminate' in e.queries(), 'records' in e.queries(), 'records' in e.oracle_sql())"


def says(folder):
    return subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, check=True).stdout.split()


def test_the_rest_works_without_the_training_data_folders(tmp_path):
    for how, gone in (("folder", ["spanloom/llm"]), ("files", ["spanloom/llm/queries.py"]), ("all", ["spanloom/llm", "corpus_pipeline.py"])):
        copy = tmp_path / how
        copy.mkdir()
        shutil.copytree(REPO / "spanloom", copy / "spanloom", ignore=shutil.ignore_patterns("__pycache__"))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if (REPO / name).exists():
                shutil.copy(REPO / name, copy)
        (copy / "spanloom/llm/__pycache__").mkdir(parents=True, exist_ok=True)
        for name in gone:
            if name.endswith("queries.py"):
                for path in (copy / "spanloom/llm").glob("*.py"):
                    path.unlink()
            elif (copy / name).is_dir():
                shutil.rmtree(copy / name)
            elif (copy / name).exists():
                (copy / name).unlink()
        assert says(copy) == ["False", "False", "True", "True"]
