import subprocess
import sys

from pyspark import cloudpickle

from tickloom.plans import oracle


def test_task_functions_run_where_the_package_is_not_installed(tmp_path):
    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps(oracle.with_views))
    code = "import pickle; f = pickle.load(open('f.pkl', 'rb')); print(f('SELECT 1').split()[-2:])"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": ""})
    assert out.stdout.strip() == "['SELECT', '1']", out.stderr
