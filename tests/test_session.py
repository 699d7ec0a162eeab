import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_submitted_master_and_settings_are_kept(tmp_path):
    code = ("from divspark.session import get_session, checkpoint_dir\n"
            "s = get_session()\n"
            "print('GOT', s.sparkContext.master, s.conf.get('spark.sql.shuffle.partitions'), checkpoint_dir(s))\n")
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_SUBMIT_ARGS":
                        "--master local[2] --conf spark.sql.shuffle.partitions=7 "
                        f"--conf spark.checkpoint.dir={tmp_path}/work pyspark-shell"}
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120).stdout
    got = out[out.index("GOT"):].split()
    assert got[1:3] == ["local[2]", "7"] and str(tmp_path / "work") in got[3]
