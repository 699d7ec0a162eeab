import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
# Python workers start from the JVM's environment: let them import test helpers too
os.environ["PYTHONPATH"] = os.pathsep.join(
    p for p in (ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")) if p)


EVENT_LOG_DIR = None


@pytest.fixture(scope="session")
def spark():
    import tempfile

    from divspark.session import checkpoint_dir, get_session

    global EVENT_LOG_DIR
    EVENT_LOG_DIR = tempfile.mkdtemp(prefix="divspark-events-")
    s = get_session(master="local[4]", shuffle_partitions=4,
                    extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": EVENT_LOG_DIR,
                           "spark.eventLog.compress": "false", "spark.driver.memory": "8g",
                           "spark.ui.showConsoleProgress": "false"})
    checkpoint_dir(s)
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
