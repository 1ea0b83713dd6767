import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from revlens.session import build_session, ensure_checkpoint_dir  # noqa: E402

AS_OF = datetime(2001, 6, 15, 12, 0, 0)
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=4, app_name="revlens-tests")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="revlens-ckpt-"))
    yield s
    s.stop()


def ts(text: str | None):
    return None if text is None else datetime.fromisoformat(text)
