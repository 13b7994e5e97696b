import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from scriptorium.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture()
def tmpdir_run():
    """A fresh scratch folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def write_files(folder: str, contents: dict[str, bytes | str]) -> str:
    for name, data in contents.items():
        mode = "wb" if isinstance(data, bytes) else "w"
        with open(os.path.join(folder, name), mode, **({} if mode == "wb" else {"encoding": "utf-8"})) as f:
            f.write(data)
    return folder
