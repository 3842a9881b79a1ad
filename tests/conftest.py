import os

import pytest

from quillmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(int(os.environ.get("TEST_CPUS", "4")), 4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
