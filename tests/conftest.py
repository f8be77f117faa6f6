from __future__ import annotations

import pytest

from sillage.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    made = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__checkpoint__dir=f"file://{folder}")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
