import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from paywarden.session import build_session
    s = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def cut_everything():
    """A policy under which small fixtures already have hot keys."""
    from paywarden.plans.scan import SkewPolicy
    return SkewPolicy(min_rows=60, max_slices=64, sample_per_slice=4, small_bytes=0)
