from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app_name="ledgerline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def star(spark):
    from ledgerline.sources.warehouse import star_for

    return star_for(spark, SF_SMALL)
