import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomspan.session import build_session

    s = build_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("wh"))})
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ck")))
    yield s
    s.stop()


TABLES = "skills versions capabilities tags repositories version_snapshots sync_changelog documents taxonomy_ref license_ref pack_targets name_hints part events customer orders".split()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def empty_dir(spark, small_dir, tmp_path_factory):
    """All tables with their columns and no rows."""
    d = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"{small_dir}/{t}.parquet").where("false").coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
