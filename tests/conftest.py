import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from cargolens.session import configure
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


@pytest.fixture(scope="session")
def tables(spark):
    from cargolens.plans.registry import load_all
    from cargolens.plans.tables import driver_tables
    load_all()
    return driver_tables(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    from cargolens.plans.compare import duck as connect
    return connect(SF_SMALL)
