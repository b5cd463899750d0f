import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from quorate.plans.runtime import ship

    ship(session)
    return session


FIXTURE = (
    "row_id string, source string, split string, group_id string, state string, questions map<string,struct<kind:string,instructions:string,criteria:string>>, "
    "labels map<string,map<string,double>>, weight double, label_source string, meta string, ord bigint"
)


@pytest.fixture(scope="session")
def fixture_rows(spark):
    """Makes a fixture table of dicts; missing columns are null."""

    def make(rows):
        names = [f.split(" ")[0] for f in FIXTURE.replace("struct<kind:string,instructions:string,criteria:string>", "x").replace("map<string,x>", "m").replace("map<string,map<string,double>>", "m").split(", ")]
        return spark.createDataFrame([tuple(r.get(n, k if n == "ord" else None) for n in names) for k, r in enumerate(rows)], FIXTURE)

    return make


@pytest.fixture(scope="session")
def state():
    return lambda claim, *texts, **more: json.dumps({"claim": claim, "evidence": [{"title": "t", "text": x} for x in texts], **more})
