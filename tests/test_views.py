"""Views of the driver tables: how they are named in plans."""

import os
import re
import subprocess
import sys

import pytest

from shelfspark.plans import QUERIES, fixtures

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Plans a query in a session that has planned nothing yet.
FIRST = """
import sys
from pyspark.sql import SparkSession
from shelfspark.plans import QUERIES

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
QUERIES[sys.argv[1]](spark, sys.argv[2])._jdf.queryExecution().optimizedPlan()
print("planned")
"""


@pytest.mark.parametrize("name", ["p10_policy_profile", "v12_cadence_verdicts", "v13_verdict_counts", "v19_materials_to_act"])
def test_plans_define_no_relations(spark, name):
    assert "CTERelation" not in QUERIES[name](spark, DATA)._jdf.queryExecution().analyzed().toString()


def test_query_is_planned_as_the_first_of_its_session():
    found = subprocess.run([sys.executable, "-c", FIRST, "v12_cadence_verdicts", DATA], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert "planned" in found.stdout, found.stderr[-2000:]


@pytest.mark.parametrize("name", sorted(fixtures.VIEWS))
def test_view_reads_only_tables_and_views_of_its_folder(spark, monkeypatch, name):
    asked, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **b: asked.append(text) or sql(self, text, *a, **b))
    fixtures.view(spark, DATA, name)
    read = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", " ".join(asked))
    assert all(re.match(r"v[0-9a-f]{8}_", x) for x in read), read
