import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from oracle import SF_DIR, compare  # noqa: E402

import __spark_entry__  # noqa: E402

LLM = [n for n in __spark_entry__.queries() if n.startswith(("p1_", "p2_", "p5_", "p6_", "p7_", "p8_"))]


@pytest.mark.parametrize("name", [n for n in LLM if n in __spark_entry__.oracle_sql()])
def test_against_sql(spark, name):
    # Over the hundred documents of the smallest tables no choice meets every budget.
    compare(spark, name, "/root/testdata/sf0.01" if name in ("p7_shares", "p7_kept") else SF_DIR)


def test_every_document_is_packed_and_no_draw_exceeds_its_cap(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    queries = __spark_entry__.queries()
    assert queries["p6_places"](spark, SF_DIR).select("doc_id").distinct().count() == documents.count()
    caps = {r.source: r.max_repeats for r in queries["p7_shares"](spark, SF_DIR).collect()}
    assert all(r.draws <= caps[r.source] for r in queries["p7_draws"](spark, SF_DIR).collect())
