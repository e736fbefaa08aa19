"""Queries that begin with a lookup, train or iterate, on tables without rows."""

import glob
import os

import pytest

from docloom.plans import catalog
from tests.conftest import DATA

NAMES = """vector_topk vector_topk_per_group vector_topk_filtered vector_batch_default vector_minmax_dedup two_vector_average ivf_topk ivf_graph knn_self multi_hop multi_hop_top
hops_by_country pagerank betweenness communities word_vectors stemmed_search rescrape_stream country_json sector_periods citations_by_country bm25_topk""".split()


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for p in glob.glob(f"{DATA}/*.parquet"):
        spark.read.parquet(p).limit(0).coalesce(1).write.parquet(f"{folder}/{os.path.basename(p)}")
    return folder


@pytest.mark.parametrize("name", NAMES)
def test_without_rows(spark, empty, name):
    assert catalog.queries()[name](spark, empty).count() == 0
