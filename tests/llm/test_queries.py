"""The queries against their SQL, and over the smallest tables."""

import os

import pytest

import check
from clickweir.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_sql(spark, name):
    assert check.compare(spark, check.connect(SF), SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


COLUMNS = {
    "op1": "doc_id start n_tokens ids_crc32", "op2": "doc_id n_words n_removed kept_sha256", "op3": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4": "vec_id n_links component_id kept", "op5": "page_id url text n_chars", "op6": "doc_id held_out lang_pred score", "op7": "doc_id item_id",
    "op8": "doc_id size source_size target taken", "op9": "doc_id fingerprint component_id", "op10": "page_id host path rule verdict",
    "op11": "doc_id size text_crc32 law shard slot grown_shard", "op12": "lang rank phrase a l r n score",
    "op13": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}
ROWS = {"op4": "embeddings", "op5": "pages", "op10": "pages"}


@pytest.mark.parametrize("name", queries.queries())
def test_whole_tables(spark, name):
    number = name.split("_")[0]
    got = queries.queries()[name](spark, SF)
    assert set(COLUMNS[number].split()) <= set(got.columns)
    rows = got.count()
    if number in ("op7", "op12"):
        assert rows > 0
    elif number == "op13":
        assert rows == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    else:
        assert rows == spark.read.parquet(f"{SF}/{ROWS.get(number, 'documents')}.parquet").count()
