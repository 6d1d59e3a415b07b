"""The registered queries next to their SQL, and their columns."""

import pytest
from cases import SF
from oracle import compare, connect

from archtrail.llm.queries import ORACLES, QUERIES

COLUMNS = {
    1: "doc_id n_shingles component_id", 2: "doc_id n_words n_hit n_items items_sha256 contaminated", 3: "doc_id size text_crc32 law shard slot grown_shard",
    5: "doc_id held_out n_tokens n_known train_tokens base_score score", 6: "doc_id start n_tokens ids_crc32", 7: "page_id host path rule verdict",
    8: "doc_id n_bytes n_removed n_spans kept_sha256", 10: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    11: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", 12: "doc_id n_words n_base first_word last_word base_labels labels score",
    13: "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_one_query_for_each_operator_over_whole_tables(spark):
    by_number = {int(name[2:].split("_")[0]): f for name, f in QUERIES.items()}
    assert sorted(by_number) == list(range(1, 14))
    for number, f in by_number.items():
        got = f(spark, SF)
        assert set(COLUMNS.get(number, "doc_id").split()) <= set(got.columns)
        table = spark.read.parquet(f"{SF}/{ {7: 'pages', 13: 'conversations'}.get(number, 'documents') }.parquet")
        assert got.count() == (table.select("conv_id").distinct() if number == 13 else table).count()
