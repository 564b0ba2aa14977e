"""Every query of the text operators runs on the smallest tables; those with SQL give its rows."""

import duckdb
import pytest

from terrasample.llm import queries as Q
from tests.test_queries import SF, TABLES, norm

COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
}


@pytest.mark.parametrize("name", list(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
        table = {"op6_chat_format": None, "op9_embedding_dedup": "embeddings"}.get(name, "documents")
        assert table is None or len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in Q.oracle_sql():
        c = duckdb.connect()
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        want = c.sql(Q.oracle_sql()[name])
        names = sorted(want.columns)
        assert names == sorted(df.columns)
        at = [want.columns.index(x) for x in names]
        assert sorted((tuple(norm(r[x]) for x in names) for r in rows), key=repr) == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
