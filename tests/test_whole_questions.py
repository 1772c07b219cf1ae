"""Searches by all words of an item, against their SQL: documents that share only a word that comes early are found too."""

import duckdb
import pytest

from fabula.plans import QUERIES, SQL

NAMES = ["ret10_mth6_metadata_rescoring", "ret11_relaxed_fusion", "ret12_hybrid_rerank", "ret16_question_tags", "ret17_document_prefetch", "ret4_any_term_bm25", "str14_token_similarity"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("questions")
    tables = {
        "benchmark": ([(1, "Zulu yankee, xray whisky alpha Bravo alpha"), (2, "echo zulu"), (3, ""), (4, None)], "item_id bigint, text string"),
        "documents": ([(1, "alpha bravo\nindigenous alpha", "en", "s", 28), (2, "zulu yankee xray\nmiscellaneous", "en", "s", 30), (3, "echo echo", None, None, 9), (4, "foxtrot", "en", "s", 7), (5, None, "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "embeddings": ([(i, [float(i), 1.0, 0.5]) for i in range(4)], "vec_id bigint, embedding array<float>"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_all_words_of_an_item_are_asked_for(spark, small, name):
    with duckdb.connect() as db:
        for table in ("benchmark", "documents", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet/*.parquet'")
        want = db.execute(SQL[name]).fetchall()
    found = QUERIES[name](spark, small)
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(want)
    early = (1, "indigenous") if "tag" in found.columns else (1, 1)  # question 1 and what it shares alpha and bravo with
    assert early in {r[:2] for r in rows}
