import hashlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from fabula.llm import byte_bpe, jaccard_join

from . import brute
from .data import words


def test_pipeline_against_brute_force(spark, tmp_path):
    import random

    import public_tokenizers
    import tiktoken

    rng = random.Random(5)
    good = [" ".join(words(rng, 90, s)) for s in "abcdef"]
    item = " ".join(words(rng, 30, "q"))
    texts = [*good, good[1], good[2] + " tail", "too short", "# $ | " * 60, f"{good[3]} {item}", good[4] + " password=abcdefghijklmnop", None, ""]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)] + [(None, " ".join(words(rng, 90, "g")), "en", None, 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    kept = {k: t for k, t in enumerate(texts) if t and brute.quality(t)[0] >= 50 and brute.quality(t)[2] == 0}
    least = {i: c for i, _, c in brute.components(list(kept.items()))}
    kept = {i: t for i, t in kept.items() if least[i] == i and item not in t}
    assert {k for k in got if k is not None} == set(kept) and None in got
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.default_ranks()), special_tokens={})
    for i, t in kept.items():
        for a, _, b, _ in reversed(brute.strong_spans(t)):
            t = f"{t[:a]}[redacted]{t[b:]}"
        r = got[i]
        assert r["text"] == t and r["n_chars"] == len(t) and r["decodes"]
        assert np.frombuffer(r["ids"], "<u4").tolist() == plain.encode_ordinary(t)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()


def test_near_duplicates_go_by_row_and_by_80_percent(spark):
    import random

    rng = random.Random(7)
    a, b, c = (" ".join(words(rng, 300, s)) for s in "abc")
    tail = f"{a} {' '.join(words(rng, 65, 'd'))}"  # 296 of 361 five-word shingles, 82 %
    rows = [(1, a), (2, tail), (None, a), (None, b), (4, f"{a} end"), (4, c)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.near_duplicates(spark, df.repartition(3), "").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {(1, a), (None, b), (4, c)} and len(got) == 3


def test_components_at_80_percent_of_five_words(spark):
    w = [f"t{k}" for k in range(300)]
    data = [(k, " ".join(w[7 * k : 7 * k + 60])) for k in range(30)] + [(100 + k, " ".join(w[7 * k : 7 * k + 72])) for k in range(30)]
    sets = {i: {tuple(x[k : k + 5]) for k in range(len(x) - 4)} for i, x in ((i, t.split()) for i, t in data)}
    least = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            least[x] = min(least[y] for y in sets if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]))
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    got = jaccard_join.join(df, ngram=5, percent=80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), least[i]) for i in sets}
    assert len({*least.values()}) < len(data)


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20).withColumn("k0", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == corpus_pipeline.COLUMNS, name


def test_near_duplicates_keep_one_row_of_each_component(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near, other = text.replace("w39", "x"), " ".join(f"v{k}" for k in range(40))
    data = [(5, text), (5, text), (5, near), (5, other), (None, near), (None, "alone but for the id and of some more words"), (None, "another one without an id and with other words"), (None, None), (8, ""), (9, ""), (2, f"{text} {other}")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint, _h string")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    kept = [r for r in got if r[1] in (text, near)]
    assert len(kept) == 1 and kept[0][0] == 5
    assert sorted(got, key=repr) == sorted([*kept, *(r for r in data if r[1] not in (text, near))], key=repr)


def test_stages_of_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name


def test_registry_has_every_operator():
    names = [*__spark_entry__.queries()]
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
