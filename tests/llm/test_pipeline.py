import hashlib

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from stratacat.llm import bpe_transducer

from .cases import SCHEMA

BASE = [" ".join(f"{c}{(i * k) % 211}" for i in range(120)) + " ends here." for k, c in enumerate("abcde", 3)]


def test_stages(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(25))
    rows = [
        (1, BASE[0], "en", "s", 1), (2, BASE[0], "en", "s", 1), (3, BASE[0].replace("a9 ", "zz "), "en", "s", 1), (4, BASE[1] + " " + item, "en", "s", 1),
        (5, BASE[2] + " write to jo@mail.example.com", "en", "s", 1), (6, "too short", "en", "s", 1), (7, None, "en", "s", None), (8, BASE[3], None, "s", 1), (None, BASE[4], "en", None, 1),
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    texts = {1: BASE[0], 5: BASE[2] + " write to <EMAIL>", 8: BASE[3], None: BASE[4]}
    assert set(got) == set(texts)
    tok = Tokenizer.from_file(P.path(bpe_transducer.MODEL))
    tok.no_truncation()
    for doc, text in texts.items():
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (got[doc].n_tokens, got[doc].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
