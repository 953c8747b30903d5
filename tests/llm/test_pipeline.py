"""The pipeline's stages against brute force, and the driver's contract."""

import re

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import documents, edge_docs, empty_docs
from tests.llm.test_files_and_tokens import check_packing
from tests.llm.test_join import brute
from tests.llm.test_text_operators import brute_hits
from tidelog.llm import pii
from tidelog.llm.common import materialize


def test_stages_against_brute_force(spark, sf):
    from tokenizers import Tokenizer

    from tidelog.llm.queries import tokenizer_file

    stages, docs = dict(corpus_pipeline.STAGES), documents(spark, sf)
    columns = docs.columns
    run = lambda name, df: materialize(stages[name](spark, df, sf), name)
    one = run("language_id", docs)
    kept = {r["doc_id"] for r in one.collect()}
    assert one.columns == columns and {r["doc_id"] for r in docs.collect() if not re.search(r"[^\W\d_]", r["text"] or "")} & kept == set()
    assert len(kept) >= 0.97 * docs.count()
    two = run("near_duplicates", one)
    groups = brute([(r["doc_id"], r["text"]) for r in one.collect()])
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {c for _, _, c in groups}
    three = run("decontamination", two)
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert three.columns == columns and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect() if not brute_hits(r["text"], bench)[4]}
    four = run("private_data", three)
    assert four.columns == columns and all(r["n_chars"] == len(r["text"]) for r in four.collect())
    before = {r["doc_id"]: r["text"] for r in three.collect()}
    after = {r["doc_id"]: r["text"] for r in four.collect()}
    assert set(before) == set(after) and all(e not in after[i] for i, t in before.items() for e in re.findall(pii.EMAIL, t))
    five = run("packing", four)
    t = Tokenizer.from_file(tokenizer_file())
    check_packing(five.collect(), four.collect(), lambda x: t.encode(x or "", add_special_tokens=False).ids)


def test_run_and_edges(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "private_data", "packing"]
    for name, df in (("empty", empty_docs(spark)), ("edges", edge_docs(spark))):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert (out.count() == 0) == (name == "empty")


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names
