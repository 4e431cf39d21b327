"""Each stage of the pipeline on its own input against a brute-force version, and the whole."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from moothall.llm.bpe import vocabulary
from moothall.llm.decontaminate import normalise
from moothall.llm.jaccard_join import shingles

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def luhn_ok(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.toPandas())
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    assert all(list(x.columns) == COLUMNS for x in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "bpe"]


def test_clean_documents_stay(stages):
    labels = duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").df()
    clean, toxic = (set(labels[labels.toxic == k].doc_id) for k in (0, 1))
    kept = set(stages[1].doc_id)
    assert len(clean & kept) >= 0.95 * len(clean)
    assert len(toxic & kept) < len(toxic)


def test_one_of_each_near_copy_stays(stages):
    before, after = stages[1].sort_values("doc_id"), set(stages[2].doc_id)
    ids, sets = before.doc_id.tolist(), [shingles(t, 5) for t in before.text]
    root = {i: i for i in ids}
    for x in range(len(ids)):
        for y in range(x):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = root[ids[x]], root[ids[y]]
                root = {i: min(a, b) if r in (a, b) else r for i, r in root.items()}
    assert after == {i for i in ids if root[i] == i}


def test_passages_of_the_benchmark_go(stages):
    items = [x for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall() if len(x := normalise(t)) >= 8]
    before, after = stages[2], set(stages[3].doc_id)
    exact = {i for i, t in zip(before.doc_id, before.text, strict=True) if any(x in normalise(t) for x in items)}
    assert not exact & after
    assert len(after) >= 0.9 * (len(before) - len(exact))


def test_personal_values_change(stages):
    before, after = stages[3].set_index("doc_id"), stages[4].set_index("doc_id")
    assert set(before.index) == set(after.index)
    for i, t in before.text.items():
        new = after.text[i]
        assert after.n_chars[i] == len(new)
        for value in re.findall(r"[\w.]+@[\w.]+\w|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}|[0-9a-f]{40}", t):
            assert (value in new) == (len(value) == 16 and value.isdecimal() and not luhn_ok(value))  # only numbers whose check digit is right are personal


def test_tokens(stages):
    tokenizers = pytest.importorskip("tokenizers")
    lib, texts = tokenizers.Tokenizer.from_file(vocabulary()), stages[4].set_index("doc_id").text
    for r in stages[5].itertuples():
        ids = np.array(lib.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
