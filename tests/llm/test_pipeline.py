"""The pipeline on the smallest tables: each stage on its predecessor's rows."""

import hashlib

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from argusframe.llm import bpe, decontam, linededup, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= kept and docs.count() == len(ids)
        kept = ids
        if name != "byte_bpe":
            assert docs.columns == columns
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in docs.collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(r.ids) == r.n_tokens


def plain_duplicates(texts):
    """Of each group linked by a similarity of 0.8 or more the smallest id, by comparing every pair."""
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label, order = {i: i for i in sets}, sorted(sets)
    near = [(i, j) for n, i in enumerate(order) for j in order[:n] if sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    while any(label[i] != label[j] for i, j in near):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return {i for i in sets if label[i] == i}


def test_run_gives_the_stages_rows(spark, reference_texts):
    """Each row of the run is a document that every stage's plain version keeps, with the text that it leaves."""
    import numpy as np
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    want = {}
    for i, t in reference_texts.items():
        ids = own.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want and len(got) > 50


@pytest.fixture(scope="module")
def reference_texts(spark):
    """The texts before encoding, stage by stage in plain Python; the classifier's model and the leak search of one text are the operators' own, tested elsewhere."""
    from test_operators import plain_line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if model.score(quality.statistics(t or "")[None])[0] >= 0.3}
    cut = plain_line_dedup(sorted(texts.items()), linededup.MIN_LINES, linededup.LONG_WORDS)
    texts = {i: t for i, (t, removed, _, _) in cut.items() if not removed or (t or "").strip(" ")}
    texts = {i: texts[i] for i in plain_duplicates(texts)}
    words, items = decontam.Templates(), []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        items.append(words.template(words.numbers(r.text or "")))

    def leaks(text):
        t, v = words.template(words.numbers(text or ""))
        for u, w in items:
            n = min(decontam.WINDOW, len(u))
            if n < decontam.LEAST:
                continue
            a, b = decontam.windows(t, v, n), decontam.windows(u, w, n)
            its, mine = decontam._slots(t, v, np_range(len(a)), n), decontam._slots(u, w, np_range(len(b)), n)
            found = [(p, q, n, its[p].tolist(), mine[q].tolist()) for p in range(len(a)) for q in range(len(b)) if a[p] == b[q]]
            if found and decontam.longest_leak(len(u), found):
                return True
        return False

    return {i: t for i, t in texts.items() if not leaks(t)}


def np_range(n):
    import numpy as np

    return np.arange(n)


def test_stages_of_awkward_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, clashing names, empty tables: every stage gives its columns, and the run's ids are some of the input's."""
    import shutil

    from test_operators import SCHEMA, awkward

    sf = tmp_path / "tables"
    shutil.copytree(SF, sf)
    shutil.rmtree(sf / "documents.parquet", ignore_errors=True)
    (sf / "documents.parquet").unlink(missing_ok=True)
    rows = awkward()
    for name, some in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(some, SCHEMA)
        docs.write.mode("overwrite").parquet(str(sf / "documents.parquet"))
        out = spark.read.parquet(str(sf / "documents.parquet"))
        for stage, f in corpus_pipeline.STAGES[:-1]:
            f(spark, out, str(sf)).write.parquet(str(tmp_path / f"{name}-{stage}"))
            out = spark.read.parquet(str(tmp_path / f"{name}-{stage}"))
            assert out.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, out, str(sf)).collect()
        assert {r.doc_id for r in last} <= {r[0] for r in some} and len(last) == out.count()
    assert not last


def test_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
