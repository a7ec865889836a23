"""Each stage of the pipeline on a small corpus, held against brute force, and the stages together."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swathframe.plans.bound import QUERIES

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(3000)]
    rows, labels, i = [], [], 0
    for k in range(500):
        text = " ".join(rng.choice(words, rng.integers(20, 90)))
        toxic = k % 7 == 0
        if toxic:
            text += " you zorkuse you idiot zorkand"
        if k % 11 == 0:
            text += f" password = abcdefghijkl{k}"
        copies = 3 if k % 10 == 1 else 1
        for _ in range(copies):
            rows.append((i, text, "en", f"s{k % 3}" if k % 50 else None, len(text)))
            labels.append((i, int(toxic)))
            i += 1
    rows += [(None, None, None, None, None), (9000, "", "en", "s0", 0), (9001, "", "en", "s1", 0), rows[5]]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{path}/labels.parquet")
    return str(path), rows, dict(labels)


def test_stages(spark, corpus):
    path, rows, labels = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "secret scan", "source mix", "byte bpe"]

    clean = stages["toxicity"](spark, docs, path)
    assert clean.columns == docs.columns
    kept = [r.doc_id for r in clean.collect()]
    toxic = {i for i, t in labels.items() if t}
    assert sum(i in toxic for i in kept) <= 0.05 * len(toxic) and sum(i in kept for i in labels if not labels[i]) >= 0.98 * (len(labels) - len(toxic))

    one = stages["simhash near-dedup"](spark, docs, path).collect()
    texts = [r.text or "" for r in one]
    assert len(texts) == len(set(texts)) == len({r[1] or "" for r in rows})  # texts here are copies or far apart
    assert {r.doc_id for r in one} == {min([r[0] for r in rows if (r[1] or "") == t and r[0] is not None], default=None) for t in {r[1] or "" for r in rows}}

    safe = stages["secret scan"](spark, docs, path)
    out = safe.collect()
    assert safe.columns == docs.columns and len(out) == len(rows)
    assert not any("password = a" in (r.text or "") for r in out) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)
    plain = sorted(r[1] or "" for r in rows if "password" not in (r[1] or ""))
    assert sorted(r.text or "" for r in out if "[assign]" not in (r.text or "")) == plain

    mixed = stages["source mix"](spark, docs, path).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {s: sum(size(r.text) for r in mixed if r.source == s) for s in {r[3] for r in rows}}
    assert abs(sum(taken.values()) - 1.5 * sum(size(r[1]) for r in rows)) <= 4 * 90
    assert max(sum(1 for r in mixed if r.doc_id == i) for i in {r.doc_id for r in mixed if r.doc_id not in (None, rows[5][0])}) <= 2


def test_run(spark, corpus):
    path, rows, labels = corpus
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    assert "pipeline" not in QUERIES  # registered with the training-data operators alone


CLASH = ("score", "score_", "prediction", "probability", "features", "label", "fp", "sketch", "group", "best", "component", "node", "blob", "hit", "spans", "path", "sources", "bin", "size", "mix", "mix_", "ids", "text_", "row", "row_", "part", "turn", "x", "v", "k", "r", "q", "p", "c", "m", "w", "h", "s", "n", "j", "e", "d", "own")
CLASH += tuple(f"__{c}" for c in ("m", "c", "w", "pass", "row", "blob", "found", "spans", "score", "x", "p", "v", "k", "r", "q"))


def test_stages_take_empty_tables_and_clashing_columns(spark, corpus):
    path, *_ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.limit(60).withColumns({c: F.concat(F.lit(f"{c}/"), F.coalesce("source", F.lit("-"))) for c in CLASH})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0
        out = stage(spark, wide, path)
        if name == "byte bpe":
            assert out.count() > 0
            continue
        rows = out.collect()
        assert rows and out.columns == wide.columns and out.schema["n_chars"].dataType == wide.schema["n_chars"].dataType
        assert all(r[c] == f"{c}/{r.source if r.source is not None else '-'}" for r in rows for c in CLASH), name
