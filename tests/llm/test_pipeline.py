"""The pipeline's stages and run() on a small table, against plain Python."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from test_corpus import contaminated_brute, join_brute, prose

import corpus_pipeline
from glyphflow.llm import common, pii, quality_cnn
from glyphflow.llm.queries import DEMO_KEY


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)
    docs = [(i, prose(rng, 60)) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(6)]
    docs += [(200 + i, docs[10 + i][1] + " more") for i in range(6)]
    items = [(k, " ".join(docs[20 + k][1].split()[5:25])) for k in range(4)]
    docs += [(300 + i, f"{prose(rng, 30)} mail a.b{i}@mail8.example.com now") for i in range(5)]
    docs += [(400 + i, "the " * (50 + i)) for i in range(20)]
    docs += [(500 + k, f"{prose(rng, 700)} {items[k][1]} {prose(rng, 100)}") for k in range(2)]  # under a twentieth
    docs += [(600, f"{prose(rng, 60)} {' '.join(items[0][1].split()[:12])}")]  # no whole window
    labels = [(i, int(not 400 <= i < 500)) for i, _ in docs]
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(i, t, len(t)) for i, t in docs], "doc_id long, text string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at, docs, items


def test_stages_and_run(spark, tables):
    from tokenizers import Tokenizer

    at, rows, items = tables
    network = quality_cnn.fit(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    tok, hide = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), pii.Pseudonymizer(DEMO_KEY)

    def quality(rows):
        good = network.scores([t.encode() for _, t in rows]) >= quality_cnn.THRESHOLD
        return [r for r, g in zip(rows, good, strict=True) if g]

    def near(rows):
        return [r for r in rows if any(i == c == r[0] for i, c, _, _ in join_brute(rows))]

    def clean(rows):
        bad = contaminated_brute(rows, items)[1]
        return [r for r in rows if r[0] not in bad]

    def encoded(rows):
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        ids = [(i, tok.encode(t, add_special_tokens=False).ids) for i, t in rows]
        return Counter((i, len(x), sha(" ".join(map(str, x))), sha(tok.decode(x, skip_special_tokens=False))) for i, x in ids)

    plain = [quality, near, clean, lambda rows: [(i, hide(t)[0]) for i, t in rows]]
    docs, sizes = spark.read.parquet(f"{at}/documents.parquet"), [len(rows)]
    for (_, stage), own in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        docs, before, rows = common.cut(stage(spark, docs, at)), rows, own(rows)
        got = docs.collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        sizes.append(len(rows))
    assert all(r["n_chars"] == len(r["text"]) for r in got) and before != rows
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0  # every stage has something to do
    assert Counter(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, at).collect())) == encoded(rows)
    assert Counter(map(tuple, corpus_pipeline.run(spark, at).collect())) == encoded(rows)
