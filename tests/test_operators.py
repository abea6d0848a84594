"""Operators on Spark: queries against their SQL, columns against the semantics on one text."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import canonical
from pyspark.sql import functions as F

import __spark_entry__
from glyphflow import core, schema
from glyphflow import functions as G
from glyphflow.config import TokenizerConfig
from glyphflow.operators.tokenizer import Tokenizer
from glyphflow.plans.queries import ORACLES, QUERIES
from glyphflow.sources import kvariants_etl, read_kvariants, read_lexicon, read_texts
from glyphflow.streaming import term_counts, tokenize_stream


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 80
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


TEXTS = ["The quick (\"brown\") fox, right? camelCase", "Привет, мир! 漢字とかな、한국어 العربية ภาษา 123 ＡＢ", "", None, "a b\0c\n\n. , ; ½ 1½ résumé", "السلام عليكم، كيف حالكم؟"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def test_columns_are_the_semantics(texts):
    t = Tokenizer(TokenizerConfig(create_char_map=True, stop_words=frozenset({"The"})))
    rows = texts.select("text", t.tokenize("text").alias("t"), t.reconstruct("text").alias("r"), t.segment("text").alias("s"), t.normalize_tokens(t.segment("text")).alias("n"), t.segment_str("text").alias("p")).collect()
    for row in rows:
        if row["text"] is None:
            assert row["t"] is None and row["r"] is None and row["p"] is None
            continue
        want = list(core.Engine(t.config).tokens(row["text"]))
        assert [(x["lemma"], x["kind"], x["separator_kind"]) for x in row["t"]] == [w[3][:3] for w in want]
        assert [[tuple(p) for p in x["char_map"]] if x["char_map"] is not None else None for x in row["t"]] == [w[3][3] for w in want]
        assert row["n"] == row["t"] and row["p"] == [w[0] for w in want]
        for x in row["r"]:
            token = x["token"]
            assert x["original"] == row["text"][token["char_start"] : token["char_end"]] == row["text"].encode()[token["byte_start"] : token["byte_end"]].decode()


def test_scripts_of_own_and_mixed_texts(spark, sf_dir, texts):
    """No text is replaced: own texts, alone and with enough of another script, and mixed strings."""
    got = {r["doc_id"]: r["script"] for r in QUERIES["script_majority"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got == {r["doc_id"]: core.detect_script(r["text"]) for r in docs.select("doc_id", "text").collect()}
    mixed = [*(t for t in TEXTS if t is not None), "12 - 34", "Жжж ab", "ab 漢か漢か", "ab жя", "한국어 a", "ภาษา ab", "العربية ab"]
    rows = spark.createDataFrame([(t,) for t in mixed], "text string").select("text", G.detect_script("text").alias("script")).collect()
    assert [r["script"] for r in rows] == [core.detect_script(t) for t in mixed]


def test_native_splits(texts):
    rows = texts.filter("id not in (5)").select("text", G.segment_native("text").alias("a"), G.script_groups("text").alias("g"), G.split_custom("text", [", ", " "]).alias("c")).collect()
    engine, own = core.engine(TokenizerConfig()), core.engine(TokenizerConfig(separators=(", ", " ")))
    for row in rows:
        if row["text"]:
            assert row["g"] == engine.groups(row["text"]) and row["a"] == [p for g in engine.groups(row["text"]) for p in engine.split(g)]
            assert row["c"] == own.split(row["text"])


def test_types(texts):
    t = Tokenizer()
    assert t.transform(texts).schema["tokens"].dataType.elementType.fieldNames() == schema.TOKEN.fieldNames()
    out = t.explode(texts)
    assert out.columns[:2] == ["id", "pos"] and out.filter("kind = 'separator' AND separator_kind IS NULL").count() == 0


def test_original_lengths(spark):
    t = Tokenizer(TokenizerConfig(create_char_map=True))
    row = spark.createDataFrame([("ṩab",)], "text string").select(F.explode(t.tokenize("text")).alias("t"))
    assert [tuple(row.select(G.original_lengths(F.col("t"), n).alias("x")).first()["x"]) for n in range(4)] == [(0, 0), (1, 3), (2, 4), (3, 5)]
    plain = spark.createDataFrame([("éab",)], "text string").select(F.explode(Tokenizer(TokenizerConfig(lossy=False)).segment("text")).alias("t"))
    assert [tuple(plain.select(G.original_lengths(F.col("t"), n).alias("x")).first()["x"]) for n in (0, 1, 2, 3)] == [(0, 0), (1, 2), (1, 2), (2, 3)]


def test_sources(spark, tmp_path):
    (tmp_path / "k.tsv").write_text("亚 (U+4E9A)\tsimp\t亞 (U+4E9E)\nxx\tother\ty\n亚\t=\t亜\n")
    assert dict(read_kvariants(kvariants_etl(spark, str(tmp_path / "k.tsv")))) == {"亚": "亜"}
    (tmp_path / "w.txt").write_text("ไก่\n\n บน \nไก่\n")
    words = read_lexicon(spark, str(tmp_path / "w.txt"))
    assert words == ("บน", "ไก่")
    assert core.segmenter("thai", TokenizerConfig(lexicons=(("thai", words),)))("ไก่บนก") == ["ไก่", "บน", "ก"]
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert read_texts(spark, str(tmp_path / "t.txt"), "text").first()["text"] == "one\ntwo"


def test_stream_drops_late_words(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:01", "a b"), ("2024-01-01 00:30:00", "b c")], "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = term_counts(stream, "ts", "text", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("terms").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["lemma"], r["n"]) for r in spark.table("terms").collect()) == [("a", 1), ("b", 1), ("b", 1), ("c", 1)]
    assert tokenize_stream(stream).isStreaming


def test_without_the_corpus_operators(tmp_path):
    """A copy without glyphflow/llm, tests/llm and (or) corpus_pipeline.py still has all other queries."""
    here = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    for gone in ("glyphflow/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    ask = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for _ in range(2):  # with corpus_pipeline.py left behind, and without it
        out = subprocess.run([sys.executable, "-c", ask], cwd=copy, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(copy)})
        assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], out.stderr
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-m", "pytest", "tests/test_core.py", "-x", "-q", "-p", "no:cacheprovider"], cwd=copy, capture_output=True, text=True, timeout=300, env={**os.environ, "PYTHONPATH": str(copy)})
    assert done.returncode == 0, done.stdout


ONCE = ["tokenize", "token_offsets", "token_measures", "classify_kinds", "context_lengths", "proximity", "dictionary_segmenters", "number_atoms", "bigram_counts", "doc_frequency", "char_maps"]


@pytest.mark.parametrize("name", ONCE)
def test_texts_are_tokenized_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan


def test_long_texts_by_built_in_functions(spark):
    """1 MB texts with characters beyond the basic plane, with and without separators."""
    texts = ["é😀" * 170_000, "é😀 ab, " * 90_000, "x" * 1_000_000, ", " * 500_000, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(5)
    own = core.engine(TokenizerConfig(separators=(" ", ", ")))
    for r in rows.select("id", G.split_custom("text", [" ", ", "]).alias("p")).collect():
        assert r["p"] == (own.split(texts[r["id"]]) if texts[r["id"]] else [])
    found = rows.select("id", G.with_offsets(G.split_separators("text")).alias("o"))
    last = {r["id"]: (r["n"], r["e"], r["b"]) for r in found.select("id", F.size("o").alias("n"), F.element_at("o.char_end", -1).alias("e"), F.element_at("o.byte_end", -1).alias("b")).filter("n > 0").collect()}
    want = core.engine(TokenizerConfig())
    assert last == {i: (len(want.split(t)), len(t), len(t.encode())) for i, t in enumerate(texts) if t}
    assert found.filter("id = 4").select(F.size("o")).first()[0] == 0


def test_own_segmenters_and_normalizers(spark):
    def halves(text: str) -> list[str]:
        return [p for p in (text[: len(text) // 2], text[len(text) // 2 :]) if p]

    def is_greek(lemma: str, script: str, language: str | None) -> bool:
        return script == "Greek"

    t = Tokenizer.builder().segmenter("Greek", None, halves).normalizer("shout", is_greek, lambda c: c.upper()).create_char_map().build()
    row = spark.createDataFrame([("αβγδ abcd",)], "text string").select(t.segment_str("text").alias("s"), t.tokenize("text").alias("t")).first()
    assert row["s"] == ["αβ", "γδ", " ", "abcd"] and [x["lemma"] for x in row["t"]] == ["ΑΒ", "ΓΔ", " ", "abcd"]
    with pytest.raises(ValueError):
        Tokenizer.builder().segmenter("Runes", None, halves)
    assert t.normalize_with("text", "shout", "Greek") is not None
    one = spark.createDataFrame([("ŒUVRE’s",)], "text string").select(Tokenizer().normalize_with("text", "ae_oe", "Latin").alias("a"), Tokenizer().normalize_with("text", "ae_oe", "Greek").alias("b"), Tokenizer().normalize_with("text", "ae_oe", "Greek", gated=False).alias("c")).first()
    assert tuple(one) == ("oeUVRE’s", "ŒUVRE’s", "oeUVRE’s")
    with pytest.raises(ValueError):
        Tokenizer().normalize_with("text", "nothing")


def test_stop_words_and_variants_from_tables(spark):
    words = spark.createDataFrame([("the",), ("the",), (None,), ("of",)], "w string")
    t = Tokenizer.builder().stop_words(words).build()
    assert t.config.stop_words == {"the", "of"}
    kinds = spark.createDataFrame([("the end of it",)], "text string").select(t.tokenize("text").alias("t")).first()["t"]
    assert [x["lemma"] for x in kinds if x["kind"] == "stop_word"] == ["the", "of"]
    rows = spark.createDataFrame([("亚",), ("x",), (None,)], "lemma string")
    got = G.map_variants(rows, spark.createDataFrame([("亚", "亞")], "a string, b string"))
    assert sorted(map(str, (r[0] for r in got.collect()))) == ["None", "x", "亞"]


def test_buffers(spark):
    thai = TokenizerConfig(lexicons=(("thai", ("ไก่", "บน")),))
    assert core.segmenter("thai", thai)("กขคไก่งจบน") == ["ก", "ข", "ค", "ไก่", "ง", "จ", "บน"]
    for n, want in ((None, ["กขค", "ไก่", "งจ", "บน"]), (2, ["กข", "ค", "ไก่", "งจ", "บน"]), (1, ["ก", "ข", "ค", "ไก่", "ง", "จ", "บน"])):
        t = Tokenizer.builder().lexicon("thai", ["ไก่", "บน"]).buffer("thai", n).build()
        assert core.segmenter("thai", t.config)("กขคไก่งจบน") == want
