"""Segmenters, normalisers and languages over many texts: one pass, and the results of the plain way."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphflow import core, lexicons
from glyphflow.config import TokenizerConfig
from glyphflow.operators import language_model as lm
from glyphflow.operators import tokenizer as op
from glyphflow.operators.tokenizer import Tokenizer
from glyphflow.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["lexicon_segmenters", "engine_normalizers"])
def test_one_pass(spark, sf_dir, name):
    """one Python worker a task, not one for each column."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1, plan


def test_each_on_its_own_text(spark):
    rows = spark.createDataFrame([("ไก่บน", "fußball"), (None, ""), ("x", None)], "a string, b string")
    t = Tokenizer()
    got = rows.select(t.segment_with_each({"thai": F.col("a"), "german": F.upper("b")}, ["thai", "german"]).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(["ไก่", "บน"], ["FUSSBALL"]), (None, []), (["x"], None)]
    got = rows.select(t.normalize_with_each({"lowercase": F.upper("b"), "quote": F.col("a")}, {"lowercase": ("Latin", None), "quote": ("Latin", None)}).alias("n")).select("n.*").collect()
    assert [tuple(r) for r in got] == [("fussball", "ไก่บน"), ("", None), (None, "x")]


def by_each_place(text: str, words: set[str], buffer: int | None) -> list[str]:
    out: list[str] = []
    at = begin = 0
    while at < len(text):
        n = max((k for k in range(1, len(text) - at + 1) if text[at : at + k] in words), default=0)
        if n:
            out += [text[begin:at]] * (begin < at) + [text[at : at + n]]
            at = begin = at + n
        else:
            at += 1
            if at - begin == buffer:
                out.append(text[begin:at])
                begin = at
    return out + [text[begin:]] * (begin < len(text))


def test_lexicon_walks(monkeypatch):
    """words are sought only where one may begin, with the same result."""
    r = random.Random(1)
    words = ["a", "ab", "abc", "bca", "dd", "", "é😀"]
    trie = core.Trie(words)
    for _ in range(2000):
        text = "".join(r.choices("abcdeé😀\n", k=r.randint(0, 25)))
        for buffer in (None, 1, 2, 5):
            assert core.by_longest_word(text, trie, buffer) == by_each_place(text, {*words} - {""}, buffer)
    asked = []
    monkeypatch.setattr(core.Trie, "longest", lambda self, text, at: asked.append(at) or 0)
    assert core.by_longest_word("no word begins here" * 100, core.Trie(["xyz", "日本"]), 1) == list("no word begins here" * 100) and not asked
    japanese = core.Lattice(lexicons.SEEDS["japanese"].split(" "))
    long = "no noun, " * 1000
    assert japanese(f"{long}すもももももももものうち{long}") == [*long, "すもも", "も", "もも", "も", "もも", "の", "うち", *long]
    for _ in range(1000):
        text = "".join(r.choices("すものうちx関西", k=r.randint(1, 20)))
        assert japanese(text) == japanese._path(text)
    paths = []
    monkeypatch.setattr(core.Lattice, "_path", lambda self, text: paths.append(text) or [text])
    assert japanese(long) == list(long) and not paths


def plainly(n: core.Normalizer, text: str) -> str:
    out = core.recompose_swedish("".join(map(core.nfkd, text)))
    out = "".join(core.PERSIAN.get(c, c) for c in core._CONTROL.sub("", out))
    if not n.config.lossy:
        return out
    out = "".join(core.AE_OE.get(c, c) for c in (core.QUOTES.get(c, c) for c in "".join(map(str.lower, out))))
    out = core._run_to_hiragana("".join(map(n.chinese, out)))
    out = out[:-1] + "σ" if out.endswith("ς") else out
    out = "".join(core.ARABIC.get(c, c) for c in out)
    return "".join(core.TURKISH.get(d, d) for c in out if core.unicodedata.category(c) != "Mn" for d in core.VIETNAMESE.get(c, c))


def test_whole_texts_are_normalized_as_by_character(monkeypatch):
    """F16: only what is beyond ASCII is looked at character by character."""
    r = random.Random(2)
    for config in (TokenizerConfig(), TokenizerConfig(lossy=False), TokenizerConfig(pinyin=(("a", "Bé"),)), TokenizerConfig(kvariants=(("亚", "X"),))):
        n = core.Normalizer(config)
        for _ in range(4000):
            text = "".join(r.choices("aA éÅäΣςカーンァ’œÐıİ\x01\x85ﷲ﷼أـ亚漢Ａ㎏ǅ", k=r.randint(0, 12)))
            assert n.text(text) == plainly(n, text), text
    seen = []
    plain = core.nfkd
    monkeypatch.setattr(core, "nfkd", lambda c: seen.append(c) or plain(c))
    assert core.Normalizer(TokenizerConfig()).text("Plain ASCII é" * 10) == "plain ascii e" * 10 and set(seen) == {"é"}


def test_tokens_are_normalized_once_a_lemma(monkeypatch):
    """and not once a token."""
    engine = core.Engine(TokenizerConfig(create_char_map=True))
    texts = ["The ÉTÉ, the été. "] * 500 + [None, "", "Привет The"]
    raw, asked = op._tokens(engine, texts, normalized=False), []
    plain = core.Engine.facts
    monkeypatch.setattr(core.Engine, "facts", lambda self, parts, *key: asked.extend(parts) or plain(self, parts, *key))
    got = op._normalized(engine, raw)
    assert len(asked) <= 10 and len(got) == len(texts)
    monkeypatch.undo()
    assert got.to_pylist() == op._tokens(engine, texts).to_pylist()
    assert op._normalized(engine, raw.slice(499, 3)).to_pylist() == got.slice(499, 3).to_pylist()


def counted_plainly(text: str) -> Counter:
    letters = "".join([c if c.isalpha() else " " for c in text.lower()]).split()
    padded = f" {' '.join(letters)} "
    return Counter(padded[i : i + 3] for i in range(len(padded) - 2)) if letters else Counter()


def test_trigrams_as_arrays(spark):
    """the same trigrams, ranks and languages; what leaves a worker does not grow with copies of a text."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcßé ñ.1İΣςА漢😀  𐐀٣²", k=r.randint(0, 30))) for _ in range(3000)]
    profiles = {k: {g: i for i, (g, _) in enumerate(sorted(counted_plainly(" ".join(texts[a : a + 9])).items(), key=lambda x: (-x[1], x[0]))[: lm.TOP])} for k, a in (("deu", 0), ("eng", 9), ("fra", 18))}
    model = lm.LanguageModel(profiles)
    for t in texts:
        assert lm.trigrams(t) == counted_plainly(t)
        ranked = [g for g, _ in sorted(counted_plainly(t).items(), key=lambda x: (-x[1], x[0]))]
        scores = {k: sum(min(lm.TOP, abs(p[g] - i)) if g in p else lm.TOP for i, g in enumerate(ranked)) for k, p in profiles.items()}
        assert model.detect(t) == (min(scores, key=lambda k: (scores[k], k)) if ranked else None)
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * 5000, "t": ["to be or not to be"] * 5000})
    out = list(lm._counted(iter([batch, batch])))
    assert sum(b.num_rows for b in out) == len(counted_plainly("to be or not to be")) and sum(sum(b.column(2).to_pylist()) for b in out) == 10_000 * counted_plainly("to be or not to be").total()


def test_another_model_in_the_same_worker(spark):
    """a worker that is used again takes the model of its own query."""
    rows = spark.createDataFrame([("abc abc",)], "text string").coalesce(1)
    for told in ("deu", "eng"):
        other = {"deu": "eng", "eng": "deu"}[told]
        model = lm.LanguageModel({told: {" ab": 0, "abc": 1, "bc ": 2}, other: {"xyz": 0}})
        t = Tokenizer(TokenizerConfig(allow_list=("deu", "eng"), language_model=model))
        assert rows.select(t.detect("text")["language"]).first()[0] == told


def test_quick_classes_are_the_patterns(spark):
    """classes with common characters first match what those of the tables match, every character among others."""
    from glyphflow import functions as G
    from glyphflow import tables

    r = random.Random(6)
    points = [c for lo, hi in (*tables.separator_ranges(), *(x for s in tables.SCRIPT_RANGES for x in tables.exclusive_ranges(s))) for c in (lo - 1, lo, hi, hi + 1)]
    points = [c for c in {*points, *range(0x400)} if 0 <= c < 0x110000 and not 0xD800 <= c < 0xE000]
    texts = ["a" + chr(c) + "é" + chr(c) + ". " for c in points] + ["".join(chr(r.choice(points)) for _ in range(20)) for _ in range(500)] + ["", " ", ".", ". ", "។ល។", "a។ល។ b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    for r_ in rows.select("text", G.script_groups("text").alias("g"), G.split_separators("text").alias("p"), G.segment_native("text").alias("s")).collect():
        engine = core.engine(TokenizerConfig())
        groups = engine.groups_of(r_["text"])
        assert r_["g"] == groups and r_["p"] == engine.default_split(r_["text"]), r_["text"]
        assert r_["s"] == [p for g in engine.groups(r_["text"]) for p in engine.default_split(g)], r_["text"]
    for pattern in (G.columns._group_pattern(), G.columns._split_pattern()):
        assert "&&" in pattern  # far characters are looked at last


def test_running_sums(spark):
    """no array is copied once a value."""
    from glyphflow.functions import columns

    r = random.Random(7)
    lists = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 63, 64, 65, 1000)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<bigint>")
    for levels in (0, 1, 2, columns.LEVELS):
        got = {x["i"]: x["s"] for x in rows.select("i", columns._running_sums(F.col("v"), levels).alias("s")).collect()}
        assert got == {i: [sum(v[: k + 1]) for k in range(len(v))] for i, v in enumerate(lists)}


@pytest.mark.parametrize("name", ["stop_words_join", "classify_native"])
def test_segments_are_told_apart_once(spark, sf_dir, name):
    """segments are counted before they are classified and joined."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [role") == 2, plan
