"""Texts tokenized a piece at a time: the same tokens as one by one, in bounded memory, and counts summed before they leave the worker."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphflow import core
from glyphflow.config import TokenizerConfig
from glyphflow.operators import analytics
from glyphflow.operators import tokenizer as op
from glyphflow.operators.tokenizer import Tokenizer
from glyphflow.plans.queries import QUERIES

POOL = ["The", "of", "ÉTÉ", "ß", "über", "a.b", ". ", ", ", ".", " ", " ", "\n", "\0", "’", "œ", "😀", "1½", "Привет", "漢字", "か", "Հայ", "ﬁn", "x" * 70, "السلام", "é", "\x01"]
CONFIGS = [
    TokenizerConfig(),
    TokenizerConfig(create_char_map=True, stop_words=frozenset({"of"})),
    TokenizerConfig(lossy=False),
    TokenizerConfig(stop_words=frozenset({"The", "über", "a.b"})),
    TokenizerConfig(allow_list=("deu",)),
    TokenizerConfig(allow_list=("eng", "deu", "cmn")),
    TokenizerConfig(camel_case=True),
    TokenizerConfig(separators=(" ", "of")),
    TokenizerConfig(words_dict=("The", "a.b")),
]


def some_texts(n: int, seed: int = 1) -> list[str | None]:
    r = random.Random(seed)
    latin = POOL[:17]
    return [None if r.random() < 0.05 else "".join(r.choices(POOL if r.random() < 0.3 else latin, k=r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("config", CONFIGS)
def test_pieces_are_the_semantics(config):
    engine, texts = core.Engine(config), some_texts(400)
    got, segments, lemmas, contexts = (op._tokens(engine, texts, original=True).to_pylist(), *(f(engine, texts).to_pylist() for f in (op._strings, op._lemmas, op._contexts)))
    sizes = op._context_sizes(engine, texts).to_pylist()
    counts = op._lemma_counts(engine, texts).to_pylist()
    for k, t in enumerate(texts):
        if t is None:
            assert got[k] is segments[k] is lemmas[k] is contexts[k] is sizes[k] is counts[k] is None
            continue
        want = [(p, script, language, *engine.normalizer.normalize(p, script, language)) for parts, script, language in engine.segments(t) for p in parts]
        tokens = [(x["original"], y["script"], y["language"], y["lemma"], y["kind"], y["separator_kind"], y["char_map"] and [(m["orig"], m["norm"]) for m in y["char_map"]]) for x in got[k] for y in [x["token"]]]
        assert tokens == [(*w[:6], w[6] and [(a, b) for a, b in w[6]]) for w in want]
        assert segments[k] == [w[0] for w in want]
        for x in got[k]:
            y = x["token"]
            assert x["original"] == t[y["char_start"] : y["char_end"]] == t.encode()[y["byte_start"] : y["byte_end"]].decode()
        listed: list[list[str]] = [[]]
        for w in want:
            if w[4] == "word":
                listed[-1].append(w[3])
            elif w[5] == "hard":
                listed.append([])
        assert contexts[k] == listed and sizes[k] == [len(c) for c in listed]
        assert lemmas[k] == [x for c in listed for x in c] and {x["lemma"]: x["n"] for x in counts[k]} == Counter(lemmas[k])


def test_fields_are_those_of_the_token():
    engine, texts = core.Engine(TokenizerConfig()), some_texts(50)
    whole = op._tokens(engine, texts).to_pylist()
    for fields in (("lemma",), ("byte_end", "kind"), ("script", "language", "char_map")):
        part = op._tokens(engine, texts, fields=fields).to_pylist()
        assert part == [t and [{f: x[f] for f in fields} for x in t] for t in whole]


def test_a_batch_is_read_a_piece_at_a_time():
    """not all texts of a batch are Python strings at once."""
    batch = pa.array(["é" * 300_000, None, "", *["x" * 200_000] * 20])
    pieces = list(op._pieces(batch))
    assert [t for p in pieces for t in p] == batch.to_pylist() and len(pieces) >= 4
    assert list(op._pieces(pa.array([], pa.string()))) == [[]]


def brute(rows: list[str | None], within: int, n: int) -> tuple[Counter, Counter, Counter]:
    near: Counter = Counter()
    grams: Counter = Counter()
    df: Counter = Counter()
    engine = core.Engine(TokenizerConfig())
    for t in rows:
        if t is None:
            continue
        (contexts,) = op._contexts(engine, [t]).to_pylist()
        for c in contexts:
            near.update((a, b) for i, a in enumerate(c) for b in c[i + 1 : i + 1 + within])
        words = [w for c in contexts for w in c]
        grams.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        df.update(set(words))
    return near, grams, df


@pytest.mark.parametrize("span", [7, op.SPAN])
def test_counts_over_spans(spark, span):
    """the same counts whatever the span."""
    rows = some_texts(300, 2)
    texts = spark.createDataFrame([(t,) for t in rows], "text string").repartition(3)
    t = Tokenizer()
    near, grams, df = brute(rows, 3, 3)
    for f, want in ((op._near(3), near), (op._grams(3), grams), (op._in_texts, df)):
        got: Counter = Counter()
        column = t._summed(f, "text", " " if want is grams else None, want is near, span)
        for r in texts.select(F.inline(column)).collect():
            size, _, key = r["key"].partition(":") if want is near else ("0", "", r["key"])
            got[(key[: int(size)], key[int(size) :]) if want is near else key] += r["n"]
        assert got == want
    assert {(r["first"], r["second"]): r["n"] for r in analytics.proximity(texts, 3).collect()} == near
    assert {r["gram"]: r["n"] for r in analytics.ngram_counts(texts, 3).collect()} == grams
    assert {r["lemma"]: r["df"] for r in analytics.document_frequency(texts).collect()} == df


def test_repeated_texts_leave_the_worker_once(spark):
    """rows that leave a worker do not grow with copies of a text."""
    texts = spark.createDataFrame([("to be or not to be",)] * 3000, "text string").coalesce(1)
    for column in (Tokenizer().near_counts("text", 2), Tokenizer().gram_counts("text", 2)):
        assert texts.select(F.inline(column)).count() < 20
    assert not [p for p in analytics.proximity(texts, 2)._jdf.queryExecution().optimizedPlan().toString().split() if p.startswith("transform(")]


@pytest.mark.parametrize("name", ["token_offsets", "token_measures", "tokenize", "classify_kinds"])
def test_only_named_fields_leave_the_worker(spark, sf_dir, name):
    """tokens have the fields that the query reads, and no function is interpreted token by token."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "script" not in plan and "char_map" not in plan


def test_contexts_leave_as_sizes(spark, sf_dir):
    """for lengths of contexts no lemma leaves the worker."""
    plan = QUERIES["context_lengths"](spark, sf_dir)._jdf.queryExecution().analyzed()
    kinds = [u.dataType().simpleString() for u in _python_functions(plan)]
    assert kinds == ["array<int>"]


def _python_functions(plan) -> list:
    found = []
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        expressions = node.expressions() if hasattr(node, "expressions") else None
        todo = [expressions.apply(i) for i in range(expressions.size())] if expressions is not None else []
        while todo:
            e = todo.pop()
            if "PythonUDF" in e.getClass().getSimpleName():
                found.append(e)
            below = e.children()
            todo += [below.apply(i) for i in range(below.size())]
    return found


def test_steps_by_character():
    """A look at each character gives what the steps give with their gates."""
    r = random.Random(3)
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c <= 0xDFFF] + list("ﬁﬀ㎏ẞ😀𝐀")
    for script, language in (("Latin", None), ("Other", None), ("Cyrillic", "rus"), ("Arabic", "pes"), ("Cj", "cmn")):
        n = core.Normalizer(TokenizerConfig(stop_words=frozenset({"a"})))
        one = n.by_character(script, language)
        for s in chars + ["".join(r.choices(chars[:0x250], k=5)) for _ in range(2000)]:
            assert one(s) in (None, n.normalize(s, script, language))
    assert core.Normalizer(TokenizerConfig()).by_character("Greek", None) is None
    assert core.Normalizer(TokenizerConfig(create_char_map=True)).by_character("Latin", None) is None
