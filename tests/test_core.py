"""Golden behaviour of the tokenizer, and properties on random texts."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphflow import core, lexicons, tables
from glyphflow.config import TokenizerBuilder, TokenizerConfig


def segments(text: str, **options) -> list[str]:
    return [s for parts, _, _ in core.engine(TokenizerConfig(**options)).segments(text) for s in parts]


def lemmas(text: str, **options) -> list[str]:
    return [n[0] for _, _, _, n in core.engine(TokenizerConfig(**options)).tokens(text)]


LATIN = "The quick (\"brown\") fox can’t jump 32.3 feet, right? Brr, it's 29.3°F! camelCase kebab-case snake_case 123 456"


def test_tables():
    assert len(tables.separator_chars()) == 1049 and len(tables.separator_ranges()) == 197
    assert len(tables.hard_separators()) == 364 and len(tables.LANGUAGES) == 70
    assert tables.script_of("a") == "Latin" and tables.script_of("か") == "Cj" and tables.script_of("1") == "Other" and tables.script_of("Ａ") == "Hangul"
    assert tables.script_from_name("Mandarin") == "Cj" and tables.script_name("Other") == "other" and tables.language_from_code("xxx") is None


def test_latin():
    want = "The| |quick| |(|\"|brown|\"|)| |fox| |can|’|t| |jump| |32|.|3| |feet|, |right|?| |Brr|, |it|'|s| |29|.|3°F|!| |camelCase| |kebab|-|case| |snake|_|case| |123| |456"
    assert segments(LATIN) == want.split("|")
    assert lemmas(LATIN) == want.replace("’", "'").lower().split("|")
    assert segments(LATIN, camel_case=True) == want.replace("camelCase", "camel|Case").split("|")


@pytest.mark.parametrize(
    "text,parts",
    [
        ("a", "a"), ("aB", "a B"), ("camelCase", "camel Case"), ("SCREAMING", "SCREAMING"), ("resuméWriter", "resumé Writer"), ("KarelČapek", "Karel Čapek"),
        ("resuméWriter", "resumé Writer"), ("áB", "á B"), ("openSSL", "open SSL"), ("MongoDBDatabase", "Mongo DB Database"),
    ],
)
def test_camel_case(text, parts):
    assert core.camel_case(text) == parts.split(" ")


@pytest.mark.parametrize(
    "text,parts",
    [
        ("Literaturverwaltungsprogramm", "Literatur verwaltungs programm"), ("Schreibprozess", "Schreib prozess"), ("Interkulturalität", "Inter kulturalität"), ("Wissensorganisation", "Wissens organisation"),
        ("Aufgabenplanung", "Aufgaben planung"), ("Eisbrecher", "Eis brecher"), ("Zuckerei", "Zucker ei"), ("Glatteis", "Glatt eis"), ("Sinnfindung", "Sinn findung"),
        ("Donaudampfschifffahrtsgesellschaftskapitän", "Donau dampf schifffahrts gesellschafts kapitän"), ("Volleyball", "Volley ball"), ("Fußball", "Fuß ball"), ("Beachvolleyball", "Beach volley ball"),
        ("Rindfleischetikettierungsüberwachungsaufgabenübertragungsgesetz", "Rind fleisch etikettierungs überwachungs aufgaben übertragungs gesetz"),
        ("Nahrungsmittelunverträglichkeitsdiagnoseverfahren", "Nahrungs mittel un verträglichkeits diagnose verfahren"), ("Basketball", "Basket ball"), ("Handball", "Hand ball"), ("Spikeball", "Spike ball"),
    ],
)
def test_german_compounds(text, parts):
    assert core.segmenter("german", TokenizerConfig())(text) == parts.split(" ")


def test_segmenters():
    assert segments("السلام عليكم، كيف حالكم؟ ٱلأحوال 123") == "ال|سلام| |عليكم|،| |كيف| |حالكم|؟| |ٱل|أحوال| |123".split("|")
    assert core.segmenter("chinese", TokenizerConfig())("我从2025年开始学习Rust语言。") == "我 从 2025 年 开始 学习 Rust 语言 。".split()
    assert segments("夏天，像是哼着小曲的少年，恶作剧般在大地上") == "夏天 ， 像是 哼 着 小曲 的 少年 ， 恶作剧 般 在 大 地上".split()
    assert lemmas("真正的选举予以表现，颜色") == "眞正 的 選舉 予以 表現 , 顏色".split()
    assert segments("関西国際空港限定トートバッグ すもももももももものうち 123 456") == "関西|国際|空港|限定|トート|バッグ| |すもも|も|もも|も|もも|の|うち| |123| |456".split("|")
    assert lemmas("関西国際空港限定トートバッグ")[-2:] == ["とうと", "ばっぐ"]
    assert segments("한국어의형태해석을실시할수있습니다 123 456.") == "한국어|의|형태|해석|을|실시|할|수|있|습니다| |123| |456|.".split("|")
    assert segments("ภาษาไทยง่ายนิดเดียว ไก่ขันตอนเช้าบนขันน้ำ") == "ภาษาไทย|ง่าย|นิดเดียว| |ไก่|ขัน|ตอนเช้า|บน|ขันน้ำ".split("|")
    assert segments("សួស្តីពិភពលោក 123") == ["សួស្តី", "ពិភពលោក", " ", "123"]
    german = "Der Dampfschifffahrtskapitän fährt über den Mittellandkanal"
    assert lemmas(german, allow_list=("deu",)) == "der| |dampf|schifffahrts|kapitan| |fahr|t| |uber| |den| |mittel|land|kanal".split("|")
    assert segments("123 -123 +123 12.3 -12.3 +12.3", separators=(" ",)) == "123| |-123| |+123| |12.3| |-12.3| |+12.3".split("|")


def test_builder_cases():
    text = "The quick (\"brown\") fox can't jump 32.3 feet, right? Brr, it's 29.3°F!"
    assert segments(text, separators=(" ", ", ", ". ", "?", "!")) == "The| |quick| |(\"brown\")| |fox| |can't| |jump| |32.3| |feet|, |right|?| |Brr|, |it's| |29.3°F|!".split("|")
    assert segments("J. R. R. Tolkien. J. K. Rowling. Dr. Seuss", words_dict=("J. R. R.", "Dr.", "J. K.")) == "J. R. R.| |Tolkien|. |J. K.| |Rowling|. |Dr.| |Seuss".split("|")
    config = TokenizerBuilder().stop_words({"to"}).build().config
    tokens = list(core.engine(config).tokens("Hello world! Pleased to see you."))
    assert tokens[-1][3][0] == "." and [t[0] for t in tokens if t[3][1] == "stop_word"] == ["to"]
    kinds = {n[1] for _, _, _, n in core.engine(TokenizerConfig(separators=())).tokens("a b, c")}
    assert kinds == {"word"} and segments("a b", separators=()) == ["a", " ", "b"]


@pytest.mark.parametrize("lemma,kind", [(" ", ("separator", "soft")), ('"', ("separator", "soft")), ("@", ("separator", "soft")), (".", ("separator", "soft")), (". ", ("separator", "hard")), ("。", ("separator", "hard")), ("S.O.S", ("word", None)), ("ь", ("word", None)), ("=", ("word", None)), (" ", ("word", None))])
def test_classifier(lemma, kind):
    assert core.Normalizer(TokenizerConfig()).classify(lemma) == kind


def normal(text, script, language=None, **options):
    return core.Normalizer(TokenizerConfig(create_char_map=True, **options)).normalize(text, script, language)


def test_normalizers_and_char_maps():
    assert normal("ṩ ṩ", "Latin", lossy=False)[::3] == ("ṩ ṩ", [(3, 5), (1, 1), (3, 5)])
    assert normal("ṩ ṩ", "Latin")[::3] == ("s s", [(3, 1), (1, 1), (3, 1)])
    assert normal("\0生而自由\x02oo\0", "Cj")[::3] == ("生而自由oo", [(1, 0), *[(3, 3)] * 4, (1, 0), (1, 1), (1, 1), (1, 0)])
    assert normal("PascalCase", "Latin")[0] == "pascalcase" and normal("ՀայասՏան", "Armenian")[0] == "հայաստան"
    assert normal("l’l‘l‛", "Latin")[::3] == ("l'l'l'", [(1, 1), (3, 1)] * 3)
    assert [normal(c, "Latin")[0] for c in "œŒæÆ"] == ["oe", "oe", "ae", "ae"]
    assert normal("Αγαπητός", "Greek")[::3] == ("αγαπητοσ", [(2, 2)] * 8)
    assert normal("كیك ۱۲۳", "Arabic", "pes")[0] == "کیک 123" and normal("۱۲۳", "Arabic", "ara")[0] == "۱۲۳"
    assert normal("الحـــمد", "Arabic")[0] == "الحمد" and normal("النهاردة", "Arabic")[0] == "النهارده"
    assert normal("ง่าย", "Thai")[0] == "งาย" and normal("כָּבוֹד", "Hebrew")[0] == "כבוד"
    assert normal("尊嚴", "Cj")[0] == "尊嚴" and normal("澚䀾亚㮺刄杤", "Cj")[0] == "澳䁈亞本刃𣜜"
    assert normal("ダメ駄目だめHi", "Cj")[0] == "だめ駄目だめHi"
    assert normal("öpÅscålcäsÄÖs", "Latin", "swe")[0] == "öpåscålcäsäös"
    assert normal("çalışma", "Latin")[0] == "calisma" and normal("İstanbul", "Latin")[0] == "istanbul"
    assert normal("Ðại Việt", "Latin")[0] == "dai viet"
    assert normal("0÷IÖꞪz", "Latin")[0]
    assert normal("Й", "Cyrillic")[0] == "й"  # marks stay outside of a few scripts


def test_kvariants_have_no_chains():
    to = {a: b for a, _, b in lexicons.KVARIANTS}
    assert all(to.get(b, b) == b for b in to.values())


def test_language_rules():
    plan = lambda text, **o: core.engine(TokenizerConfig(**o)).plan(text)
    assert plan("hello") == ("Latin", None, "latin")
    assert plan("hello", allow_list=("deu",)) == ("Latin", "deu", "german")
    assert plan("漢字", allow_list=("eng",)) == ("Cj", "eng", "latin")
    assert plan("漢字")[1] == "cmn" and plan("漢字かな")[1] == "jpn" and plan("ภาษา")[1] is None
    assert plan("the cat is in the house", allow_list=("deu", "eng"))[1] == "eng"


PIECES = [*"aBé . ,;漢かカ한ทา\u0301\0\x02-_1½Ａ，។ﬁ\u00a0", ". ", "។ល។"]
ALPHABET = st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=60)


@settings(max_examples=150, deadline=None)
@given(ALPHABET)
def test_segments_are_the_text(text):
    assert "".join(segments(text)) == text and len(segments(text)) <= len(text.encode())
    assert "".join(core.engine(TokenizerConfig()).groups(text)) == text


@settings(max_examples=80, deadline=None)
@given(ALPHABET, st.lists(st.text(max_size=3), max_size=4), st.lists(st.text(max_size=4), max_size=3), st.booleans())
def test_any_options(text, separators, words, char_map):
    config = TokenizerConfig(separators=tuple(separators), words_dict=tuple(words), create_char_map=char_map, stop_words=frozenset({" ", "a"}))
    out = list(core.engine(config).tokens(text))
    assert "".join(t[0] for t in out) == text
    listed = tables.separators() if separators is None else set(separators)
    for segment, _, _, (_, kind, _, _) in out:
        lemma = core.Normalizer(TokenizerConfig(lossy=False)).normalize(segment, "Other", None)[0]  # what the classifier sees
        assert kind == ("stop_word" if lemma in {" ", "a"} else "separator" if lemma in listed else "word")


@pytest.mark.parametrize("separators", [(), ("0",), ("|",)])
def test_words_of_one_character(separators):
    """They part a text like longer ones, those that mean something in a pattern too."""
    for word in "|\\.x[":
        cut = core.engine(TokenizerConfig(separators=separators, words_dict=(word,)))
        assert [t[0] for t in cut.tokens(f"a{word}b0c")] == ["a", word, *(["b", "0", "c"] if "0" in separators else ["b0c"])]


def machine_groups(text: str) -> list[str]:
    """Runs of one script by a state machine."""
    out, now = [], "Other"
    for c in text:
        s = tables.script_of(c)
        if out and s != "Other" and now != "Other" and s != now:
            out.append(c)
        elif out:
            out[-1] += c
        else:
            out.append(c)
        now = s if s != "Other" else now
    return out


def test_groups_against_a_state_machine():
    rng = random.Random(3)
    engine = core.engine(TokenizerConfig())
    for _ in range(3000):
        text = "".join(rng.choice("ab1 .漢かア한ทاя，é\n") for _ in range(rng.randint(1, 14)))
        assert engine.groups_of(text) == machine_groups(text)


@pytest.mark.parametrize(
    "text,script,allow,found",
    [
        ("и это не так, что он", "Cyrillic", None, "rus"), ("і це не так, що він є", "Cyrillic", None, "ukr"), ("той се е с това за да", "Cyrillic", None, "bul"), ("ён і яна, гэта ў", "Cyrillic", None, "bel"),
        ("і він", "Cyrillic", ("bul", "ukr"), "ukr"), ("абв", "Cyrillic", ("bul", "ukr"), "ukr"), ("абв", "Cyrillic", ("eng",), None), ("आणि हे आहे ळ", "Devanagari", None, "mar"), ("यह है और", "Devanagari", None, "hin"),
        ("די און איז", "Hebrew", None, "yid"), ("של את על", "Hebrew", None, "heb"), ("پچ", "Arabic", None, "pes"), ("پچ", "Arabic", ("ara", "eng"), "ara"), ("ٹڈ", "Arabic", None, "urd"), ("かな", "Cj", ("cmn",), "cmn"), ("ב", "Hebrew", (), None),
    ],
)
def test_languages_of_shared_scripts(text, script, allow, found):
    assert core.detect_language(text, script, allow) == found


def test_ranges_of_parts():
    for name, inside, outside in (("Persian", "پ۰", "با"), ("Hiragana", "か", "カ"), ("Katakana", "カ", "漢"), ("Mandarin", "漢々", "かカ"), ("Khmer", "ក", "a")):
        assert all(tables.is_in(c, name) for c in inside) and not any(tables.is_in(c, name) for c in outside)
    assert tables.detector_language("zho") == "cmn" and tables.detector_language("eng") == "eng"
