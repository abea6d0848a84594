"""One query per operator (or family of small ones) over whole tables, and the same in DuckDB SQL.

Long token lists are compared by a digest: pieces joined by U+001F.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import core, lexicons, sql, tables
from .. import functions as G
from ..config import TokenizerConfig
from ..operators import analytics, language_model
from ..operators.tokenizer import Tokenizer
from ..streaming import run_to_table, shared_path, term_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than cores (a small file of one row group) is dealt out to all of them."""
    table, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text that isn't empty: those that have tokens."""
    return _table(spark, sf_dir, "documents").filter(F.char_length("text") > 0)


def _digest(pieces: Column) -> Column:
    return F.sha2(F.array_join(pieces, "\x1f"), 256)


def _q(text: str) -> str:
    return text.replace("'", "''")


#: SQL: segments of a text without characters of another script than Latin.
SPLIT = _q(tables.split_pattern())
_CLASS = tables.char_class(tables.separator_ranges())
_HARD_CLASS = tables.char_class(tables.HARD_RANGES)


def _is_separator(c: str) -> str:
    return f"regexp_full_match({c}, '\\. |, |[{_q(_CLASS)}]')"


def _is_hard(c: str) -> str:
    return f"regexp_full_match({c}, '\\. |, |[{_q(_HARD_CLASS)}]')"


def _lemma_sql(c: str) -> str:
    """Lossy normalisation of Latin text."""
    out = f"lower({c})"
    for a, b in (("’", "''"), ("‘", "''"), ("‛", "''"), ("œ", "oe"), ("æ", "ae")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"translate(strip_accents({out}), 'đðı', 'ddi')"


_DOC_TOKENS = f"""
d AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{SPLIT}') AS parts FROM documents),
seg AS (SELECT doc_id, lang, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS p FROM d),
tok AS (SELECT *, {_lemma_sql("p")} AS lemma, CASE WHEN {_is_separator("p")} THEN 'separator' ELSE 'word' END AS kind, CASE WHEN {_is_separator("p")} THEN CASE WHEN {_is_hard("p")} THEN 'hard' ELSE 'soft' END END AS separator_kind FROM seg)"""


# -- segmentation


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_segments, sha256(array_to_string(p, chr(31))) AS segments_sha256 FROM (SELECT doc_id, regexp_extract_all(text, '{SPLIT}') AS p FROM documents)")
def segment_str(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", Tokenizer().segment_str("text").alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_segments"), _digest(F.col("p")).alias("segments_sha256"))


@query(f"SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n_segments, sha256(array_to_string(p, chr(31))) AS segments_sha256 FROM (SELECT conv_id, turn, regexp_extract_all(text, '{SPLIT}') AS p FROM conversations)")
def segment_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", G.segment_native("text").alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("n_segments"), _digest(F.col("p")).alias("segments_sha256"))


MIXED = "Привет, мир! 漢字とかな、한국어 العربية ภาษา 123 ＡＢ"


@query(f"SELECT doc_id, CAST(len(g) AS BIGINT) AS n_groups, sha256(array_to_string(g, chr(31))) AS groups_sha256 FROM (SELECT doc_id, regexp_extract_all(text || ' {MIXED} ' || lang, '{_q(tables.group_pattern())}') AS g FROM documents)")
def script_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is made one of several scripts by a fixed ending."""
    text = F.concat("text", F.lit(f" {MIXED} "), "lang")
    rows = _table(spark, sf_dir, "documents").select("doc_id", G.script_groups(text).alias("g"))
    return rows.select("doc_id", F.size("g").cast("long").alias("n_groups"), _digest(F.col("g")).alias("groups_sha256"))


_SCRIPTS = list(tables.SCRIPT_RANGES)


def _majority_sql(text: str, name: str) -> str:
    counts = ", ".join(f"len(regexp_replace({text}, '[^{tables.char_class(tables.exclusive_ranges(s))}]', '', 'g'))" for s in _SCRIPTS)
    return f"list_max(list_transform([{counts}], lambda n, i: {{'n': n, 'k': -i}})) AS {name}"


def _script_sql(best: str) -> str:
    return f"CASE WHEN {best}.n = 0 THEN 'Other' ELSE ([{', '.join(f"'{s}'" for s in _SCRIPTS)}])[-{best}.k] END"


_CYRILLIC = "repeat('ж', {0}(text) + 1) || text"


@query(f"SELECT doc_id, {_script_sql('a')} AS script, {_script_sql('b')} AS with_cyrillic FROM (SELECT doc_id, {_majority_sql('text', 'a')}, {_majority_sql('(' + _CYRILLIC.format('len') + ')', 'b')} FROM documents)")
def script_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of every document's own text, and of it with as many letters of another script and one more."""
    columns = {"script": F.col("text"), "with_cyrillic": F.expr(_CYRILLIC.format("char_length"))}
    return _table(spark, sf_dir, "documents").select("doc_id", *(G.detect_script(c).alias(n) for n, c in columns.items()))


def _marked(words: str) -> str:
    """SQL: matches and gaps by marks set around the matches."""
    return f"[x for x in string_split(regexp_replace(text, '({words})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) if x <> '']"


OWN_SEPARATORS = (" ", ", ", ". ", "?", "!")


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_segments, sha256(array_to_string(p, chr(31))) AS segments_sha256 FROM (SELECT doc_id, {_marked(', |\\. | |\\?|!')} AS p FROM documents)")
def custom_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tokenizer.builder().separators(OWN_SEPARATORS).build()
    rows = _table(spark, sf_dir, "documents").select("doc_id", t.segment_str("text").alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_segments"), _digest(F.col("p")).alias("segments_sha256"))


@query(f"SELECT doc_id, sha256(array_to_string({_marked(', |\\. | |\\?|!')}, chr(31))) AS segments_sha256 FROM documents")
def custom_separators_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", _digest(G.split_custom("text", OWN_SEPARATORS)).alias("segments_sha256"))


@query(f"SELECT doc_id, CAST(len(p) AS BIGINT) AS n_segments, sha256(array_to_string(p, chr(31))) AS segments_sha256 FROM (SELECT doc_id, {_marked(f'of the|in the|\\. |, |[{_q(_CLASS)}]')} AS p FROM documents)")
def words_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tokenizer.builder().words_dict(["of the", "in the"]).build()
    rows = _table(spark, sf_dir, "documents").select("doc_id", t.segment_str("text").alias("p"))
    return rows.select("doc_id", F.size("p").cast("long").alias("n_segments"), _digest(F.col("p")).alias("segments_sha256"))


@query(f"""WITH {_DOC_TOKENS} SELECT doc_id, CAST(count(*) FILTER (regexp_full_match(p, '[\\p{{N}}!-/:-@\\[-`{{-~]+')) AS BIGINT) AS n_numbers FROM tok GROUP BY doc_id""")
def number_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Tokenizer().segment_str("text")
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.explode(parts).alias("p"))
    return rows.groupBy("doc_id").agg(F.count_if(G.maybe_number("p")).alias("n_numbers"))


_GLUED = "replace(text, ' ', '')"


@query(
    f"SELECT conv_id, turn, sha256(array_to_string(string_split(regexp_replace(regexp_replace(t, '(\\p{{Ll}})(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), '([^\\x01])(\\p{{Lu}}\\p{{Ll}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), chr(31))) AS parts_sha256"
    f" FROM (SELECT conv_id, turn, {_GLUED} || 'openSSLMongoDBDatabase' AS t FROM conversations)"
)
def camel_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.replace(F.col("text"), F.lit(" "), F.lit("")), F.lit("openSSLMongoDBDatabase"))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", _digest(G.split_camel_case(text)).alias("parts_sha256"))


ARABIC_WORDS = ("السلام", "ال", "أن", "ٱلأحوال", "كيف", "آلاف", "إلى", "الا")


@query(
    f"SELECT conv_id, turn, sha256(string_agg(CASE WHEN strlen(w) > 4 AND regexp_matches(w, '^[اأإآٱ]ل') THEN substr(w, 1, 2) || '|' || substr(w, 3) ELSE w END, chr(31) ORDER BY i)) AS parts_sha256 FROM "
    f"(SELECT conv_id, turn, i, x || text AS w FROM conversations, (SELECT unnest([{', '.join(f"'{w}'" for w in ARABIC_WORDS)}]) AS x, unnest(range({len(ARABIC_WORDS)})) AS i)) GROUP BY conv_id, turn"
)
def arabic_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word set before the text of every turn."""
    parts = [F.array_join(G.split_arabic_article(F.concat(F.lit(w), "text")), "|") for w in ARABIC_WORDS]
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(F.array_join(F.array(*parts), "\x1f"), 256).alias("parts_sha256"))


SAMPLES = {"thai": "ภาษาไทยง่ายนิดเดียว", "khmer": "សួស្តីពិភពលោក", "german": "Donaudampfschifffahrtsgesellschaftskapitän", "chinese": "我从2025年开始学习Rust语言。", "japanese": "関西国際空港限定トートバッグ", "korean": "한국어의형태해석을"}


@query()
def dictionary_segmenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmenters that walk a lexicon, each on all samples and the text of every turn."""
    text = F.concat(F.lit("".join(SAMPLES.values())), "text")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", Tokenizer().segment_with_each(text, SAMPLES).alias("s"))
    return rows.select("conv_id", "turn", *(_digest(F.col(f"s.{name}")).alias(name) for name in SAMPLES))


def _lexicon_sql(name: str, buffer: bool) -> str:
    """The longest word at each place; characters between words one by one, or all together."""
    words = "|".join(sorted(lexicons.SEEDS[name].split(), key=len, reverse=True))
    x = f"('{SAMPLES[name]}' || text || '{SAMPLES[name]}')"
    if buffer:
        return f"[x FOR x IN string_split(regexp_replace({x}, '({words})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) IF x <> '']"
    return f"regexp_extract_all({x}, '(?s){words}|.')"


_BY_LEXICON = {"thai": False, "khmer": False, "korean": False, "german": True}


@query("SELECT conv_id, turn, " + ", ".join(f"sha256(array_to_string({_lexicon_sql(name, buffer)}, chr(31))) AS {name}" for name, buffer in _BY_LEXICON.items()) + " FROM conversations")
def lexicon_segmenters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of a lexicon at each place, on every turn between two samples."""
    t, rows = Tokenizer(), _table(spark, sf_dir, "conversations")
    texts = {name: F.concat(F.lit(SAMPLES[name]), "text", F.lit(SAMPLES[name])) for name in _BY_LEXICON}
    rows = rows.select("conv_id", "turn", t.segment_with_each(texts, _BY_LEXICON).alias("s"))
    return rows.select("conv_id", "turn", *(_digest(F.col(f"s.{name}")).alias(name) for name in _BY_LEXICON))


_ALLOWED = {"japanese": ("jpn",), "chinese": ("cmn",), "detected": ("eng", "cmn"), "free": None}


@query("SELECT conv_id, turn, " + ", ".join(f"sha256({_lemma_sql('text')} || ' {end}') AS {name}" for name, end in (("japanese", "かな亚"), ("chinese", "カナ亞"), ("detected", "カナ亞"), ("free", "かな亚"))) + " FROM conversations")
def allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages allowed decide on the segmenter and the normalisers of an ending in kana and a variant character."""
    text, rows = F.concat("text", F.lit(" カナ亚")), _table(spark, sf_dir, "conversations")
    lemmas = {name: Tokenizer().tokenize(text, allow) if allow else Tokenizer().tokenize(text) for name, allow in _ALLOWED.items()}
    return rows.select("conv_id", "turn", *(F.sha2(F.array_join(F.transform(t, lambda x: x["lemma"]), ""), 256).alias(name) for name, t in lemmas.items()))


# -- tokens


@query(
    f"""WITH {_DOC_TOKENS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(count(*) FILTER (kind = 'word') AS BIGINT) AS n_words, CAST(count(*) FILTER (separator_kind = 'hard') AS BIGINT) AS n_hard,
    CAST(count(*) FILTER (separator_kind = 'soft') AS BIGINT) AS n_soft, sha256(string_agg(lemma, chr(31) ORDER BY pos)) AS lemmas_sha256 FROM tok GROUP BY doc_id"""
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the filter is on the text: one on the tokens would be moved below the function, and the function run twice
    rows = _texts(spark, sf_dir).select("doc_id", Tokenizer().tokenize("text", fields=("kind", "separator_kind", "lemma")).alias("t"))
    count = lambda values, x: (F.size("t") - F.size(F.array_remove(values, x))).cast("long")
    return rows.select(
        "doc_id",
        F.size("t").cast("long").alias("n_tokens"),
        count("t.kind", "word").alias("n_words"),
        count("t.separator_kind", "hard").alias("n_hard"),
        count("t.separator_kind", "soft").alias("n_soft"),
        _digest(F.col("t.lemma")).alias("lemmas_sha256"),
    )


_OFFSETS = "sum(len(p)) OVER w AS ce, sum(strlen(p)) OVER w AS be"


@query(f"""WITH {_DOC_TOKENS}, o AS (SELECT doc_id, p, {_OFFSETS} FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(sum(ce - len(p)) AS BIGINT) AS char_starts, CAST(sum(ce) AS BIGINT) AS char_ends, CAST(sum(be - strlen(p)) AS BIGINT) AS byte_starts, CAST(sum(be) AS BIGINT) AS byte_ends FROM o GROUP BY doc_id""")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("char_start", "char_end", "byte_start", "byte_end")
    rows = _texts(spark, sf_dir).select("doc_id", F.inline(Tokenizer().segment("text", fields)))
    return rows.groupBy("doc_id").agg(*(F.sum(f).alias(f"{f}s") for f in fields))


@query(f"""WITH {_DOC_TOKENS}, o AS (SELECT doc_id, pos, p, {_OFFSETS} FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, sha256(string_agg(p || ':' || (ce - len(p)) || ':' || ce || ':' || (be - strlen(p)) || ':' || be, chr(31) ORDER BY pos)) AS offsets_sha256 FROM o GROUP BY doc_id""")
def offsets_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets by built-in functions alone."""
    rows = _texts(spark, sf_dir).select("doc_id", G.with_offsets(G.segment_native("text")).alias("o"))
    told = F.transform("o", lambda x: F.concat_ws(":", x["segment"], x["char_start"], x["char_end"], x["byte_start"], x["byte_end"]))
    return rows.select("doc_id", F.size("o").cast("long").alias("n"), _digest(told).alias("offsets_sha256"))


@query("SELECT doc_id, true AS same FROM documents")
def reconstruct_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The originals of all tokens, in order, are the text."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text", Tokenizer().reconstruct("text", ("char_end",)).alias("r"))
    return rows.select("doc_id", (F.array_join("r.original", "") == F.col("text")).alias("same"))


@query(f"WITH {_DOC_TOKENS} SELECT lang, kind, coalesce(separator_kind, '') AS separator_kind, CAST(count(*) AS BIGINT) AS n FROM tok GROUP BY ALL")
def classify_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = Tokenizer().explode(_table(spark, sf_dir, "documents").select("lang", "text"), fields=("kind", "separator_kind"))
    return tokens.groupBy("lang", "kind", F.coalesce("separator_kind", F.lit("")).alias("separator_kind")).agg(F.count("*").alias("n"))


_CONV = f"s AS (SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '{SPLIT}')) AS p FROM conversations)"
_KIND = f"CASE WHEN {_is_separator('p')} THEN 'separator' ELSE 'word' END"


@query(f"WITH {_CONV} SELECT role, CASE WHEN p IN ('the', 'of', ' ') THEN 'stop_word' ELSE {_KIND} END AS kind, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL")
def classify_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words come before separators; the comparison looks at case."""
    rows = _table(spark, sf_dir, "conversations").select("role", F.explode(G.segment_native("text")).alias("p"))
    kind = G.classify("p", stop_words=["the", "of", " "])["kind"]
    return rows.groupBy("role", "p").count().groupBy("role", kind.alias("kind")).agg(F.sum("count").alias("n"))


_STOPS = "(SELECT DISTINCT lower(r_name) AS w FROM region UNION SELECT 'the' UNION SELECT 'of' UNION SELECT 'and')"


@query(f"WITH {_CONV} SELECT role, CASE WHEN w IS NOT NULL THEN 'stop_word' ELSE {_KIND} END AS kind, CAST(count(*) AS BIGINT) AS n FROM s LEFT JOIN {_STOPS} ON p = w GROUP BY ALL")
def stop_words_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words from a table."""
    more = spark.createDataFrame([("the",), ("of",), ("and",)], "w string")
    stops = _table(spark, sf_dir, "region").select(F.lower("r_name").alias("w")).union(more)
    rows = _table(spark, sf_dir, "conversations").select("role", F.explode(G.segment_native("text")).alias("lemma"))
    # what is the same for a segment wherever it stands is asked once
    rows = rows.groupBy("role", "lemma").count().withColumn("kind", G.classify("lemma")["kind"])
    return G.mark_stop_words(rows, stops).groupBy("role", "kind").agg(F.sum("count").alias("n"))


@query(
    f"""WITH {_DOC_TOKENS}, k AS (SELECT doc_id, pos, p, CASE WHEN p IN (SELECT w FROM {_STOPS}) THEN 'stop_word' ELSE kind END AS kind FROM tok)
    SELECT doc_id, CAST(count(*) FILTER (kind = 'stop_word') AS BIGINT) AS n_stop, CAST(count(*) FILTER (kind = 'word') AS BIGINT) AS n_words, sha256(string_agg(strip_accents(p), chr(31) ORDER BY pos)) AS lemmas_sha256 FROM k GROUP BY doc_id"""
)
def builder_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop words of a table given to the builder, and no lossy step: letters keep their case, and marks (left out of the digest)."""
    stops = _table(spark, sf_dir, "region").select(F.lower("r_name").alias("w")).union(spark.createDataFrame([("the",), ("of",), ("and",)], "w string"))
    t = Tokenizer.builder().stop_words(stops).lossy_normalization(False).build()
    rows = _texts(spark, sf_dir).select("doc_id", t.tokenize("text").alias("t"))
    many = lambda kind: F.size(F.filter("t", lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", many("stop_word").alias("n_stop"), many("word").alias("n_words"), _digest(F.transform("t", lambda x: G.strip_marks(x["lemma"]))).alias("lemmas_sha256"))


@query(f"""WITH {_DOC_TOKENS} SELECT doc_id, CAST(sum(strlen(lemma)) AS BIGINT) AS byte_len, CAST(sum(strlen(p)) AS BIGINT) AS original_byte_len, CAST(sum(len(lemma)) AS BIGINT) AS char_count, CAST(sum(len(p)) AS BIGINT) AS original_char_count FROM tok GROUP BY doc_id""")
def token_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("lemma", "char_start", "char_end", "byte_start", "byte_end")
    rows = _texts(spark, sf_dir).select("doc_id", F.explode(Tokenizer().tokenize("text", fields=fields)).alias("t"))
    return rows.groupBy("doc_id").agg(*(F.sum(f(F.col("t"))).alias(f.__name__) for f in (G.byte_len, G.original_byte_len, G.char_count, G.original_char_count)))


_COVERED = "sum(n) OVER (PARTITION BY conv_id, turn, t ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    f"""WITH s AS (SELECT conv_id, turn, generate_subscripts(p, 1) AS t, unnest(p) AS p FROM (SELECT conv_id, turn, regexp_extract_all(text, '{SPLIT}') AS p FROM conversations)),
    c AS (SELECT conv_id, turn, t, generate_subscripts(cs, 1) AS i, unnest(cs) AS c FROM (SELECT *, regexp_extract_all(p, '(?s).') AS cs FROM s)),
    n AS (SELECT *, strlen({_lemma_sql("c")}) AS n FROM c),
    k AS (SELECT *, coalesce({_COVERED}, 0) < 3 AS used FROM n),
    a AS (SELECT conv_id, turn, count(*) FILTER (used) AS chars, sum(strlen(c)) FILTER (used) AS bytes FROM k GROUP BY conv_id, turn)
    SELECT s.conv_id, s.turn, CAST(sum(strlen(p)) FILTER ({_lemma_sql("p")} <> p) AS BIGINT) AS bytes_mapped, CAST(any_value(chars) AS BIGINT) AS chars_covered, CAST(any_value(bytes) AS BIGINT) AS bytes_covered
    FROM s JOIN a ON s.conv_id = a.conv_id AND s.turn = a.turn GROUP BY s.conv_id, s.turn"""
)
def char_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes mapped, and how much of the original the first three bytes of each lemma cover."""
    t = Tokenizer.builder().create_char_map().build()
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(t.tokenize("text")).alias("t"))
    covered = G.original_lengths(F.col("t"), 3)
    mapped = F.aggregate("t.char_map", F.lit(0), lambda a, x: a + x["orig"].cast("int"))
    return rows.groupBy("conv_id", "turn").agg(F.sum(mapped).alias("bytes_mapped"), F.sum(covered["chars"]).alias("chars_covered"), F.sum(covered["bytes"]).alias("bytes_covered"))


@query(f"SELECT doc_id, sha256(translate({_lemma_sql("translate(lower(text), 'åäö', chr(1) || chr(2) || chr(3))")}, chr(1) || chr(2) || chr(3), 'åäö')) AS text_sha256 FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No gate is asked, so the Swedish letters are put together again and keep their marks."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(Tokenizer().normalize_text("text"), 256).alias("text_sha256"))


@query("SELECT conv_id, turn, true AS same FROM conversations")
def normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """segment() and then normalize_tokens() give what tokenize() gives."""
    t = Tokenizer()
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", t.normalize_tokens(t.segment("text")).alias("a"), t.tokenize("text").alias("b"))
    return rows.select("conv_id", "turn", (F.col("a") == F.col("b")).alias("same"))


# -- normalisers that are tables: each on every turn with an ending that holds what it changes

_TABLES: dict[str, tuple[Callable[[Column], Column], str, str]] = {
    "lower_chars": (G.lower_chars, "ΑΓΑΠΗΤΟΣ ΣΑΣ ПРИВЕТ", "lower(translate({0}, 'Σ', 'σ'))"),
    "quote_norm": (G.normalize_quotes, "l’l‘l‛", "translate({0}, '’‘‛', '''''''')"),
    "ae_oe": (G.normalize_ae_oe, "œŒæÆ", "replace(replace(replace(replace({0}, 'œ', 'oe'), 'Œ', 'oe'), 'æ', 'ae'), 'Æ', 'ae')"),
    "vietnamese_d": (G.normalize_vietnamese, "Ðại Đại đại ðại", "translate({0}, 'ÐĐđð', 'dddd')"),
    "turkish_i": (G.normalize_turkish, "ışık ısı", "translate({0}, 'ı', 'i')"),
    "arabic_letters": (G.normalize_arabic, "ٱلْحَمْدُ النهاردة يومى الحـــمد", "translate({0}, 'أإآٱىةـ', 'اااايه')"),
    "persian_letters": (G.normalize_persian, "علي كيك ۱۲۳۴ می‌خواهم، چرا؟ ﷼", "replace(translate({0}, 'يیىۀكک۰۱۲۳۴۵۶۷۸۹،؟' || chr(8204), 'ییییکک0123456789,?'), '﷼', 'RIAL')"),
    "greek_sigma": (G.normalize_greek, "Αγαπητός", "regexp_replace({0}, 'ς\\z', 'σ')"),
    "strip_marks": (G.strip_marks, "ง่าย כָּבוֹד résumé", "regexp_replace({0}, '\\p{{Mn}}', '', 'g')"),
    "control_strip": (G.strip_control, "a\x01b\x7fc\x85d", "regexp_replace({0}, '[\\x01-\\x08\\x0E-\\x1F\\x7F-\\x{{84}}\\x{{86}}-\\x{{9F}}]', '', 'g')"),
    "swedish_recompose": (G.recompose_swedish, "åAÖo", "replace(replace(replace({0}, 'a' || chr(778), 'å'), 'O' || chr(776), 'Ö'), 'A' || chr(778), 'Å')"),
    "kvariants": (G.normalize_kvariants, "澚䀾亚㮺刄刃 真正的选举", f"translate({{0}}, '{''.join(a for a, _, _ in lexicons.KVARIANTS)}', '{''.join(b for _, _, b in lexicons.KVARIANTS)}')"),
    "kana": (G.katakana_to_hiragana, "ダメ駄目だめHi トート", f"translate({{0}}, '{''.join(chr(c) for c in range(0x30A1, 0x30F7))}', '{''.join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))}')"),
}


def _table_query(name: str, function: Callable[[Column], Column], ending: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = F.concat("text", F.lit(f" {ending}"))
        return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(function(text), 256).alias("text_sha256"))

    run.__name__ = name
    return run


for _name, (_function, _ending, _sql) in _TABLES.items():
    _literal = "text || ' ' || " + " || ".join(f"chr({ord(c)})" if ord(c) < 32 or 0x7F <= ord(c) < 0xA0 else f"'{_q(c)}'" for c in _ending)
    query(f"SELECT conv_id, turn, sha256({_sql.format(f'({_literal})')}) AS text_sha256 FROM conversations")(_table_query(_name, _function, _ending))


# -- detection


_LETTERS = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' '"


@query(
    f"""WITH d AS (SELECT row_number() OVER () AS k, code, {_LETTERS} AS t FROM (SELECT text, CASE lang WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' END AS code FROM documents)),
    g AS (SELECT k, code, unnest(list_transform(range(1, len(t) - 1), lambda i: substr(t, i, 3))) AS g FROM d WHERE len(t) >= 3 AND t <> '  '),
    p AS (SELECT code, g, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, g) - 1 AS rank FROM g WHERE code IS NOT NULL GROUP BY code, g QUALIFY rank < {language_model.TOP}),
    r AS (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, g) - 1 AS rank FROM g GROUP BY k, g),
    s AS (SELECT k, l.code AS found, sum(CASE WHEN p.g IS NULL THEN {language_model.TOP} ELSE least({language_model.TOP}, abs(p.rank - r.rank)) END) AS score FROM r, (SELECT DISTINCT code FROM p) l LEFT JOIN p ON p.code = l.code AND p.g = r.g GROUP BY k, l.code),
    best AS (SELECT k, arg_min(found, (score, found)) AS found FROM s GROUP BY k)
    SELECT code, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (code = found) AS BIGINT) AS n_right FROM d LEFT JOIN best USING (k) GROUP BY code"""
)
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram profiles from the documents' own labels; how many of each language are told right."""
    docs = _table(spark, sf_dir, "documents").withColumn("code", F.element_at(F.create_map(*(F.lit(x) for kv in (("en", "eng"), ("fr", "fra"), ("de", "deu"), ("es", "spa")) for x in kv)), F.col("lang")))
    model = language_model.train(docs, "code")
    t = Tokenizer(TokenizerConfig(allow_list=("deu", "eng", "fra", "spa"), language_model=model))
    found = docs.select("code", t.detect("text")["language"].alias("found"))
    return found.groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("code") == F.col("found")).alias("n_right"))


_CODES, _NAMES = ", ".join(f"'{c}'" for c in tables.LANGUAGES), ", ".join(f"'{s}'" for s in tables.SCRIPTS if s not in ("Cj", "Other"))


@query(
    f"SELECT w, CASE WHEN w IN ({_CODES}) THEN w END AS code, CASE WHEN w = 'zho' THEN 'cmn' ELSE w END AS detector, CASE WHEN w = 'Mandarin' THEN 'Cj' WHEN w IN ({_NAMES}) THEN w ELSE 'Other' END AS script, CASE WHEN w = 'Mandarin' OR w IN ({_NAMES}) THEN w ELSE 'other' END AS name"
    f" FROM (SELECT DISTINCT unnest(regexp_extract_all(text || ' eng zho xxx Latin Mandarin Cj Klingon', '{SPLIT}')) AS w FROM conversations)"
)
def enum_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct segment of all turns, and some names, taken for a language's code and for a script's name."""
    words = _table(spark, sf_dir, "conversations").select(F.explode(G.segment_native(F.concat("text", F.lit(" eng zho xxx Latin Mandarin Cj Klingon")))).alias("w")).distinct()
    return words.select("w", G.language_from_code("w").alias("code"), G.detector_language("w").alias("detector"), G.script_from_name("w").alias("script"), G.script_name(G.script_from_name("w")).alias("name"))


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, _, b in lexicons.KVARIANTS)


@query(f"SELECT conv_id, turn, CAST(count(*) FILTER (b IS NOT NULL) AS BIGINT) AS n_mapped, sha256(string_agg(coalesce(b, c), '' ORDER BY i)) AS text_sha256 FROM (SELECT conv_id, turn, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT conv_id, turn, text || '{''.join(a for a, _, _ in lexicons.KVARIANTS)}' AS t FROM conversations)) LEFT JOIN (VALUES {_PAIRS}) v(a, b) ON a = c GROUP BY conv_id, turn")
def kvariant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of variants joined with the characters of every turn."""
    text = F.concat("text", F.lit("".join(a for a, _, _ in lexicons.KVARIANTS)))
    pairs = spark.createDataFrame([(a, b) for a, _, b in lexicons.KVARIANTS], "a string, b string")
    chars = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split(text, "")).alias("i", "c")).withColumn("was", F.col("c"))
    mapped = G.map_variants(chars, pairs, "c").groupBy("conv_id", "turn").agg(F.count_if(F.col("was") != F.col("c")).alias("n_mapped"), F.array_sort(F.collect_list(F.struct("i", "c"))).alias("s"))
    return mapped.select("conv_id", "turn", "n_mapped", F.sha2(F.array_join(F.col("s.c"), ""), 256).alias("text_sha256"))


_SEPARATOR_SQL = f"SELECT CAST(cp AS INT) AS cp, {_is_hard('chr(cp)')} AS hard FROM (SELECT CAST(range AS INT) AS cp FROM range(1, 55296) UNION ALL SELECT CAST(range AS INT) FROM range(57344, 131072)) WHERE {_is_separator('chr(cp)')}"


@query(_SEPARATOR_SQL)
def separator_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default separators of one character (without U+0000)."""
    hard = tables.hard_separators()
    return spark.createDataFrame([(ord(c), c in hard) for c in sorted(tables.separator_chars()) if c != "\0"], "cp int, hard boolean")


# -- analytics

_WORDS = f"{_DOC_TOKENS}, word AS (SELECT doc_id, lang, lemma, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM tok WHERE kind = 'word')"


@query(f"WITH {_WORDS} SELECT lang, lemma, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, lemma) AS INT) AS rank FROM word GROUP BY lang, lemma QUALIFY rank <= 20")
def vocab_topk_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return analytics.top_words(analytics.words(docs, keep=("lang",)), 20, ("lang",))


@query(f"WITH {_WORDS} SELECT lemma, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM word GROUP BY lemma")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.document_frequency(_table(spark, sf_dir, "documents"))


@query(f"WITH {_WORDS} SELECT a.lemma || ' ' || b.lemma AS gram, CAST(count(*) AS BIGINT) AS n FROM word a JOIN word b ON a.doc_id = b.doc_id AND b.i = a.i + 1 GROUP BY 1")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ngram_counts(_table(spark, sf_dir, "documents"), 2)


_CONTEXTS = f"{_DOC_TOKENS}, ctx AS (SELECT *, CAST(coalesce(sum(CASE WHEN separator_kind = 'hard' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS BIGINT) AS context FROM tok)"


@query(f"WITH {_CONTEXTS} SELECT doc_id, context, CAST(count(*) AS BIGINT) AS n_words FROM ctx WHERE kind = 'word' GROUP BY doc_id, context")
def context_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.context_lengths(_table(spark, sf_dir, "documents"), ("doc_id",))


@query(
    f"""WITH {_CONTEXTS}, w AS (SELECT doc_id, context, lemma, row_number() OVER (PARTITION BY doc_id, context ORDER BY pos) AS i FROM ctx WHERE kind = 'word')
    SELECT a.lemma AS first, b.lemma AS second, CAST(count(*) AS BIGINT) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.context = b.context AND b.i BETWEEN a.i + 1 AND a.i + 2 GROUP BY 1, 2"""
)
def proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.proximity(_table(spark, sf_dir, "documents"), within=2)


@query(f"WITH {_WORDS}, t AS (SELECT doc_id, lemma, CAST(count(*) AS BIGINT) AS tf FROM word GROUP BY ALL) SELECT doc_id, lemma, tf, CAST(count(*) OVER (PARTITION BY lemma) AS BIGINT) AS df FROM t")
def tf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.tf_idf(_table(spark, sf_dir, "documents"), "doc_id")


# -- SQL and streams


@query(f"WITH {_CONV} SELECT role, {_KIND} AS kind, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL")
def sql_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    _table(spark, sf_dir, "conversations").createOrReplaceTempView("glyphflow_turns")
    return spark.sql("SELECT role, kind, count(*) AS n FROM glyphflow_turns, LATERAL tokenize_rows(text) GROUP BY role, kind")


@query(f"SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '{SPLIT}')) AS BIGINT) AS n FROM conversations")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    _table(spark, sf_dir, "conversations").createOrReplaceTempView("glyphflow_turns")
    return spark.sql("SELECT conv_id, turn, CAST(size(segment_str(text)) AS BIGINT) AS n FROM glyphflow_turns")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, lemma, CAST(count(*) AS BIGINT) AS n FROM (SELECT ts, unnest(string_split(lower(event_type), '_')) AS lemma FROM events) GROUP BY ALL")
def windowed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming aggregation, on a table."""
    counts = term_counts(_table(spark, sf_dir, "events"), "ts", "event_type", "1 day", "2 days")
    return counts.select(F.col("window.start").alias("start"), "lemma", "n")


@query(f"WITH {_CONV} SELECT role, {_KIND} AS kind, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY ALL")
def stream_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream over the table's files, run until they are used up."""
    table = _table(spark, sf_dir, "conversations")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/conversations.parquet*")
    counts = Tokenizer().explode(stream.select("role", "text")).groupBy("role", "kind").agg(F.count("*").alias("n"))
    return run_to_table(counts, shared_path(spark, "kinds"))


# -- normalisers of the engine, scripts beside Latin

_ENGINE: dict[str, tuple[str, str | None, str, str]] = {
    "lowercase": ("Greek", None, "ΑΓΑΠΗΤΟΣ ΣΑΣ", "lower(translate({0}, 'Σ', 'σ'))"),
    "greek": ("Greek", None, "Αγαπητός", "regexp_replace({0}, 'ς\\z', 'σ')"),
    "arabic": ("Arabic", "ara", "ٱلْحَمْدُ النهاردة يومى الحـــمد", "translate({0}, 'أإآٱىةـ', 'اااايه')"),
    "persian": ("Arabic", "pes", "علي كيك ۱۲۳۴ چرا؟ ﷼", "replace(translate({0}, 'يیىۀكک۰۱۲۳۴۵۶۷۸۹،؟' || chr(8204), 'ییییکک0123456789,?'), '﷼', 'RIAL')"),
    "nonspacing": ("Hebrew", None, "ง่าย כָּבוֹד", "regexp_replace({0}, '\\p{{Mn}}', '', 'g')"),
    "chinese": ("Cj", "cmn", "澚䀾亚㮺刄刃", f"translate({{0}}, '{''.join(a for a, _, _ in lexicons.KVARIANTS)}', '{''.join(b for _, _, b in lexicons.KVARIANTS)}')"),
    "japanese": ("Cj", "jpn", "ダメ駄目だめHi", f"translate({{0}}, '{''.join(chr(c) for c in range(0x30A1, 0x30F7))}', '{''.join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))}')"),
    "vietnamese": ("Latin", "vie", "Ðại Đại", "translate({0}, 'ÐĐđð', 'dddd')"),
    "turkish": ("Latin", "tur", "ışık", "translate({0}, 'ı', 'i')"),
    "quote": ("Latin", None, "l’l‘l‛", "translate({0}, '’‘‛', '''''''')"),
    "ae_oe": ("Latin", None, "œŒæÆ", "replace(replace(replace(replace({0}, 'œ', 'oe'), 'Œ', 'oe'), 'æ', 'ae'), 'Æ', 'ae')"),
}


@query("SELECT conv_id, turn, " + ", ".join(f"sha256({to.format(f"(text || ' {ending}')")}) AS {name}" for name, (_, _, ending, to) in _ENGINE.items()) + " FROM conversations")
def engine_normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single steps of the engine that tokenize() runs, by script and language, on every turn with an ending that they change."""
    t, rows = Tokenizer(), _table(spark, sf_dir, "conversations")
    texts = {name: F.concat("text", F.lit(f" {ending}")) for name, (_, _, ending, _) in _ENGINE.items()}
    rows = rows.select("conv_id", "turn", t.normalize_with_each(texts, {name: (script, language) for name, (script, language, _, _) in _ENGINE.items()}).alias("n"))
    return rows.select("conv_id", "turn", *(F.sha2(F.col(f"n.{name}"), 256).alias(name) for name in _ENGINE))


_RANGES = {"Persian": "می‌خواهم چرا", "Hiragana": "かな", "Katakana": "カナ", "Mandarin": "漢字", "Arabic": "العربية", "Khmer": "ខ្មែរ"}


@query("SELECT conv_id, turn, " + ", ".join(f"regexp_matches(text, '[{(c := tables.char_class(tables.SCRIPT_RANGES.get(n) or tables.PART_RANGES[n]))}]') AS own_{n.lower()}, regexp_matches(text || '{e}', '[{c}]') AS {n.lower()}" for n, e in _RANGES.items()) + " FROM conversations")
def script_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether letters of a script or a part of one occur in every turn, alone and with some set behind it."""
    columns = [c for n, e in _RANGES.items() for c in (G.contains_script("text", n).alias(f"own_{n.lower()}"), G.contains_script(F.concat("text", F.lit(e)), n).alias(n.lower()))]
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", *columns)


_LENGTHS = "SELECT conv_id, turn, sum(original_lengths(t, 2).bytes) AS bytes FROM (SELECT conv_id, turn, explode(tokenize(text)) AS t FROM glyphflow_turns) GROUP BY conv_id, turn"


@query(f"""WITH s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '{SPLIT}')) AS p FROM conversations), n AS (SELECT *, {_lemma_sql("p")} AS l FROM s),
k AS (SELECT *, CASE WHEN strlen(substr(l, 1, 1)) >= 2 THEN 1 ELSE 2 END AS c FROM n)
SELECT conv_id, turn, CAST(sum(strlen(substr(l, 1, c))) AS BIGINT) AS bytes FROM k GROUP BY conv_id, turn""")
def sql_original_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without character maps, lengths are those of the lemma."""
    sql.register(spark)
    _table(spark, sf_dir, "conversations").createOrReplaceTempView("glyphflow_turns")
    return spark.sql(_LENGTHS)


#: The reference semantics on one text, for tests.
engine = core.engine
