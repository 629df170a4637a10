"""The catalogue: a query for each operator over whole tables, with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.registry import register
from ..operators import agent, bitmaps, bm25, context, evaluate, fuzzy, hybrid, incremental, lines, phrase
from ..operators.corpus import RUN, Corpus
from ..sources import scratch, store, stored
from ..streaming import hot_cold
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_KEPT: dict[tuple, Corpus] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, kind: str = "core") -> Corpus:
    """The documents of a folder, indexed once a session."""
    key = spark.sparkContext.applicationId, sf_dir, kind
    if key not in _KEPT:
        _KEPT[key] = Corpus.from_files(table(spark, sf_dir, "documents"), kind=kind).persisted()
    return _KEPT[key]


def _round(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round("confidence", 6))


# Corpus and lexicon


@query(f"{S.TOK} SELECT doc_id, token_count, token_start, token_start + token_count AS token_end FROM fr")
def file_ranges(spark, d):
    return corpus(spark, d).file_stats().drop("path")


@query(f"{S.TOK} SELECT count(*) AS n_tokens, count(DISTINCT token) AS n_unique, cast(max(pos) AS bigint) AS last_pos, cast(sum(line_no) AS bigint) AS line_sum FROM tok")
def index_build(spark, d):
    """The token table made anew."""
    t = Corpus.from_files(table(spark, d, "documents")).tokens
    return t.agg(F.count("*").alias("n_tokens"), F.countDistinct("token").alias("n_unique"), F.max("pos").alias("last_pos"), F.sum("line_no").alias("line_sum"))


_MAPS = "mp AS (SELECT token, 36 + sum(8 + least(2 * c, 8192)) AS b FROM (SELECT token, pos // 65536 AS k, count(*) AS c FROM tok GROUP BY 1, 2) GROUP BY 1)"


@query(
    f"{S.TOK}, {_MAPS}, lex AS (SELECT token, count(*) AS c FROM tok GROUP BY 1) SELECT cast(sum(c) AS bigint) AS total_tokens, count(*) AS unique_tokens, (SELECT count(*) FROM n) AS n_files, "
    "cast(sum(b) AS bigint) AS postings_bytes, cast(sum(strlen(token) + 24) + 4 * sum(c) + sum(b) AS bigint) AS memory_bytes FROM lex JOIN mp USING (token)"
)
def corpus_stats(spark, d):
    return corpus(spark, d).stats()


@query(f"{S.TOK} SELECT token, count(*) AS freq FROM tok GROUP BY 1 ORDER BY freq DESC, token LIMIT 20")
def token_topk(spark, d):
    return corpus(spark, d).top_tokens(20)


@query(f"{S.TOK} SELECT token, count(*) AS freq, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY 1")
def lexicon(spark, d):
    return corpus(spark, d).lexicon


@query(f"{S.TOK} SELECT token, doc_id, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM tok GROUP BY 1, 2")
def postings(spark, d):
    own = corpus(spark, d).postings()
    return own.select("token", "doc_id", F.size("positions").cast("long").alias("n"), F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


@query(
    "WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_content, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) "
    "SELECT doc_id, cast(line_no AS integer) AS line_no, line_content, cast(coalesce(sum(strlen(line_content) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS integer) AS byte_offset FROM ln"
)
def line_lookup(spark, d):
    rows = lines.line_table(table(spark, d, "documents").where("text is not null"), "text")
    return rows.select("doc_id", "line_no", F.col("line").alias("line_content"), F.col("byte_start").cast("int").alias("byte_offset"))


_SPANS = "sp AS (SELECT doc_id, line_no, cast(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS s, cast(strlen(line) + 1 AS bigint) AS len FROM ln)"


@query(
    f"{S.TOK}, {_SPANS}, es AS (SELECT tok.doc_id, tok.line_no AS own, cast(floor((pos - token_start)::double / token_count * strlen(text)) AS bigint) AS byte FROM tok JOIN fr USING (doc_id) JOIN documents USING (doc_id)) "
    "SELECT es.doc_id, count(*) AS n_tokens, cast(sum(sp.line_no) AS bigint) AS line_sum, cast(sum((sp.line_no = own)::int) AS bigint) AS n_right FROM es JOIN sp ON sp.doc_id = es.doc_id AND byte >= s AND byte < s + len GROUP BY 1"
)
def byte_lines(spark, d):
    """The line of each token by its estimated place in bytes, and how often that is its own."""
    c = corpus(spark, d)
    places = lines.estimated_bytes(c.tokens.select("doc_id", "local_pos", F.col("line_no").alias("own")), c.files)
    found = lines.at_bytes(lines.line_table(c.files), places)
    return found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum("line_no").alias("line_sum"), F.sum((F.col("line_no") == F.col("own")).cast("int")).alias("n_right"))


@query(f"{S.TOK} SELECT p.position, tok.token, tok.doc_id, cast(tok.line_no AS integer) AS line_no FROM (SELECT unnest([0, 17, 1000, 20000]) AS position) AS p LEFT JOIN tok ON tok.pos = p.position")
def token_at_position(spark, d):
    asked = spark.createDataFrame([(p,) for p in (0, 17, 1000, 20000)], "pos long")
    return corpus(spark, d).at(asked).select(F.col("pos").cast("int").alias("position"), "token", "doc_id", "line_no")


@query(f"{S.TOK} SELECT doc_id, token_start, token_start + token_count AS token_end FROM fr WHERE token_start < 9000 AND token_start + token_count > 5000")
def files_overlap(spark, d):
    return corpus(spark, d).overlapping(5000, 9000).drop("path")


@query(f"{S.TOK} SELECT p AS position, doc_id FROM (SELECT unnest(range(0, (SELECT cast(max(pos) AS bigint) + 1 FROM tok), 997)) AS p) JOIN fr ON p >= token_start AND p < token_start + token_count")
def position_to_file(spark, d):
    """The file of every 997th position of the stream: positions asked for meet files by runs of positions, then by range."""
    files = corpus(spark, d).file_stats().where("token_count > 0").select("doc_id", "token_start", "token_end")
    end = files.agg(F.coalesce(F.max("token_end"), F.lit(0))).first()[0]
    asked = spark.range(0, end, 997).select(F.col("id").alias("position"), F.floor(F.col("id") / RUN).alias("run"))
    each = files.withColumn("run", F.explode(F.sequence(F.floor(F.col("token_start") / RUN), F.floor((F.col("token_end") - 1) / RUN))))
    return each.join(asked, "run").where("position >= token_start AND position < token_end").select("position", "doc_id")


# Phrases


def _phrase(spark, d, words, inside=False):
    return _round(corpus(spark, d).phrase(words, within_file=inside)).select("position", F.col("file_path").cast("long").alias("doc_id"), F.col("line_number").alias("line_no"), "confidence")


@query(S.confidence(["of", "the"]))
def phrase_exact(spark, d):
    return _phrase(spark, d, ["of", "the"])


@query(S.confidence(["The", "and", "attion"]))
def phrase_trigram(spark, d):
    return _phrase(spark, d, ["The", "and", "attion"])


@query(S.confidence(["the", "the"]))
def phrase_repeat(spark, d):
    return _phrase(spark, d, ["the", "the"])


@query(S.confidence(["the", "the"], True))
def phrase_within_file(spark, d):
    return _phrase(spark, d, ["the", "the"], True)


@query(S.confidence(["the", "nosuchtoken"]))
def phrase_missing(spark, d):
    return _phrase(spark, d, ["the", "nosuchtoken"])


BULK = [["of", "the"], ["the", "of"], ["and", "the"], ["the", "the"], ["The", "and", "attion"], ["edwh"], ["the", "nosuchtoken"]]


@query(f"{S.TOK}, {', '.join(S.phrase(p, f'h{i}') for i, p in enumerate(BULK))} {' UNION ALL '.join(f'SELECT {i} AS phrase_id, position, doc_id FROM h{i}' for i in range(len(BULK)))}")
def phrase_bulk(spark, d):
    c = corpus(spark, d)
    return c.phrases(phrase.terms_of(c, BULK)).select("phrase_id", "position", "doc_id")


@query(
    f"{S.TOK}, b AS (SELECT cast(item_id AS integer) AS phrase_id, regexp_extract_all(text, '{S.CORE}') AS w FROM benchmark), "
    "p AS (SELECT phrase_id, unnest(range(1, len(w))) AS i, w FROM b), q AS (SELECT phrase_id, i, w[i] AS a, w[i + 1] AS b FROM p), "
    "t AS (SELECT token AS a, lead(token) OVER (ORDER BY pos) AS b FROM tok), c AS (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2) "
    "SELECT phrase_id, cast(i - 1 AS integer) AS place, n AS hits FROM q JOIN c USING (a, b)"
)
def phrase_bulk_many(spark, d):
    """Every pair of neighbouring words of every benchmark item: thousands of phrases in one job."""
    words = table(spark, d, "benchmark").select(F.col("item_id").cast("int").alias("item"), X.tokenize(F.col("text")).alias("w"))
    pairs = words.where("size(w) > 1").select("item", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("place"), "w")
    terms = pairs.select(F.struct("item", "place").alias("phrase_id"), F.lit(2).alias("k"), F.posexplode(F.slice("w", F.col("place") + 1, F.lit(2))).alias("off", "token"))
    found = corpus(spark, d).phrases(terms).groupBy("phrase_id").agg(F.count("*").alias("hits"))
    return found.select(F.col("phrase_id.item").alias("phrase_id"), "phrase_id.place", "hits")


@query(f"{S.TOK} SELECT token, pos // 32768 AS bucket, count(*) AS n, cast(sum(pos) AS bigint) AS total FROM tok WHERE token IN ('the', 'of', 'de', 'und') GROUP BY 1, 2")
def posting_bitmaps(spark, d):
    """Bitmaps of the places of frequent words, read back bit by bit."""
    c = corpus(spark, d)
    own = bitmaps.postings(c, c.tokens.where(F.col("token").isin("the", "of", "de", "und")))
    places = bitmaps.positions_of(own.drop("n"))
    return places.groupBy("token", F.floor(F.col("position") / 32768).alias("bucket")).agg(F.count("*").alias("n"), F.sum("position").alias("total"))


@query(f"{S.TOK}, {S.phrase(['of', 'the'])} SELECT position FROM hits")
def phrase_bitmaps(spark, d):
    return bitmaps.phrase(corpus(spark, d), ["of", "the"])


@query(f"{S.TOK} SELECT pos AS position FROM tok WHERE token = 'and' INTERSECT SELECT pos - 1 FROM tok WHERE token = 'the'")
def phrase_intersect(spark, d):
    return phrase.intersected(corpus(spark, d), ["and", "the"])


@query(
    f"{S.TOK}, {S.phrase(['of', 'the'])}, a AS (SELECT position, string_agg(token, ' ' ORDER BY pos) AS s FROM hits JOIN tok ON pos BETWEEN position - 3 AND position + 1 GROUP BY position) "
    "SELECT position, '[POS ' || position || '] ''of the'' (context: ... ' || s || ')' AS context FROM a"
)
def phrase_context(spark, d):
    return corpus(spark, d).phrase(["of", "the"]).select("position", "context")


@query(f"{S.TOK}, {S.phrase(['of', 'the'])} SELECT position, line AS line_content, {S.bold(['of', 'the'])} AS highlighted_snippet FROM hits JOIN ln USING (doc_id, line_no)")
def phrase_highlight(spark, d):
    return corpus(spark, d).phrase(["of", "the"]).select("position", "line_content", "highlighted_snippet")


@query(f"{S.TOK}, t AS (SELECT pos, token, lead(token) OVER (ORDER BY pos) AS nxt FROM tok) SELECT pos AS position, token FROM t WHERE token = nxt")
def adjacent_duplicates(spark, d):
    return phrase.adjacent_repeats(corpus(spark, d))


# Typos


def _fuzzy_sql(word: str, distance: int, prefilter: bool = True) -> str:
    return (
        f"{S.TOK} SELECT pos AS position, token, cast(levenshtein(token, '{word}') AS integer) AS dist, round(1 - levenshtein(token, '{word}') / {distance + 1}.0 + {S.WEIGHT}, 6) AS confidence "
        f"FROM tok JOIN n USING (doc_id) WHERE {S.ASCII} AND {S.near(word, distance, prefilter=prefilter)}"
    )


def _fuzzy(spark, d, word, distance, prefilter=True):
    rows = _round(corpus(spark, d).fuzzy(word, distance, prefilter=prefilter))
    return rows.where(F.length("token") == F.octet_length("token")).select("position", "token", "dist", "confidence")


@query(_fuzzy_sql("thee", 1))
def fuzzy_d1(spark, d):
    return _fuzzy(spark, d, "thee", 1)


@query(_fuzzy_sql("thes", 2))
def fuzzy_d2(spark, d):
    return _fuzzy(spark, d, "thes", 2)


@query(_fuzzy_sql("thes", 2, False))
def fuzzy_no_prefilter(spark, d):
    return _fuzzy(spark, d, "thes", 2, False)


@query(f"{S.TOK} SELECT DISTINCT token, cast(levenshtein(token, 'tion') AS integer) AS dist FROM tok WHERE {S.ASCII} AND {S.near('tion', 1)}")
def fuzzy_candidates(spark, d):
    return fuzzy.candidates(corpus(spark, d), "tion", 1).where(F.length("token") == F.octet_length("token"))


WORDS = ["thee", "tion", "andd", "thes", "withh", "edwh", "stshh", "inthe"]


@query(
    f"{S.TOK}, lex AS (SELECT DISTINCT token FROM tok WHERE {S.ASCII}) SELECT q.query, token, cast(levenshtein(token, q.query) AS integer) AS dist FROM lex JOIN (SELECT unnest({WORDS}) AS query) AS q "
    "ON abs(strlen(token) - strlen(q.query)) <= 2 AND levenshtein(token, q.query) BETWEEN 1 AND 2 "
    "AND len(list_filter(range(1, len(q.query)), lambda i: contains(token, substr(q.query, i, 2)))) > 0"
)
def fuzzy_join_bulk(spark, d):
    asked = spark.createDataFrame([(w,) for w in WORDS], "query string")
    return corpus(spark, d).fuzzy_join(asked, 2).where(F.length("token") == F.octet_length("token"))


# Questions


_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS) + "]"


@query(
    f"WITH a AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}._'']+')) AS w, generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}._'']+'), 1) AS i FROM benchmark), "
    f"k AS (SELECT item_id, i, w FROM a WHERE strlen(w) > 1 AND NOT list_contains({_STOPS}, lower(w))), "
    "g AS (SELECT item_id, i, regexp_replace(regexp_replace(w, '([\\p{Ll}])([\\p{Lu}])', '\\1_\\2', 'g'), '([\\p{Lu}])([\\p{Lu}][\\p{Ll}])', '\\1_\\2', 'g') AS w FROM k), "
    "p AS (SELECT item_id, i, unnest(string_split(w, '_')) AS w, generate_subscripts(string_split(w, '_'), 1) AS j FROM g), "
    f"f AS (SELECT item_id, lower(w) AS w, row_number() OVER (PARTITION BY item_id ORDER BY i, j) - 1 AS n FROM p WHERE w <> '' AND NOT list_contains({_STOPS}, lower(w))), "
    "t AS (SELECT item_id, count(*) AS c FROM f GROUP BY 1), r AS (SELECT item_id, n // 4 AS place, string_agg(w, ' ' ORDER BY n) AS phrase FROM f GROUP BY 1, 2) "
    "SELECT item_id, cast(place AS integer) AS place, phrase FROM r UNION ALL SELECT f.item_id, cast((c + 3) // 4 + n AS integer), w FROM f JOIN t USING (item_id)"
)
def parse_query_rows(spark, d):
    """The phrases of every benchmark item, taken as a question."""
    asked = table(spark, d, "benchmark")
    return asked.select("item_id", F.posexplode(X.search_phrases(F.col("text"))).alias("place", "p")).select("item_id", "place", F.array_join("p", " ").alias("phrase"))


@query(
    "WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[A-Za-z_-]*[a-z_-][A-Z_-][A-Za-z_-]*')) AS word FROM pages), "
    "g AS (SELECT word, regexp_replace(regexp_replace(word, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g') AS w FROM k) "
    "SELECT word, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(w, '[_-]'), lambda x: lower(x)), lambda x: x <> ''), ' '), '') AS parts FROM g"
)
def split_identifier_rows(spark, d):
    """Every name in snake, kebab or camel case of the raw pages, in parts."""
    words = table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[A-Za-z_-]*[a-z_-][A-Z_-][A-Za-z_-]*"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(X.split_identifier(F.col("word")), " ").alias("parts"))


QUESTION = "where is the edwh stsh ntth"


@query(
    f"{S.TOK}, {S.phrase(['edwh', 'stsh', 'ntth'], 'h0')}, e AS (SELECT position FROM h0 UNION SELECT pos FROM tok WHERE token IN ('edwh', 'stsh', 'ntth')), "
    f"f AS (SELECT DISTINCT pos AS position, round(0.5 * (0.5 + {S.WEIGHT}), 6) AS confidence FROM tok JOIN n USING (doc_id) WHERE {S.ASCII} AND (({S.near('edwh', 1)}) OR ({S.near('stsh', 1)}) OR ({S.near('ntth', 1)}))) "
    "SELECT position, 1.0::double AS confidence FROM e UNION ALL SELECT position, confidence FROM f WHERE position NOT IN (SELECT position FROM e)"
)
def unified_search(spark, d):
    return _round(corpus(spark, d).search(QUESTION)).select("position", "confidence")


# Ranking

TERMS = ["edwh", "ntth", "stsh", "the"]


@query(f"{S.TOK}, {S.bm25(TERMS, 10, 'reference')} SELECT doc_id, round(score, 6) AS score FROM best")
def bm25_reference(spark, d):
    return corpus(spark, d).bm25(TERMS, 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{S.TOK}, {S.bm25(TERMS, 10, 'okapi')} SELECT doc_id, round(score, 6) AS score FROM best")
def bm25_okapi(spark, d):
    return corpus(spark, d).bm25(TERMS, 10, "okapi").select("doc_id", F.round("score", 6).alias("score"))


@query(
    f"{S.TOK}, {S.bm25(['edwh', 'stsh'], 5, 'reference')}, {S.phrase(['edwh', 'stsh'], 'h0', True)}, "
    "h AS (SELECT doc_id, position, 'edwh stsh' AS phrase FROM h0 UNION ALL SELECT doc_id, pos, token FROM tok WHERE token IN ('edwh', 'stsh')) "
    "SELECT doc_id, position, phrase, round(0.7 + least(0.3 * score, 0.3), 6) AS confidence, cast(rank AS integer) AS rank FROM h JOIN best USING (doc_id)"
)
def hybrid_documented(spark, d):
    return _round(corpus(spark, d).hybrid("where is the edwh stsh", 5)).drop("score")


@query(
    f"{S.TOK}, {S.bm25(['edwh', 'stsh'], 5, 'reference')}, {S.phrase(['edwh', 'stsh'], 'h0', True)}, "
    "h AS (SELECT doc_id, position, 'edwh stsh' AS phrase, line_no FROM h0 UNION ALL SELECT doc_id, pos, token, line_no FROM tok WHERE token IN ('edwh', 'stsh')) "
    "SELECT position, '[DOC ' || doc_id || '] [POS ' || position || '] BM25=' || printf('%.2f', score) || ' | ' || chr(39) || phrase || chr(39) AS context, round(0.7 + least(0.3 * score, 0.3), 6) AS confidence, "
    "cast(doc_id AS varchar) AS file_path, cast(line_no AS integer) AS line_number, line AS line_content FROM h JOIN best USING (doc_id) JOIN ln USING (doc_id, line_no)"
)
def hybrid_rows(spark, d):
    """The hits of the best files as result rows."""
    return _round(hybrid.results(corpus(spark, d), "where is the edwh stsh", 5)).drop("highlighted_snippet")


@query(
    f"{S.TOK}, {S.bm25(['edwh', 'stsh'], 2, 'reference')}, g AS (SELECT doc_id, pos, token AS a, lead(token) OVER (ORDER BY pos) AS b, lead(doc_id) OVER (ORDER BY pos) AS d2 FROM tok) "
    "SELECT best.doc_id, x.pos AS position, x.a || ' ' || x.b AS phrase, round(0.7 + least(0.3 * score, 0.3), 6) AS confidence, cast(rank AS integer) AS rank "
    "FROM g JOIN best ON g.doc_id = best.doc_id AND g.d2 = g.doc_id JOIN g AS x ON x.a = g.a AND x.b = g.b"
)
def hybrid_literal(spark, d):
    return _round(corpus(spark, d).hybrid("where is the edwh stsh", 2, "literal")).drop("score")


@query(
    f"{S.TOK}, {S.phrase(['of', 'the'])}, {S.bm25(['edwh', 'stsh'], 1000000, 'reference')} "
    "SELECT CASE WHEN a.doc_id IS NULL THEN 'second' WHEN b.doc_id IS NULL THEN 'first' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT doc_id FROM hits) AS a FULL JOIN best AS b ON a.doc_id = b.doc_id GROUP BY 1"
)
def engine_compare(spark, d):
    c = corpus(spark, d)
    return evaluate.compared(phrase.positions(c, ["of", "the"]), bm25.scores(c, ["edwh", "stsh"]), "doc_id")


# Streams


@query(f"{S.TOK} SELECT pos // 10000 AS segment, min(pos) AS start_pos, count(*) AS token_count, count(*) = 10000 AS cold FROM tok GROUP BY 1")
def segments(spark, d):
    return hot_cold.segments_of(corpus(spark, d).tokens, 10_000)


@query(
    f"{S.TOK}, {S.phrase(['the', 'the'])} SELECT position, string_agg(token, ' ' ORDER BY pos) AS left_context FROM hits JOIN tok ON pos BETWEEN greatest(position - 15, position // 1000 * 1000) AND least(position + 2, (position // 1000 + 1) * 1000) - 1 GROUP BY position"
)
def hot_cold_phrase(spark, d):
    return hot_cold.hits_with_left_context(corpus(spark, d), ["the", "the"], 1000)


_TALK = f"""WITH t0 AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '{S.CORE}') AS w FROM conversations),
t1 AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM t0),
tok AS (SELECT token, row_number() OVER (ORDER BY conv_id, turn, i) - 1 AS pos, conv_id AS doc_id, 0 AS line_no FROM t1)"""


@query(f"{_TALK}, {S.phrase(['of', 'the'])} SELECT position, position // 1000 AS segment FROM hits")
def stream_roundtrip(spark, d):
    """Conversations as a token stream in three micro-batches, then a phrase over all segments."""
    at = scratch.folder(spark)
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.tokenize(F.col("text"))).alias("i", "token"))
    top = talk.agg(F.coalesce(F.max("conv_id"), F.lit(0))).first()[0] + 1
    for k in range(3):  # one after the other: the source reads files in the order of their times
        talk.where((F.col("conv_id") >= top * k // 3) & (F.col("conv_id") < top * (k + 1) // 3)).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(talk.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    own = hot_cold.TokenStream(spark, f"{at}/stream", 1000)
    own.start(stream, ["conv_id", "turn", "i"], f"{at}/checkpoint")
    return phrase.positions(own.corpus(), ["of", "the"]).select("position", own.segment(F.col("position")).alias("segment"))


@query(S.confidence(["and", "the"]))
def persisted_roundtrip(spark, d):
    at = scratch.folder(spark)
    corpus(spark, d).save(at)
    return _round(Corpus.load(spark, at).phrase(["and", "the"])).select("position", F.col("file_path").cast("long").alias("doc_id"), F.col("line_number").alias("line_no"), "confidence")


@query(
    f"{_TALK}, sg AS (SELECT pos // 1000 AS segment, min(pos) AS start_pos, count(*) AS token_count, cast(sum(strlen(token) + 3) + 1 AS bigint) AS bytes FROM tok GROUP BY 1) SELECT *, token_count = 1000 AS cold FROM sg"
)
def stream_segments(spark, d):
    """The segments of the conversations as a stream in one batch and one that adds nothing, with their bytes."""
    own = hot_cold.TokenStream(spark, f"{scratch.folder(spark)}/stream", 1000)
    talk = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.tokenize(F.col("text"))).alias("i", "token"))
    own.append(talk, 0, ["conv_id", "turn", "i"])
    own.append(talk.limit(0), 1, ["conv_id", "turn", "i"])
    return own.segments()


# Prompts


def _around(words: list[str], most: int) -> str:
    return (
        f"{S.TOK}, {S.phrase(words)}, w AS (SELECT DISTINCT tok.pos, tok.token FROM hits JOIN tok ON tok.pos BETWEEN position - 5 AND position + 5), "
        f"r AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS c FROM w), k AS (SELECT pos, token FROM r WHERE i % greatest(c // {most}, 1) = 0)"
    )


@query(_around(["of", "the"], 100) + " SELECT pos, token FROM k")
def window_positions(spark, d):
    c = corpus(spark, d)
    return context.relevant_positions(c, phrase.positions(c, ["of", "the"]))


@query(
    _around(["of", "the"], 100) + ", p AS (SELECT '<context> ' || string_agg('[' || pos || '] ' || token, ' ' ORDER BY pos) || ' </context> <query> unheard-of question </query>' AS prompt, 2 * count(*) + 5 AS c FROM k) "
    "SELECT prompt, (SELECT count(*) FROM tok) AS original_token_count, c AS filtered_token_count, round((1 - c / (SELECT count(*) FROM tok)) * 100, 6) AS reduction_percent FROM p"
)
def prompt_tokens(spark, d):
    c = corpus(spark, d)
    out = context.build_prompt(c, "unheard-of question", [["of", "the"]])
    return out.select(F.array_join("prompt_tokens", " ").alias("prompt"), "original_token_count", "filtered_token_count", F.round("reduction_percent", 6).alias("reduction_percent"))


@query(f"{S.TOK}, {S.phrase(['of', 'the'])}, c AS (SELECT position, 1.0 + {S.WEIGHT} AS confidence FROM hits JOIN n USING (doc_id)) SELECT position, round(confidence, 6) AS confidence, cast(row_number() OVER (ORDER BY confidence DESC, position) AS integer) AS rank FROM c ORDER BY confidence DESC, position LIMIT 132")
def budget_matches(spark, d):
    hits = corpus(spark, d).phrase(["of", "the"]).where("confidence >= 0.5").select("position", "confidence")
    return _round(context.budgeted(hits, 4096))


@query(
    f"{S.TOK}, {S.phrase(['edwh'])}, s AS (SELECT position, string_agg(token, ' ' ORDER BY pos) AS s FROM hits JOIN tok ON pos BETWEEN position - 10 AND position + 9 GROUP BY 1) "
    "SELECT 'Answer the query from the passages between the context marks.' || chr(10) || chr(10) || '<context>' || chr(10) || string_agg('  [POS ' || position || '] ' || s, chr(10) ORDER BY position) || chr(10) || '</context>' || chr(10) || chr(10) || chr(10) || 'Query: what is edwh' || chr(10) || 'Answer:' AS prompt FROM s"
)
def completion_prompt(spark, d):
    return context.completion_prompt(corpus(spark, d), "what is edwh", [["edwh"]])


_CHAT = (
    f"{S.TOK}, {S.bm25(['edwh', 'stsh'], 5, 'reference')}, {S.phrase(['edwh', 'stsh'], 'h0', True)}, {S.phrase(['of', 'the'], 'h1')}, "
    "hy AS (SELECT position, 0.7 + least(0.3 * score, 0.3) AS c FROM h0 JOIN best USING (doc_id) UNION ALL SELECT pos, 0.7 + least(0.3 * score, 0.3) FROM tok JOIN best USING (doc_id) WHERE token IN ('edwh', 'stsh')), "
    f"every AS (SELECT position, c FROM hy UNION ALL SELECT position, 1.0 + {S.WEIGHT} FROM h1 JOIN n USING (doc_id)), "
    "top AS (SELECT position, c, row_number() OVER (ORDER BY c DESC, position) AS rank FROM every WHERE c >= 0.5 QUALIFY rank <= 132), "
    "sn AS (SELECT rank, top.position, string_agg(token, ' ' ORDER BY pos) AS s FROM top JOIN tok ON pos BETWEEN top.position - 15 AND top.position + 14 GROUP BY 1, 2), "
    "b AS (SELECT string_agg('  [POS ' || position || '] ' || s, chr(10) ORDER BY rank) AS body, (SELECT round(avg(c) * 100) FROM top) AS mean FROM sn) "
)


@query(
    _CHAT + f"SELECT cast(1 AS integer) AS ord, 'system' AS role, '{context.CHAT}' || chr(10) || chr(10) || '--- Passages, on average ' || cast(mean AS integer) || ' of 100 sure ---' || chr(10) || body || chr(10) || '--- End of passages ---' AS content FROM b "
    "UNION ALL SELECT 2, 'user', 'The question about these passages is:' || chr(10) || chr(10) || 'where is the edwh stsh'"
)
def chat_messages(spark, d):
    return context.chat_messages(corpus(spark, d), "where is the edwh stsh", [["of", "the"]])


@query(f"{S.TOK}, {S.phrase(['of', 'the'])} SELECT true AS token_boundary_safe, true AS balanced_braces, true AS no_truncated_tokens, cast(0 AS integer) AS n_issues")
def context_validation(spark, d):
    c = corpus(spark, d)
    row = context.context_checks(context.snippets(c, phrase.positions(c, ["of", "the"])))
    return row.withColumn("n_issues", F.size("issues")).drop("issues")


_COUNT = "length(text) - length(replace(text, '{}', ''))"


@query(
    f"WITH c AS (SELECT conv_id, turn, text, ({_COUNT.format('{')}) - ({_COUNT.format('}')}) AS b, ({_COUNT.format('(')}) - ({_COUNT.format(')')}) AS p, (text LIKE '%...' OR contains(text, chr(65533))) AS cut, "
    "trim(list_last(string_split(regexp_replace(text, '\\r?\\n$', ''), chr(10))), ' ' || chr(9) || chr(10) || chr(13)) AS l FROM conversations), "
    "e AS (SELECT *, text <> '' AND l <> '' AND NOT (l LIKE '%;' OR l LIKE '%{' OR l LIKE '%}' OR l LIKE '%,') AS o FROM c) "
    "SELECT conv_id, turn, b = 0 AND p = 0 AS syntax_valid, cast((b <> 0)::int + (p <> 0)::int + cut::int + o::int AS integer) AS n_issues, -((b <> 0)::int * 20 + (p <> 0)::int * 15 + cut::int * 10 + o::int * 5) / 100.0::double AS confidence_adjustment FROM e"
)
def validate_output(spark, d):
    rows = context.validated(table(spark, d, "conversations"))
    return rows.select("conv_id", "turn", "syntax_valid", F.size("issues").alias("n_issues"), "confidence_adjustment")


@query(f"{S.TOK} SELECT doc_id, token_count AS original, least(token_count, 100) AS kept, greatest(token_count - 100, 0) AS saved_tokens, round(CASE WHEN token_count > 0 THEN greatest(token_count - 100, 0) / token_count * 100.0 ELSE 0 END, 6) AS savings_percent FROM n")
def context_stats(spark, d):
    rows = corpus(spark, d).files.select("doc_id", F.col("token_count").alias("original"), F.least("token_count", F.lit(100)).alias("kept"))
    return rows.withColumns(X.saved(F.col("original"), F.col("kept"))).withColumn("savings_percent", F.round("savings_percent", 6))


@query(f"{S.TOK} SELECT doc_id, (token_count - 100) * 0.5::double AS saved_mb FROM n")
def kv_savings(spark, d):
    return corpus(spark, d).files.select("doc_id", X.kv_saved_mb(F.col("token_count"), F.lit(100)).alias("saved_mb"))


@query("WITH r AS (SELECT doc_id % 50 AS query, quality, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id DESC) AS i FROM labels) SELECT query, round(avg(quality::double), 6) AS confidence, count(*) AS n FROM r WHERE i <= 10 GROUP BY 1")
def feedback_last10(spark, d):
    events = table(spark, d, "labels").select((F.col("doc_id") % 50).alias("query"), F.col("doc_id").alias("seq"), (F.col("quality") == 1).alias("valid"))
    return _round(context.feedback(events))


# Maintenance

_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || chr(10) || 'updated marker text' ELSE text END AS text FROM documents)"


@query(f"{S.tokens(docs=_CHANGED)}, {S.phrase(['updated', 'marker'])} SELECT position, doc_id, cast(line_no AS integer) AS line_no, (SELECT count(*) FROM tok) AS total FROM hits")
def incremental_update(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nupdated marker text")))
    c = corpus(spark, d).update(new)
    total = c.files.agg(F.sum("token_count").alias("total"))
    return phrase.positions(c, ["updated", "marker"]).crossJoin(F.broadcast(total))  # one row


@query(f"{S.tokens(docs=_CHANGED)}, {S.phrase(['updated', 'marker'])} SELECT position, doc_id, cast(line_no AS integer) AS line_no, (SELECT count(*) FROM tok) AS total FROM hits")
def stored_update(spark, d):
    """The same change on a stored corpus: only the changed files are written."""
    at, docs = scratch.folder(spark), table(spark, d, "documents").select("doc_id", "text")
    store.save(corpus(spark, d), at)
    new = docs.where("doc_id % 7 = 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\nupdated marker text")))
    c = store.update(spark, at, new)
    total = c.files.agg(F.sum("token_count").alias("total"))
    return phrase.positions(c, ["updated", "marker"]).crossJoin(F.broadcast(total))  # one row


@query(f"{S.TOK} SELECT pos AS position, token, doc_id, cast(line_no AS integer) AS line_no, lead(token) OVER (ORDER BY pos) AS next FROM tok")
def stored_segments(spark, d):
    """Documents appended to a stored corpus in two segments and read as one."""
    at, docs = scratch.folder(spark), table(spark, d, "documents")
    middle = docs.agg(F.coalesce(F.percentile_approx("doc_id", 0.5), F.lit(0))).first()[0]
    for part in (docs.where(F.col("doc_id") <= middle), docs.where(F.col("doc_id") > middle)):
        c = store.append(spark, at, part.select(F.col("doc_id").cast("string").alias("path"), "text", "doc_id"), order="doc_id")
    return c.all_tokens("path").select(F.col("pos").alias("position"), "token", F.col("path").cast("long").alias("doc_id"), "line_no", "next")


@query(
    f"{S.TOK}, {S.phrase(['edwh', 'stsh'])}, a AS (SELECT position, string_agg(token, ' ' ORDER BY pos) AS s FROM hits JOIN tok ON pos BETWEEN position - 3 AND position + 1 GROUP BY position) "
    f"SELECT position, '[POS ' || position || '] ''edwh stsh'' (context: ... ' || s || ')' AS found FROM a UNION ALL SELECT NULL, token || ' ' || levenshtein(token, 'edwhs') FROM (SELECT DISTINCT token FROM tok WHERE {S.ASCII} AND {S.near('edwhs', 1)})"
)
def stored_layouts(spark, d):
    """A phrase with its context by the layout by position, and a mistyped word by that by pairs, of a stored corpus."""
    at = scratch.folder(spark)
    store.save(corpus(spark, d), at, layouts=True)
    c = Corpus.load(spark, at)
    close = fuzzy.candidates(c, "edwhs", 1).where(F.length("token") == F.octet_length("token"))
    return c.phrase(["edwh", "stsh"]).select("position", F.col("context").alias("found")).unionByName(close.select(F.lit(None).cast("long").alias("position"), F.format_string("%s %d", "token", "dist").alias("found")))


@query(f"{S.TOK}, {S.phrase(['of', 'the'], inside=True)} SELECT h.doc_id, position - token_start AS position FROM hits AS h JOIN fr USING (doc_id)")
def stored_phrase(spark, d):
    """A phrase by the postings and tokens of stored files in all versions, a file a document."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), X.tokenize(F.col("text")).alias("tokens"))
    name, zero = F.col("doc_id").cast("string"), F.lit(0).cast("long")
    rows = docs.select(name.alias("path"), "tokens", F.array(F.struct(name.alias("path"), F.col("text").alias("content"), zero.alias("token_start"), F.size("tokens").cast("long").alias("token_end"))).alias("files"), F.pmod("doc_id", F.lit(4)).alias("v"))
    one = stored.encoded(rows.where("v = 0"), 1)
    for v in (1, 2, 3):
        one = one.unionByName(stored.encoded(rows.where(F.col("v") == v), v + 1))
    files = scratch.written(one)
    first = stored.posting_rows(files, ["of"]).select("path", "pos")
    second = stored.token_rows(files, ["the"]).select("path", (F.col("pos") - 1).alias("pos"))
    return first.join(second, ["path", "pos"]).select(F.col("path").cast("long").alias("doc_id"), F.col("pos").alias("position"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 'changed' ELSE 'same' END AS status FROM documents")
def content_hash_changes(spark, d):
    docs = table(spark, d, "documents")
    new = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    return incremental.changes(corpus(spark, d), new)


@query()
def content_fnv(spark, d):
    register(spark)
    return table(spark, d, "documents").select("doc_id", F.expr("fnv1a64(text)").alias("fnv"))


@query(f"SELECT doc_id, cast(len(regexp_extract_all(text, '{S.CORE}')) AS integer) AS n FROM documents")
def sql_functions(spark, d):
    """The tokeniser as a SQL function."""
    register(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_of_sql_functions")
    return spark.sql("SELECT doc_id, size(tokenize(text)) AS n FROM documents_of_sql_functions")


# Agent tools


@query(f"{S.AG}, {S.phrase(['of', 'the'])} SELECT position, doc_id, cast(line_no AS integer) AS line_no, 1.0::double AS confidence FROM hits")
def agent_phrase(spark, d):
    return agent.phrase_hits(corpus(spark, d, "agent"), ["Of", "THE"]).select("position", "doc_id", "line_no", "confidence")


def _agent_near(word: str) -> str:
    return f"SELECT token, min(pos) AS position FROM tok WHERE {S.near(word, 1, 0)} GROUP BY token"


@query(
    f"{S.AG}, f AS ({_agent_near('thee')}) SELECT f.token, cast(levenshtein(f.token, 'thee') AS integer) AS dist, position, doc_id, "
    f"round(least(1.0, 1 - levenshtein(f.token, 'thee') / greatest(4, length(f.token)) + {S.WEIGHT}), 6) AS confidence FROM f JOIN tok ON tok.pos = position JOIN n USING (doc_id)"
)
def agent_fuzzy(spark, d):
    return _round(agent.fuzzy_hits(corpus(spark, d, "agent"), "Thee").drop("line_no"))


@query(
    f"{S.AG}, {S.phrase(['edwh', 'stsh'], 'h0')}, e AS (SELECT position, 0.99 AS c FROM h0 UNION ALL SELECT pos, 0.97 FROM tok WHERE token IN ('edwh', 'stsh')), "
    f"f AS (SELECT 'edwh' AS w, * FROM ({_agent_near('edwh')}) UNION ALL SELECT 'stsh', * FROM ({_agent_near('stsh')})), "
    f"g AS (SELECT position, greatest(0.5, least(1.0, 1 - levenshtein(f.token, w) / greatest(length(w), length(f.token)) + {S.WEIGHT})) AS c FROM f JOIN tok ON tok.pos = position JOIN n USING (doc_id)), "
    "m AS (SELECT position, max(c) AS c FROM (SELECT * FROM e UNION ALL SELECT * FROM g) GROUP BY 1) SELECT position, round(c, 6) AS confidence FROM m ORDER BY c DESC, position LIMIT 20"
)
def agent_search(spark, d):
    return _round(agent.search(corpus(spark, d, "agent"), "where is the Edwh stsh")).select("position", "confidence")


@query(
    f"{S.AG}, {S.phrase(['of', 'the'])}, r AS (SELECT *, {S.bold(['of', 'the'])} AS h, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM hits JOIN ln USING (doc_id, line_no)) "
    "SELECT doc_id, n, '=== ' || doc_id || ' (' || n || ' matches) ===' || chr(10) || string_agg('  [POS ' || position || '] conf=1.00 | line ' || line_no || ': ' || h, chr(10) ORDER BY position) FILTER (i <= 5) || CASE WHEN n > 5 THEN chr(10) || '  ... and ' || (n - 5) || ' more matches' ELSE '' END AS text FROM r GROUP BY doc_id, n"
)
def grouped_report(spark, d):
    c = corpus(spark, d, "agent")
    return agent.report(c, agent.phrase_hits(c, ["of", "the"]), ["of", "the"])


# Evaluation

_CHUNKS = f"{S.TOK}, ch AS (SELECT pos // 1024 AS chunk_id, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS s FROM tok GROUP BY 1), rt AS (SELECT chunk_id, n, (contains(lower(s), 'edwh')::int + contains(lower(s), 'stsh')::int + contains(lower(s), 'ntth')::int) / log10(n) AS score FROM ch WHERE contains(lower(s), 'edwh') OR contains(lower(s), 'stsh') OR contains(lower(s), 'ntth') ORDER BY score DESC, chunk_id LIMIT 3)"


@query(f"{_CHUNKS} SELECT chunk_id, n, round(score, 6) AS score FROM rt")
def chunk_retrieval(spark, d):
    return evaluate.retrieved(corpus(spark, d), ["edwh", "stsh", "ntth"]).withColumn("score", F.round("score", 6))


@query(
    f"{_CHUNKS}, hits AS (SELECT pos AS position, pos // 1024 AS chunk_id FROM tok WHERE token = 'edwh'), w AS (SELECT DISTINCT h.chunk_id, tok.pos FROM hits AS h JOIN rt USING (chunk_id) JOIN tok ON tok.pos BETWEEN position - 10 AND position + 10 AND tok.pos // 1024 = h.chunk_id), "
    "k AS (SELECT chunk_id, count(*) AS kept FROM w GROUP BY 1) SELECT chunk_id, n AS whole_tokens, coalesce(kept, n) AS injected_tokens FROM rt LEFT JOIN k USING (chunk_id)"
)
def chunk_refine(spark, d):
    return evaluate.refined(corpus(spark, d), ["edwh", "stsh", "ntth"], ["edwh"])


@query(
    f"{_CHUNKS}, hits AS (SELECT pos AS position, pos // 1024 AS chunk_id FROM tok WHERE token = 'edwh'), w AS (SELECT DISTINCT h.chunk_id, tok.pos FROM hits AS h JOIN rt USING (chunk_id) JOIN tok ON tok.pos BETWEEN position - 10 AND position + 10 AND tok.pos // 1024 = h.chunk_id), "
    "k AS (SELECT chunk_id, count(*) AS kept FROM w GROUP BY 1), z AS (SELECT cast(sum(n) AS bigint) AS w, cast(sum(coalesce(kept, n)) AS bigint) AS i FROM rt LEFT JOIN k USING (chunk_id)) SELECT w AS whole_tokens, i AS injected_tokens, round(1 - i / w, 6) AS saved FROM z"
)
def chunk_totals(spark, d):
    return evaluate.totals(chunk_refine(spark, d)).withColumn("saved", F.round("saved", 6))


@query(f"{S.TOK} SELECT '' AS folder, count(*) AS n_files, cast(sum(token_count) AS bigint) AS n_tokens FROM n")
def folder_totals(spark, d):
    return evaluate.by_folder(corpus(spark, d))


@query(f"{S.TOK} SELECT coalesce(lang, 'none') AS folder, count(*) AS n_files, cast(sum(token_count) AS bigint) AS n_tokens FROM n JOIN documents USING (doc_id) GROUP BY 1")
def folder_tree(spark, d):
    """Files and tokens by top folder, with paths of language, source and id."""
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), "doc_id").alias("path")
    return evaluate.by_folder(Corpus.from_files(table(spark, d, "documents").select("doc_id", "text", path), path="path"))


def _heads(spark, d, n):
    words = table(spark, d, "benchmark").select("item_id", F.slice(X.tokenize(F.col("text")), 1, n).alias("w")).where(F.size("w") == n)
    terms = words.select(F.col("item_id").alias("phrase_id"), F.lit(n).alias("k"), F.posexplode("w").alias("off", "token"))
    return corpus(spark, d).phrases(terms).select(F.col("phrase_id").alias("query_id"), "doc_id")


@query(
    f"{S.TOK}, b AS (SELECT item_id, regexp_extract_all(text, '{S.CORE}') AS w FROM benchmark), t AS (SELECT doc_id, token AS a, lead(token, 1) OVER o AS b, lead(token, 2) OVER o AS c, lead(token, 3) OVER o AS d FROM tok WINDOW o AS (ORDER BY pos)), "
    "tr AS (SELECT DISTINCT item_id, doc_id FROM b JOIN t ON w[1] = a AND w[2] = t.b AND w[3] = c AND w[4] = d WHERE len(w) >= 4), rs AS (SELECT item_id, doc_id FROM b JOIN t ON w[1] = a AND w[2] = t.b WHERE len(w) >= 2), "
    "e AS (SELECT item_id, max((rs.doc_id = tr.doc_id)::int) AS hit FROM tr LEFT JOIN rs USING (item_id) GROUP BY 1), c AS (SELECT item_id, count(*) AS n FROM rs GROUP BY 1) "
    "SELECT avg(coalesce(hit, 0)::double) AS recall, round(avg(coalesce(n, 0)::double), 6) AS mean_results, count(*) AS n_queries FROM e LEFT JOIN c USING (item_id)"
)
def recall_eval(spark, d):
    """How often a search for an item's first two words reaches a document that holds its first four."""
    out = evaluate.recall(_heads(spark, d, 2), _heads(spark, d, 4).distinct())
    return out.withColumn("mean_results", F.round("mean_results", 6))


_Q = f"{S.TOK}, b AS (SELECT item_id AS query_id, regexp_extract_all(text, '{S.CORE}')[1:3] AS q, regexp_extract_all(text, '{S.CORE}')[1:4] AS h FROM benchmark), h4 AS (SELECT query_id, h FROM b WHERE len(h) = 4)"


def _pieces(w: str) -> str:
    return f"string_split(regexp_replace(regexp_replace({w}, '([\\p{{Ll}}])([\\p{{Lu}}])', '\\1_\\2', 'g'), '([\\p{{Lu}}])([\\p{{Lu}}][\\p{{Ll}}])', '\\1_\\2', 'g'), '_')"


@query(
    f"{_Q}, kw AS (SELECT query_id, list_filter(list_transform(flatten(list_transform(list_filter(q, lambda w: strlen(w) > 1 AND NOT list_contains({_STOPS}, lower(w))), lambda w: {_pieces('w')})), lambda x: lower(x)), lambda x: x <> '' AND NOT list_contains({_STOPS}, x)) AS ws FROM b), "
    "c4 AS (SELECT query_id, ws[4 * c + 1 : 4 * c + 4] AS p FROM (SELECT query_id, ws, unnest(range(0, (len(ws) + 3) // 4)) AS c FROM kw)), ph AS (SELECT * FROM c4 UNION SELECT query_id, [w] FROM (SELECT query_id, unnest(ws) AS w FROM kw)), "
    "t4 AS (SELECT pos, doc_id, token AS a, lead(token, 1) OVER o AS b, lead(token, 2) OVER o AS c, lead(token, 3) OVER o AS d FROM tok WINDOW o AS (ORDER BY pos)), "
    "ex AS (SELECT DISTINCT query_id, pos, doc_id FROM ph JOIN t4 ON t4.a = p[1] AND (len(p) < 2 OR t4.b = p[2]) AND (len(p) < 3 OR t4.c = p[3]) AND (len(p) < 4 OR t4.d = p[4])), "
    f"fw AS (SELECT DISTINCT query_id, lower(w) AS w FROM (SELECT query_id, unnest(q) AS w FROM b) WHERE strlen(w) > 1 AND NOT list_contains({_STOPS}, w)), lex AS (SELECT DISTINCT token FROM tok), "
    "bg AS (SELECT DISTINCT query_id, w, substr(hex(encode(w)), 2 * i - 1, 4) AS g FROM (SELECT query_id, w, unnest(range(1, strlen(w))) AS i FROM fw)), lg AS (SELECT DISTINCT token, substr(hex(encode(token)), 2 * i - 1, 4) AS g FROM (SELECT token, unnest(range(1, strlen(token))) AS i FROM lex)), "
    "cd AS (SELECT DISTINCT query_id, w, token, greatest(length(w), length(token)) AS m FROM bg JOIN lg USING (g) WHERE token <> w AND abs(strlen(token) - strlen(w)) <= 1), "
    "ne AS (SELECT DISTINCT query_id, token FROM cd WHERE (left(w, (m - 1) // 2) = left(token, (m - 1) // 2) OR right(w, (m - 1) // 2) = right(token, (m - 1) // 2)) "
    "AND len(list_filter(range(1, m), lambda i: left(w, i) = left(token, i))) + len(list_filter(range(1, m), lambda i: right(w, i) = right(token, i))) >= m - 1), "
    "al AS (SELECT query_id, pos, doc_id, 1 AS e FROM ex UNION ALL SELECT query_id, pos, doc_id, 0 FROM ne JOIN tok USING (token)), r AS (SELECT query_id, pos, doc_id, max(e) AS e FROM al GROUP BY 1, 2, 3), "
    "tr AS (SELECT DISTINCT query_id, doc_id, 1 AS t FROM h4 JOIN t4 ON t4.a = h[1] AND t4.b = h[2] AND t4.c = h[3] AND t4.d = h[4]) "
    "SELECT b.query_id, count(r.pos) AS n_results, cast(coalesce(sum(e), 0) AS bigint) AS n_exact, count(DISTINCT r.doc_id) AS n_files, cast(coalesce(max(t), 0) AS integer) AS hit FROM b LEFT JOIN r USING (query_id) LEFT JOIN tr USING (query_id, doc_id) GROUP BY 1"
)
def question_answers(spark, d):
    """The first three words of every benchmark item as a question, all in one job: results, and whether one lies in a file with the item's first four words."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(X.tokenize(F.col("text")), 1, 3), " ").alias("question"))
    return evaluate.answered(evaluate.found(corpus(spark, d), asked), _heads(spark, d, 4), asked)


@query(f"{S.TOK} SELECT count(*) AS total_tokens, count(DISTINCT token) AS unique_tokens, (SELECT count(*) FROM n) AS n_files, true AS stored FROM tok")
def storage_report(spark, d):
    """What a saved corpus holds and takes."""
    at = scratch.folder(spark)
    store.save(corpus(spark, d), at)
    s = store.storage_stats(spark, at)
    return spark.createDataFrame([(s["total_tokens"], s["unique_tokens"], s["n_files"], s["storage_bytes"] > 0)], "total_tokens long, unique_tokens long, n_files long, stored boolean")


@query(
    f"{S.TOK}, f AS (SELECT DISTINCT pos AS position, round(0.5 * (0.5 + {S.WEIGHT}), 6) AS confidence FROM tok JOIN n USING (doc_id) WHERE {S.ASCII} AND (({S.near('nosuchtoken', 1)}) OR ({S.near('edwhh', 1)}))) SELECT position, confidence FROM f"
)
def hybrid_or_search(spark, d):
    return _round(hybrid.or_search(corpus(spark, d), "where is nosuchtoken edwhh"))
