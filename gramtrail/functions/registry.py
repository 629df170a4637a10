"""SQL functions of the engine: register(spark) makes them callable from SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..plans import questions
from . import code_lexer
from .text import CAMEL, TOKENS


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


class PhrasePositions:
    """Table function: places, counted in tokens from 0, at which a phrase begins in a text."""

    def eval(self, text: str, phrase: str) -> Iterator[tuple[int]]:
        tokens, wanted = questions.core_tokens(text or ""), questions.core_tokens(phrase or "")
        if wanted:
            for i in range(len(tokens) - len(wanted) + 1):
                if tokens[i : i + len(wanted)] == wanted:
                    yield (i,)


def fnv_bytes(values: pa.Array) -> pa.Array:
    """FNV-1a of each text, for long texts."""

    def one(text):
        if text is None:
            return None
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        return f"{h:016x}"

    return pa.array([one(x) for x in values.to_pylist()], pa.string())


def register(spark: SparkSession) -> None:
    """Functions tokenize, split_words, levenshtein_within, fnv1a64, lex_code, parse_query and split_identifier, and table function phrase_positions."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION tokenize(x STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(coalesce(x, ''), {_quoted(TOKENS['core'])}, 0)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION split_words(x STRING) RETURNS ARRAY<STRING> RETURN transform(flatten(transform(split(x, '[_-]'), p -> split(p, {_quoted(CAMEL)}))), w -> lower(w))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION levenshtein_within(a STRING, b STRING, d INT) RETURNS BOOLEAN RETURN levenshtein(a, b, d) >= 0")
    spark.udf.register("fnv1a64", F.arrow_udf(fnv_bytes, "string"))
    spark.udf.register("lex_code", F.arrow_udf(lambda x: pa.array([code_lexer.lex(t or "") for t in x.to_pylist()], pa.list_(pa.string())), "array<string>"))
    spark.udf.register("parse_query", F.arrow_udf(lambda x: pa.array([questions.parse(t or "") for t in x.to_pylist()], pa.list_(pa.list_(pa.string()))), "array<array<string>>"))
    spark.udf.register("split_identifier", F.arrow_udf(lambda x: pa.array([questions.split_identifier(t or "") for t in pc.fill_null(x, "").to_pylist()], pa.list_(pa.string())), "array<string>"))
    spark.udtf.register("phrase_positions", F.udtf(PhrasePositions, returnType="position: int"))
