"""DuckDB SQL for the queries of the catalogue, built on the same tables."""

from __future__ import annotations

CORE, AGENT = r"[\p{L}\p{N}]+", "[a-zA-Z0-9_]+"


def tokens(pattern: str = CORE, fold: bool = False, docs: str = "documents") -> str:
    """Tables ln (doc_id, line_no, line), tok (token, pos, doc_id, line_no), n (token counts) and fr (file ranges)."""
    token = "lower(token)" if fold else "token"
    return f"""WITH ln AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM {docs}),
lt AS (SELECT doc_id, line_no, regexp_extract_all(line, '{pattern}') AS w FROM ln),
t0 AS (SELECT doc_id, line_no, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM lt),
tok AS MATERIALIZED (SELECT doc_id, line_no, {token} AS token, row_number() OVER (ORDER BY doc_id, line_no, i) - 1 AS pos FROM t0),
n AS (SELECT d.doc_id, count(tok.pos) AS token_count FROM {docs} AS d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id),
fr AS (SELECT doc_id, token_count, cast(coalesce(sum(token_count) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS token_start FROM n)"""


TOK, AG = tokens(), tokens(AGENT, True)


def phrase(words: list[str], name: str = "hits", inside: bool = False) -> str:
    """A table of position, doc_id and line_no of a phrase."""
    joins = "".join(f" JOIN tok AS t{i} ON t{i}.pos = t0.pos + {i} AND t{i}.token = '{w}'" + (f" AND t{i}.doc_id = t0.doc_id" if inside else "") for i, w in enumerate(words) if i)
    return f"{name} AS (SELECT t0.pos AS position, t0.doc_id, t0.line_no FROM tok AS t0{joins} WHERE t0.token = '{words[0]}')"


def bold(words: list[str]) -> str:
    """The line with the first needle that it holds in bold."""
    cases = " ".join(f"WHEN instr(line, '{w}') > 0 THEN substr(line, 1, instr(line, '{w}') - 1) || '**{w}**' || substr(line, instr(line, '{w}') + {len(w)})" for w in words)
    return f"CASE WHEN line = '' THEN '' {cases} ELSE line END"


def near(word: str, distance: int, least: int = 1, prefilter: bool = True) -> str:
    """The condition that an ASCII token is a neighbour of a word."""
    pairs = " OR ".join(f"contains(token, '{word[i : i + 2]}')" for i in range(len(word) - 1))
    test = f"abs(strlen(token) - {len(word)}) <= {distance} AND levenshtein(token, '{word}') BETWEEN {least} AND {distance}"
    return f"{test} AND ({pairs})" if prefilter else test


ASCII = "strlen(token) = length(token)"
WEIGHT = "CASE WHEN token_count > 0 THEN log10(token_count) * 0.01 ELSE 0 END"


def confidence(words: list[str], inside: bool = False) -> str:
    return f"{TOK}, {phrase(words, inside=inside)} SELECT position, doc_id, cast(line_no AS integer) AS line_no, round(1.0 + {WEIGHT}, 6) AS confidence FROM hits JOIN n USING (doc_id)"


def bm25(words: list[str], k: int, variant: str) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    f, once = ("cf", "tf * ") if variant == "reference" else ("df", "")
    return f"""tf AS (SELECT token, doc_id, count(*) AS tf FROM tok WHERE token IN ({listed}) GROUP BY 1, 2),
cd AS (SELECT token, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY 1), sz AS (SELECT count(*) AS nd, avg(token_count) AS avgdl FROM n),
sc AS (SELECT doc_id, sum({once}CASE WHEN 2 * {f} < nd THEN ln((nd - {f} + 0.5) / ({f} + 0.5)) ELSE 0 END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * token_count / avgdl))) AS score
  FROM tf JOIN cd USING (token) JOIN n USING (doc_id), sz GROUP BY doc_id),
best AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= {k})"""
