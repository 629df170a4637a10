"""Column builders: tokenisers, identifier splitting, bigrams, highlighting, hashes and text checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, by tokeniser.
TOKENS = {
    "core": r"[\p{IsAlphabetic}\p{N}]+",
    "line": r"[\p{IsAlphabetic}\p{N}_]+",
    "query": r"[\p{IsAlphabetic}\p{N}.'_]+",
    "agent": "[a-zA-Z0-9_]+",
    "space": r"\S+",
    "code": r"[\p{IsAlphabetic}\p{N}_:<>]+",
}

#: Words that a question may hold without meaning.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "get got had has have having he her here hers herself him himself his how i if in into is it its itself let's me might more most my myself nor not of off on once only or other ought our ours "
    "ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when "
    "where which while who whom why will with would you your yours yourself yourselves"
).split()

#: The agent tools' own list.
AGENT_STOP_WORDS = "where is the how does what when why to of in for with on at by".split()

#: Where a camel-case word falls apart.
CAMEL = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})"


def tokenize(text: Column, kind: str = "core") -> Column:
    """Tokens of a text in order; the agent kind is lower-cased."""
    out = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS[kind]), F.lit(0))
    return F.transform(out, F.lower) if kind == "agent" else out


def lines(text: Column) -> Column:
    """Lines of a text; one more after a trailing line end."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def tokens_with_lines(text: Column, kind: str = "core") -> Column:
    """Tokens with their line numbers, counted from 1, in one pass over the lines."""
    return F.flatten(F.transform(lines(text), lambda line, i: F.transform(tokenize(line, kind), lambda t: F.struct(t.alias("token"), (i + 1).alias("line_no")))))


def line_at(text: Column, line_no: Column) -> Column:
    """A line by its number from 1; nothing outside."""
    return F.coalesce(F.get(lines(text), (line_no - 1).cast("int")), F.lit(""))


def line_offsets(text: Column) -> Column:
    """Byte places at which lines begin: 0 and those after line ends, in one pass over the bytes."""
    own, n = F.encode(text, "utf-8"), F.octet_length(text)
    ends = F.when(n > 0, F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(own, i, F.lit(1)) == F.lit(bytearray(b"\n")))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), ends)


def bigrams(token: Column) -> Column:
    """Overlapping pairs of bytes, as hexadecimal."""
    n = F.octet_length(token)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.substring(F.hex(F.encode(token, "utf-8")), 2 * i + 1, F.lit(4)))).otherwise(F.array().cast("array<string>"))


def split_identifier(word: Column) -> Column:
    """Lower-cased parts of an identifier: paths at ::, generics at < > and commas, then snake, kebab and camel case."""
    generic = F.filter(F.split(F.regexp_replace(word, "[<>]", " "), r"[,\s]+"), lambda p: p != "")
    parts = F.when(word.contains("::"), F.filter(F.split(word, "::"), lambda p: p != "")).when(word.rlike("[<>]"), generic).otherwise(F.array(word))
    pieces = F.flatten(F.transform(parts, lambda p: F.split(p, "[_-]")))
    cut = F.flatten(F.transform(pieces, lambda p: F.split(p, CAMEL)))
    return F.transform(F.filter(cut, lambda p: p != ""), F.lower)


def search_words(question: Column) -> Column:
    """Words of a question: without stop words and single bytes, identifiers in parts."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    kept = F.filter(tokenize(question, "query"), lambda w: ~F.array_contains(stop, F.lower(w)) & (F.octet_length(w) > 1))
    return F.filter(F.flatten(F.transform(kept, split_identifier)), lambda w: ~F.array_contains(stop, w))


def search_phrases(question: Column) -> Column:
    """Phrases of a question: runs of up to four words, then each word; one of one word alone is given once more."""
    words = search_words(question)
    n = F.size(words)
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / 4).cast("int")), lambda i: F.slice(words, i * 4 + 1, F.lit(4)))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(runs, F.transform(words, lambda w: F.array(w)))


def highlight(line: Column, needles: list[Column]) -> Column:
    """The line with the first occurrence of the first needle that it holds in bold."""

    out = line
    for needle in reversed(needles):
        at = F.call_function("instr", line, needle)
        out = F.when((at > 0) & (F.length(needle) > 0), F.concat(F.substring(line, F.lit(1), at - 1), F.lit("**"), needle, F.lit("**"), F.substring(line, at + F.length(needle), F.length(line)))).otherwise(out)
    return F.when(line == "", F.lit("")).otherwise(out)


def file_weight(tokens: Column) -> Column:
    """What a file's length adds to a confidence."""
    return F.when(tokens > 0, F.log10(tokens) * 0.01).otherwise(F.lit(0.0))


def count_of(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def validation(text: Column) -> dict[str, Column]:
    """Checks of generated code: syntax_valid, issues and confidence_adjustment."""
    braces, parens = count_of(text, "{") - count_of(text, "}"), count_of(text, "(") - count_of(text, ")")
    cut = text.endswith("...") | text.contains("�")
    last = F.trim(F.regexp_extract(F.regexp_replace(text, r"\r?\n\z", ""), r"([^\n]*)\z", 1), F.lit(" \t\r\n"))
    open_end = (text != "") & (last != "") & ~last.rlike("[;{},]$")
    issues = [
        F.when(braces != 0, F.format_string("Unbalanced braces: %d difference", braces)),
        F.when(parens != 0, F.format_string("Unbalanced parentheses: %d difference", parens)),
        F.when(cut, F.lit("Output appears truncated")),
        F.when(open_end, F.lit("Last line may be missing terminator")),
    ]
    # Hundredths stay exact until the last step.
    less = F.when(braces != 0, 20).otherwise(0) + F.when(parens != 0, 15).otherwise(0) + F.when(cut, 10).otherwise(0) + F.when(open_end, 5).otherwise(0)
    return {"syntax_valid": (braces == 0) & (parens == 0), "issues": F.array_compact(F.array(*issues)), "confidence_adjustment": -F.least(less, F.lit(50)) / 100.0}


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes, as 16 hexadecimal digits; two halves, as long arithmetic must not overflow."""
    n = F.octet_length(text)
    codes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(F.hex(F.encode(text, "utf-8")), 2 * i + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    mask = (1 << 32) - 1

    def step(acc: Column, b: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(b)
        p = lo * 0x1B3
        hi = (acc["hi"] * 0x1B3 + F.shiftright(p, 32) + F.shiftleft(lo, 8)).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), p.bitwiseAND(mask).alias("lo"))

    out = F.aggregate(codes, start, step)
    return F.lower(F.concat(F.lpad(F.hex(out["hi"]), 8, "0"), F.lpad(F.hex(out["lo"]), 8, "0")))


def saved(original: Column, kept: Column) -> dict[str, Column]:
    """Tokens saved by a shorter context, in all and in per cent."""
    gain = F.greatest(original - kept, F.lit(0))
    return {"saved_tokens": gain.cast("long"), "savings_percent": F.when(original > 0, gain / original * 100.0).otherwise(F.lit(0.0))}


def kv_saved_mb(original: Column, kept: Column) -> Column:
    """Key-value cache saved, with 32 layers of 4096 half-precision keys and values a token; may be negative."""
    return (original - kept) * 32 * 16384 / float(1 << 20)
