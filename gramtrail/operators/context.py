"""Context windows, budgets, prompts and messages around hits, and checks of what a model returns."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import fuzzy, hybrid, phrase
from .corpus import RUN, Corpus, settled
from .results import weighed, windows


@dataclass(frozen=True)
class PromptConfig:
    max_context_tokens: int = 100
    min_confidence: float = 0.5
    window: int = 5
    #: Keep at most max_context_tokens positions; by default the integer step may leave up to twice as many.
    strict_budget: bool = False


#: Prompts that users send along with a context.
TASKS = {
    "code_review": "Review the following code for bugs, performance issues, and style violations.",
    "generate_tests": "Generate comprehensive unit tests for the following code.",
    "explain_code": "Explain what this code does in detail.",
    "find_bugs": "Find all bugs and potential issues in the following code.",
    "refactoring": "Refactor the following code to be more readable and efficient.",
}
COMPLETION = "Answer the query from the passages between the context marks."
CHAT = "Below are passages of an indexed corpus, each with the position where it was found. Answer from these passages alone, and say so if they do not hold the answer."
EVENTS = "query string, seq long, valid boolean"
#: What a model is asked to do, by kind of task.
TEMPLATES = {
    "refactoring": "Restructure the code parts that follow as the query asks. What they do must stay the same.",
    "bugfind": "Look through the code parts that follow and list every mistake in them.",
    "docs": "Write documentation for the code parts that follow.",
}


def task_template(name: str) -> str:
    """A prompt with places for context and query."""
    return f"\n{TEMPLATES[name]}\n\nContext:\n{{{{.Context}}}}\n\nQuery: {{{{.Prompt}}}}\n"


def relevant_positions(corpus: Corpus, hits: DataFrame, config: PromptConfig = PromptConfig()) -> DataFrame:
    """pos and token within the window of any hit; over budget only every nth is kept, n = positions div budget.

    Windows are numbered from the hits alone, which go to the runs of positions that they meet; only the tokens of what is kept are looked up.
    """
    low, high = F.greatest(F.col("position") - config.window, F.lit(0)), F.col("position") + config.window
    at = hits.select(low.alias("__low"), high.alias("__high"))
    if corpus.filed:  # positions run through all files, so that their end says which there are
        at = at.crossJoin(F.broadcast(corpus.files.agg(F.max("token_end").alias("__end")))).select("__low", F.least(F.col("__high"), F.col("__end") - 1).alias("__high")).where("__low <= __high")  # one row
    else:
        found = corpus.looked_up(*settled(at.select(F.explode(F.sequence("__low", "__high")).alias("pos")).distinct()))
        at = found.select(F.col("pos").alias("__low"), F.col("pos").alias("__high"))
    spread = at.withColumn("__run", F.explode(F.sequence(F.floor(F.col("__low") / RUN), F.floor(F.col("__high") / RUN)))).repartition("__run")
    inside = F.sequence(F.greatest(F.col("__low"), F.col("__run") * RUN), F.least(F.col("__high"), F.col("__run") * RUN + (RUN - 1)))
    places = spread.select("__run", F.explode(inside).alias("pos")).distinct()
    totals = places.groupBy("__run").agg(F.count("*").alias("__k"))  # a row for each 65,536 positions
    every = Window.orderBy("__run")
    before = F.coalesce(F.sum("__k").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("__run", before.alias("__start"), F.sum("__k").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__n"))
    over = F.ceil(F.col("__n") / config.max_context_tokens) if config.strict_budget else F.floor(F.col("__n") / config.max_context_tokens)
    number = F.row_number().over(Window.partitionBy("__run").orderBy("pos")) - 1
    ranked = places.withColumn("__i", number).join(totals, "__run")
    kept = ranked.where((F.col("__start") + F.col("__i")) % F.greatest(over, F.lit(1)) == 0).select("pos")
    return corpus.looked_up(*settled(kept)).select("pos", "token")


def prompt_tokens(corpus: Corpus, question: str, kept: DataFrame) -> DataFrame:
    """One row: the prompt's tokens, markers included, and how much shorter it is than the corpus."""
    body = kept.agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("b"))  # within the budget
    marked = F.flatten(F.transform("b", lambda t: F.array(F.format_string("[%d]", t["pos"]), t["token"])))
    inner = F.when(F.size("b") > 0, marked).otherwise(F.array(F.lit("(no relevant context found)")))
    tokens = F.concat(F.array(F.lit("<context>")), inner, F.array(F.lit("</context>"), F.lit("<query>"), F.lit(question), F.lit("</query>")))
    total = corpus.files.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("original_token_count")) if corpus.filed else corpus.tokens.agg(F.count("*").alias("original_token_count"))
    out = body.select(tokens.alias("prompt_tokens")).crossJoin(total)  # two single rows
    n = F.size("prompt_tokens")
    return out.select("prompt_tokens", "original_token_count", n.cast("long").alias("filtered_token_count"), F.when(F.col("original_token_count") > 0, (1 - n / F.col("original_token_count")) * 100.0).otherwise(F.lit(0.0)).alias("reduction_percent"))


def prompt_hits(corpus: Corpus, question: str, phrases: list[list[str]], config: PromptConfig = PromptConfig()) -> DataFrame:
    """Hits of the phrases, and of the whole question as one mistyped token, of enough confidence."""
    exact = [phrase.positions(corpus, p).withColumn("dist", F.lit(0)) for p in phrases if p]
    near = fuzzy.hits(corpus, question, 2).drop("token")
    found = weighed(corpus, reduce(DataFrame.unionByName, [*exact, near]), 1.0 - F.col("dist") / 3.0)
    return found.where(F.col("confidence") >= config.min_confidence).select("position", "confidence")


def build_prompt(corpus: Corpus, question: str, phrases: list[list[str]], config: PromptConfig = PromptConfig()) -> DataFrame:
    return prompt_tokens(corpus, question, relevant_positions(corpus, prompt_hits(corpus, question, phrases, config), config))


def budgeted(hits: DataFrame, max_tokens: int, each: int = 31) -> DataFrame:
    """The best hits whose windows of so many tokens fit the budget, with their rank."""
    order = Window.orderBy(F.desc("confidence"), "position")
    best = hits.orderBy(F.desc("confidence"), "position").limit(max(max_tokens // each, 0))  # so the window has few rows
    return best.withColumn("rank", F.row_number().over(order))


def snippets(corpus: Corpus, hits: DataFrame, before: int = 15, after: int = 15) -> DataFrame:
    """The hits with the text around them as snippet."""
    return windows(corpus, hits, before, after, "snippet").where("snippet <> ''")


def context_checks(hits: DataFrame) -> DataFrame:
    """One row: whether snippets are cut or their braces unbalanced, and the issues, of hits(position, snippet)."""
    cut = F.col("snippet").contains("�") | F.col("snippet").endswith("...")
    row = hits.agg(
        F.coalesce(F.sum(X.count_of(F.col("snippet"), "{") - X.count_of(F.col("snippet"), "}")), F.lit(0)).alias("b"),
        F.coalesce(F.bool_or(cut), F.lit(False)).alias("c"),
        F.sort_array(F.collect_list(F.when(cut, F.format_string("Truncated token at position %d", "position")))).alias("i"),  # of one context
    )
    braces = F.when(F.col("b") != 0, F.array(F.format_string("Unbalanced braces: %d open, %d close", F.greatest("b", F.lit(0)), F.greatest(-F.col("b"), F.lit(0))))).otherwise(F.array().cast("array<string>"))
    return row.select(F.lit(True).alias("token_boundary_safe"), (F.col("b") == 0).alias("balanced_braces"), (~F.col("c")).alias("no_truncated_tokens"), F.concat("i", braces).alias("issues"))


def _joined(marked: DataFrame, order: list, out: str) -> DataFrame:
    return marked.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda r: r["line"]), "\n").alias(out))


def completion_prompt(corpus: Corpus, question: str, phrases: list[list[str]]) -> DataFrame:
    """One row: a completion prompt with ten tokens around each phrase hit."""
    hits = reduce(DataFrame.unionByName, [phrase.positions(corpus, p) for p in phrases]).select("position")
    hits, few = settled(hits)
    lines = windows(corpus, hits.distinct(), 10, 10, "snippet", few).select("position", F.format_string("  [POS %d] %s", "position", "snippet").alias("line"))
    body = _joined(hits.join(lines, "position"), ["position"], "body")
    head = f"{COMPLETION}\n\n<context>\n"
    context = F.when(F.col("body") == "", F.lit("")).otherwise(F.concat("body", F.lit("\n")))
    return body.select(F.concat(F.lit(head), context, F.lit(f"</context>\n\n\nQuery: {question}\nAnswer:")).alias("prompt"))


def template_text(phrases: list[list[str]]) -> str:
    """A prompt template with a conditional line for each phrase."""
    names = [" ".join(p) for p in phrases]
    blocks = "".join(f"\n  {{{{- if .Context.{n} }}}}\n  [MATCH: {n}] {{{{ .Context.{n} }}}}\n  {{{{ end }}}}" for n in names)
    return "{{- if .System }}{{ .System }}\n{{ end }}\n{{- if .Prompt }}\n<context>" + blocks + "\n</context>\n{{ .Prompt }}\n{{ end }}"


def chat_messages(corpus: Corpus, question: str, phrases: list[list[str]], max_tokens: int = 4096) -> DataFrame:
    """Two rows (ord, role, content): the retrieved context as system message, and the question."""
    found = [hybrid.documented(corpus, question, 5).select("position", "confidence")] if hybrid.candidates(corpus, question, 1).take(1) else []
    found += [weighed(corpus, phrase.positions(corpus, p), F.lit(1.0)).select("position", "confidence") for p in phrases if p]
    hits = reduce(DataFrame.unionByName, found) if found else corpus.tokens.limit(0).select(F.col("pos").alias("position"), F.lit(0.0).alias("confidence"))
    best = budgeted(hits.where("confidence >= 0.5"), max_tokens)
    lines = snippets(corpus, best).select("rank", "confidence", F.format_string("  [POS %d] %s", "position", "snippet").alias("line"))
    row = _joined(lines, ["rank"], "body").crossJoin(best.agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean")))  # two single rows
    text = F.when(F.col("body") == "", F.lit("(nothing was found)")).otherwise(F.col("body"))
    system = F.concat(
        F.lit(f"{CHAT}\n\n--- Passages, on average "), F.round(F.col("mean") * 100).cast("int").cast("string"), F.lit(" of 100 sure ---\n"), text, F.lit("\n--- End of passages ---"),
    )
    ask = F.lit(f"The question about these passages is:\n\n{question}")
    both = F.array(F.struct(F.lit(1).alias("ord"), F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit(2).alias("ord"), F.lit("user").alias("role"), ask.alias("content")))
    return row.select(F.inline(both))


def request_json(messages: DataFrame, model: str = "local", max_tokens: int = 512, temperature: float = 0.7) -> DataFrame:
    """One row: the body of a chat request. The caller sends it."""
    ordered = messages.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    return ordered.select(F.to_json(F.struct(F.lit(model).alias("model"), F.col("messages"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).alias("temperature"))).alias("request"))


def validated(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows with syntax_valid, issues and confidence_adjustment."""
    return texts.withColumns(X.validation(F.col(text)))


def feedback(events: DataFrame, last: int = 10) -> DataFrame:
    """query and its success over the last events(query, seq, valid)."""
    order = Window.partitionBy("query").orderBy(F.desc("seq"))
    recent = events.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= last)
    return recent.groupBy("query").agg(F.avg(F.col("valid").cast("double")).alias("confidence"), F.count("*").alias("n"))


def ask(corpus: Corpus, question: str, phrases: list[list[str]], send, max_tokens: int = 4096, log: str | None = None) -> dict:
    """Build the messages, let send(request) answer, check the answer, and note in the folder log how it went.

    With a log, the result also has the question's confidence: the share of valid answers among its last ten.
    """
    request = request_json(chat_messages(corpus, question, phrases, max_tokens)).first()["request"]
    answer = send(request)
    row = validated(corpus.spark.createDataFrame([(answer,)], "text string")).first()
    out = {"answer": answer, "syntax_valid": row["syntax_valid"], "issues": row["issues"], "confidence_adjustment": row["confidence_adjustment"]}
    if log is not None:
        out["confidence"] = noted(corpus.spark, log, question, row["syntax_valid"])
    return out


def noted(spark: SparkSession, log: str, question: str, valid: bool) -> float:
    """Append an event to the folder log, and give the question's confidence after it."""
    spark.createDataFrame([(question, time.time_ns(), valid)], EVENTS).coalesce(1).write.mode("append").parquet(log)
    events = spark.read.schema(EVENTS).parquet(log).where(F.col("query") == question)
    return feedback(events).first()["confidence"]
