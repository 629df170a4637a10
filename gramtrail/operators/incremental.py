"""Keeping a corpus up to date by content hash: the result equals a rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import FILES, Corpus, bounded, counted, local_tokens, placed, ranges_of


def changes(corpus: Corpus, incoming: DataFrame, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """doc_id and status (added, changed, same) of incoming files, by SHA-256 of the content."""
    old = corpus.files.select("doc_id", F.sha2("content", 256).alias("__old"))
    new = incoming.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("__new"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__old") != F.col("__new"), "changed").otherwise("same")
    return new.join(old, "doc_id", "left").select("doc_id", status.alias("status"))


def update(corpus: Corpus, incoming: DataFrame, doc_id: str = "doc_id", content: str = "text", path: str | None = None) -> Corpus:
    """A corpus with changed files replaced and new ones added; only their tokens are made anew.

    Token rows keep their place within the file; where a file starts is a row of the file, so that what comes after a change moves by a join with the files
    that a search asks about. Pairs of words within a file stay as they are.
    """
    moved = bounded(changes(corpus, incoming, doc_id, content).where("status <> 'same'").select("doc_id"))  # contents are compared once
    p = F.col(path) if path else F.col(doc_id).cast("string")
    fresh = incoming.select(F.col(doc_id).cast("long").alias("doc_id"), p.alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content")).join(moved, "doc_id", "left_semi")
    base = corpus.files.select("doc_id", "path", "content").join(moved, "doc_id", "left_anti").unionByName(fresh)
    kept = corpus.files.select("doc_id", "token_count", "first").join(moved, "doc_id", "left_anti")
    ranges = ranges_of(kept.unionByName(counted(fresh, corpus.kind)))
    files = base.join(ranges, "doc_id").select(*FILES.fieldNames())
    old = corpus.paired.select("token", "doc_id", "local_pos", "line_no", "next").join(moved, "doc_id", "left_anti")
    return Corpus(files, placed(old.unionByName(local_tokens(fresh, corpus.kind)), ranges, ["doc_id"]), corpus.kind, filed=corpus.filed)
