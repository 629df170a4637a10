"""Saving a corpus as Parquet tables under numbered manifests, and changing it without writing it all again.

A folder of a stored corpus is never changed once it is written; a manifest names the folders of one state, and the manifest with the greatest number
is the state that is read. A writer puts a manifest with the next number in place in one step, which fails if another was faster, so that no
writer's data is lost, and whoever reads an older state goes on reading it until vacuum() takes its folders away.

Token rows are clustered by token and hold their place within their file and the generation of that file. Which generation of a file is
alive, and where its tokens start, is a row of the file in the table live. So an update writes the tokens of the changed files and
the narrow table live; the tokens of all other files stay where they are, and a search joins the rows that it finds with live. Files that only follow
those that are there are appended with their own rows of live.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import warnings
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.corpus import FILES, TOKEN_ROWS, Corpus, counted, local_tokens, placed, ranges_of, with_next
from . import files as source

VERSION = 6
#: Positions of a page of the layout by position, and of how many pages a search may ask by range.
PAGE, MOST_RUNS = 4096, 200
#: How tokens are written: numbers as differences, which are small in their order.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
#: How often a change is tried again when other writers were faster.
TRIES = 8


class Conflict(RuntimeError):
    """Another writer changed the corpus meanwhile; nothing of it is lost, and nothing of this change is in place."""


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*p) for p in pairs])


_L, _S, _I = T.LongType(), T.StringType(), T.IntegerType()
TOKENS = _fields(("token", _S), ("doc_id", _L), ("gen", _L), ("local_pos", _I), ("line_no", _I), ("next", _S))
CONTENTS = _fields(("doc_id", _L), ("gen", _L), ("path", _S), ("content", _S))
LIVE = _fields(("doc_id", _L), ("gen", _L), ("token_start", _L), ("token_end", _L), ("token_count", _L), ("first", _S), ("after", _S), ("sha", _S))
LOOSE = _fields(("token", _S), ("pos", _L))
LEXICON = _fields(("token", _S), ("freq", _L), ("n_docs", _L))
PAIRS, COUNTS = _fields(("pair", _S), ("token", _S)), _fields(("pair", _S), ("n", _L))
SEQUENCE = _fields(("pos", _L), ("token", _S))
KEY = ["doc_id", "gen"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(corpus: Corpus) -> str:
    """A value that any change of the tokens, their lines, or the files and their contents changes, whatever the order of rows."""
    total = lambda rows, *cols: rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    tokens, files = total(corpus.tokens, "token", "pos", "doc_id", "line_no"), total(corpus.files, "doc_id", "path", F.sha2("content", 256))
    return f"{corpus.kind}:{tokens['n']}:{tokens['h']}:{files['n']}:{files['h']}"


# Manifests


def _numbered(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted((int(m.group(1)), n) for n in names if (m := re.fullmatch(r"m-(\d{10})\.json", n)))


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The state that is read; None where no corpus is, and nothing in it where it cannot be read."""
    known = _numbered(spark, path)
    for name in [known[-1][1]] if known else ["manifest.json", "manifest"]:  # the last two are those of versions before 6
        fs, p = _fs(spark, f"{path}/{name}")
        if fs.exists(p):
            try:
                return json.loads("".join(r[0] for r in spark.read.text(f"{path}/{name}", wholetext=True).collect()))  # one small file
            except Exception as error:  # whatever is wrong with the file, the corpus counts as unreadable
                warnings.warn(f"{path}: unreadable manifest ({type(error).__name__}); starting empty", stacklevel=2)
                return {}
    return None


def _number(spark: SparkSession, path: str) -> int:
    known = _numbered(spark, path)
    return known[-1][0] if known else 0


def _switch(spark: SparkSession, path: str, body: dict, number: int) -> None:
    """Put the manifest of that number in place in one step; Conflict if there is one."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs, new = _fs(spark, f"{path}/tmp-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(body | {"number": number}).encode()))
    out.close()
    try:
        jvm.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).rename(new, jvm.Path(f"{path}/m-{number:010d}.json"), spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0))
    except Exception as error:
        fs.delete(new, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"{path}: state {number} was written by another meanwhile") from None
        raise


def _current(spark: SparkSession, path: str) -> dict:
    """The manifest of a corpus of this version, which an older one is written as first; an empty corpus where there is none."""
    m = manifest(spark, path)
    if m and m.get("version") == VERSION:
        return m
    save(load(spark, path), path)
    return manifest(spark, path)


def _changed(spark: SparkSession, path: str, change: Callable[[dict], dict | None]) -> Corpus:
    """Load the corpus after a change of its manifest, made anew when another writer was faster."""
    for k in range(TRIES):
        m = _current(spark, path)
        after = change(m)
        if not after:
            break
        try:
            _switch(spark, path, after, m["number"] + 1)
            break
        except Conflict:
            if k == TRIES - 1:
                raise
    return load(spark, path)


# Writing


def _folder(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def _write_tokens(rows: DataFrame, path: str, parts: int | None = None) -> str:
    at = _folder("tokens")
    rows = rows.select(*TOKENS.fieldNames())
    # Without a number of files each task sorts its own rows: a reader skips row groups in every file, and no token is shuffled.
    rows = rows.repartition(parts, "token") if parts else rows
    rows.sortWithinPartitions("token", "doc_id", "local_pos").write.options(**PACKED).parquet(f"{path}/{at}")
    return at


def _write(rows: DataFrame, path: str, kind: str, schema: T.StructType) -> str:
    at = _folder(kind)
    rows.select(*schema.fieldNames()).write.parquet(f"{path}/{at}")
    return at


def is_dirty(corpus: Corpus, path: str) -> bool:
    """Whether the corpus differs from what is stored."""
    there = manifest(corpus.spark, path) or {}
    return (there.get("fingerprint") or fingerprint(load(corpus.spark, path))) != fingerprint(corpus)


def save(corpus: Corpus, path: str, parts: int | None = None, layouts: bool = False) -> bool:
    """Write a corpus whole; nothing is written if the same is there. layouts also writes the lexicon with its byte pairs, and the tokens by position."""
    spark, own, number = corpus.spark, fingerprint(corpus), _number(corpus.spark, path)
    there = manifest(spark, path)
    if there and there.get("version") == VERSION and there.get("fingerprint") == own and not (layouts and not there.get("layouts")):
        return False
    _switch(spark, path, _whole(corpus, path, own, parts, layouts), number + 1)
    return True


def _whole(corpus: Corpus, path: str, own: str | None, parts: int | None = None, layouts: bool = False) -> dict:
    """The manifest of a corpus written anew."""
    spark = corpus.spark
    gen = F.lit(0).cast("long").alias("gen")
    filed = corpus.tokens.where("doc_id is not null")
    if "next" not in filed.columns:
        filed = filed.withColumn("next", F.lead("token").over(Window.partitionBy("doc_id").orderBy("local_pos")))
    tokens = _write_tokens(filed.select("token", "doc_id", gen, "local_pos", "line_no", "next"), path, parts)
    contents = _write(corpus.files.withColumn("gen", gen), path, "contents", CONTENTS)
    ranges = ranges_of(corpus.files.select("doc_id", "token_count", "first", F.sha2("content", 256).alias("sha"))).withColumn("gen", gen)
    live = _write(ranges, path, "live", LIVE)
    out = {"version": VERSION, "kind": corpus.kind, "fingerprint": own, "tokens": [tokens], "contents": [contents], "live": [live], "loose": [], "loose_first": None, "borders": [], "layouts": None}
    out |= _ends(spark, path, out)
    loose = corpus.tokens.where("doc_id is null").select("token", (F.col("pos") - out["total"]).alias("pos"))
    n = loose.count()
    if n:
        out |= {"loose": [{"folder": _write(loose, path, "loose", LOOSE), "start": 0, "count": n}], "loose_first": loose.where("pos = 0").first()["token"]}
    if layouts:
        out["layouts"] = _layouts(corpus if corpus.filed else _loaded(spark, path, out), path)  # where all tokens lie in files the stored positions are these
    return out


def _ends(spark: SparkSession, path: str, m: dict) -> dict:
    """The count of tokens in files, the greatest id, and the last file that has tokens."""
    row = _live(spark, path, m).agg(F.coalesce(F.max("token_end"), F.lit(0)).alias("total"), F.coalesce(F.max("doc_id"), F.lit(-1)).alias("last_doc"), F.max(F.when(F.col("token_count") > 0, F.col("doc_id"))).alias("last_filled")).first()
    return row.asDict()


def _layouts(corpus: Corpus, path: str) -> dict:
    """The lexicon, its byte pairs clustered by pair, and the tokens clustered by position."""
    lexicon = _write(corpus.lexicon.sort("token"), path, "lexicon", LEXICON)
    words = corpus.spark.read.schema(LEXICON).parquet(f"{path}/{lexicon}")
    pairs = words.select(F.explode(F.array_distinct(X.bigrams(F.col("token")))).alias("pair"), "token")
    at, rest = _folder("pairs"), _folder("sequence")
    pairs.repartition("pair").sortWithinPartitions("pair", "token").write.parquet(f"{path}/{at}")
    _by_position(corpus).write.options(**PACKED).option("parquet.page.row.count.limit", str(PAGE)).parquet(f"{path}/{rest}")
    stored = corpus.spark.read.schema(PAIRS).parquet(f"{path}/{at}")
    counts = _write(stored.groupBy("pair").agg(F.count("*").alias("n")).coalesce(1), path, "counts", COUNTS)  # at most 65,536 rows
    return {"lexicon": lexicon, "pairs": at, "counts": counts, "sequence": rest}


def _by_position(corpus: Corpus) -> DataFrame:
    """pos and token in ranges of positions, each in order: texts are dealt and sorted where all tokens come from them, and cut into tokens afterwards."""
    if not corpus.filed:
        return corpus.tokens.select("pos", "token").repartitionByRange("pos").sortWithinPartitions("pos")
    texts = corpus.files.where("token_count > 0").select("token_start", "content").repartitionByRange("token_start").sortWithinPartitions("token_start")
    return texts.select("token_start", F.posexplode(X.tokenize(F.col("content"), corpus.kind)).alias("i", "token")).select((F.col("token_start") + F.col("i")).alias("pos"), "token")


def _incoming(spark: SparkSession, path: str, rows: DataFrame, kind: str, gen: int, doc_id: str, content: str, file: str | None) -> tuple[str, str, DataFrame]:
    """Folders of the contents and tokens of some files, and their counts; the contents are written first, and read for the rest."""
    p = F.col(file) if file else F.col(doc_id).cast("string")
    own = rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(gen).cast("long").alias("gen"), p.alias("path"), F.coalesce(F.col(content), F.lit("")).alias("content"))
    contents = _write(own, path, "contents", CONTENTS)
    back = spark.read.schema(CONTENTS).parquet(f"{path}/{contents}")
    tokens = _write_tokens(local_tokens(back, kind, "gen"), path)
    counts = counted(back.withColumn("sha", F.sha2("content", 256)), kind, "gen", "sha")
    return contents, tokens, counts


def update(spark: SparkSession, path: str, incoming: DataFrame, doc_id: str = "doc_id", content: str = "text", file: str | None = None) -> Corpus:
    """The stored corpus with changed files replaced and new ones added, by content hash: their tokens are written, and the table live."""

    def change(m: dict) -> dict | None:
        old = _live(spark, path, m)
        asked = incoming.where(F.col(doc_id).isNotNull()).withColumn("__sha", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
        known = old.select(F.col("doc_id").alias(doc_id), F.col("sha").alias("__known"))
        fresh = asked.join(known, doc_id, "left").where("__known is null or __known <> __sha").drop("__sha", "__known")
        gen = m["number"] + 1
        contents, tokens, counts = _incoming(spark, path, fresh, m["kind"], gen, doc_id, content, file)
        names = ["doc_id", "gen", "token_count", "first", "sha"]
        kept = old.select(*names).join(counts.select("doc_id"), "doc_id", "left_anti")
        if counts.isEmpty():
            return None
        live = _write(ranges_of(kept.unionByName(counts.select(*names))), path, "live", LIVE)
        after = m | {"fingerprint": None, "tokens": [*m["tokens"], tokens], "contents": [*m["contents"], contents], "live": [live], "borders": [], "layouts": None}
        return after | _ends(spark, path, after)

    return _changed(spark, path, change)


def append(spark: SparkSession, path: str, incoming: DataFrame, content: str = "text", file: str = "path", order: str | None = None, kind: str = "core") -> Corpus:
    """New files after those that are stored, numbered on in the given order; nothing of what is stored is read but the manifest."""
    from .scratch import dropped, ranked

    if manifest(spark, path) is None:
        save(empty(spark, kind), path)
    asked = ranked(incoming.select(F.col(content).alias("content"), F.col(file).alias("path"), F.col(order or file).alias("o")), "o", "path", "content", name="n")

    def change(m: dict) -> dict | None:
        own = asked.select((F.col("n") + m["last_doc"] + 1).alias("doc_id"), "path", "content")
        contents, tokens, counts = _incoming(spark, path, own, m["kind"], m["number"] + 1, "doc_id", "content", "path")
        ranges = ranges_of(counts)
        ranges = ranges.withColumns({c: F.col(c) + m["total"] for c in ("token_start", "token_end")})
        live = _write(ranges, path, "live", LIVE)
        rows = spark.read.schema(LIVE).parquet(f"{path}/{live}")
        first = rows.where("token_count > 0").agg(F.min(F.struct("doc_id", "first")).alias("f")).first()["f"]
        ends = rows.agg(F.max("token_end").alias("total"), F.max("doc_id").alias("last_doc"), F.max(F.when(F.col("token_count") > 0, F.col("doc_id"))).alias("last_filled")).first()
        if ends["total"] is None:
            return None
        borders = [*m["borders"], *([[m["last_filled"], first["first"]]] if first and m["last_filled"] is not None else [])]
        ends = {"total": ends["total"], "last_doc": ends["last_doc"], "last_filled": m["last_filled"] if ends["last_filled"] is None else ends["last_filled"]}
        return m | ends | {"fingerprint": None, "tokens": [*m["tokens"], tokens], "contents": [*m["contents"], contents], "live": [*m["live"], live], "borders": borders, "layouts": None}

    try:
        return _changed(spark, path, change)
    finally:
        dropped(asked)


def import_tokens(spark: SparkSession, path: str, tokens: DataFrame) -> Corpus:
    """Tokens(token, pos from 0) of no file, after all tokens that are stored; they stay after the files when these change."""
    if manifest(spark, path) is None:
        save(empty(spark), path)
    at = _write(tokens.select("token", F.col("pos").cast("long").alias("pos")), path, "loose", LOOSE)
    n, first = spark.read.schema(LOOSE).parquet(f"{path}/{at}").agg(F.coalesce(F.max("pos") + 1, F.lit(0)), F.max(F.when(F.col("pos") == 0, F.col("token")))).first()

    def change(m: dict) -> dict | None:
        start = m["loose"][-1]["start"] + m["loose"][-1]["count"] if m["loose"] else 0
        return n and m | {"fingerprint": None, "loose_first": m["loose_first"] if m["loose"] else first, "loose": [*m["loose"], {"folder": at, "start": start, "count": n}], "layouts": None}

    return _changed(spark, path, change)


def import_text(spark: SparkSession, path: str, file: str) -> Corpus:
    return import_tokens(spark, path, source.text_tokens(spark, file))


def compact(spark: SparkSession, path: str, parts: int | None = None, layouts: bool = False) -> Corpus:
    """Write the live rows of all folders as one, in so many files of tokens."""
    return _changed(spark, path, lambda m: _whole(_loaded(spark, path, m), path, m["fingerprint"], parts, layouts))


def vacuum(spark: SparkSession, path: str, seconds: float = 7 * 86400) -> int:
    """Delete folders and manifests that the newest state does not name and that have that age; gives how many. Who still reads an older state then fails."""
    m = manifest(spark, path)
    if not m or m.get("version") != VERSION:
        return 0
    kept = {*m["tokens"], *m["contents"], *m["live"], *(x["folder"] for x in m["loose"]), *((m["layouts"] or {}).values()), f"m-{m['number']:010d}.json"}
    fs, p = _fs(spark, path)
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in kept and s.getModificationTime() <= (time.time() - seconds) * 1000]
    return sum(bool(fs.delete(x, True)) for x in old)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.delete(p, True)


# Reading


def empty(spark: SparkSession, kind: str = "core") -> Corpus:
    return Corpus(spark.createDataFrame([], FILES), spark.createDataFrame([], TOKEN_ROWS), kind)


def _read(spark: SparkSession, path: str, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def _live(spark: SparkSession, path: str, m: dict) -> DataFrame:
    """The rows of live, with the first tokens of what was appended after them."""
    rows = _read(spark, path, m["live"], LIVE)
    if m["borders"]:
        borders = spark.createDataFrame(m["borders"], "doc_id long, over string")  # one for each append since the last compaction
        rows = rows.join(F.broadcast(borders), "doc_id", "left").withColumn("after", F.coalesce("over", "after")).drop("over")
    if m.get("loose_first") is not None and m.get("last_filled") is not None:
        rows = rows.withColumn("after", F.when(F.col("doc_id") == m["last_filled"], F.lit(m["loose_first"])).otherwise(F.col("after")))
    return rows


class StoredCorpus(Corpus):
    """A corpus read from its folders; what is laid out for a kind of question is read for it alone."""

    def _stored(self, name: str, schema: T.StructType) -> DataFrame | None:
        layouts = self.__dict__.get("layouts") or {}
        return self.spark.read.schema(schema).parquet(layouts[name]) if name in layouts else None

    @property
    def texts(self) -> DataFrame | None:
        return self.__dict__.get("stored_texts")

    def contents_of(self, own: DataFrame, few: bool) -> DataFrame:
        """Few files are picked before their generations meet live, so that no other texts are shuffled."""
        if not few:
            return super().contents_of(own, few)
        contents, live = self.__dict__["stored_files"]
        return contents.select(*KEY, "content").join(F.broadcast(own), "doc_id").join(live.select(*KEY), KEY).drop("gen")

    def _lexicon(self) -> DataFrame:
        own = self._stored("lexicon", LEXICON)
        return super()._lexicon() if own is None else own

    def _vocabulary(self) -> DataFrame:
        own = self._stored("lexicon", LEXICON)
        return super()._vocabulary() if own is None else own.select("token")

    @property
    def pairs(self) -> DataFrame | None:
        return self._stored("pairs", PAIRS)

    @property
    def pair_counts(self) -> DataFrame | None:
        return self._stored("counts", COUNTS)

    @property
    def sequence(self) -> DataFrame:
        own = self._stored("sequence", SEQUENCE)
        return super().sequence if own is None else own

    def sequence_at(self, around: DataFrame) -> DataFrame:
        """Positions asked for by the runs that they lie in: of the layout by position only the pages of these are read."""
        if "sequence" not in (self.__dict__.get("layouts") or {}):
            return self.sequence
        runs = sorted(r[0] for r in around.select(F.floor(F.col("pos") / PAGE)).distinct().limit(MOST_RUNS + 1).collect())  # at most so many numbers
        if len(runs) > MOST_RUNS:
            return self.sequence
        starts = [r for i, r in enumerate(runs) if not i or runs[i - 1] != r - 1]
        ends = [r for i, r in enumerate(runs) if i + 1 == len(runs) or runs[i + 1] != r + 1]
        asked = [F.col("pos").between(a * PAGE, b * PAGE + PAGE - 1) for a, b in zip(starts, ends, strict=True)]
        return self.sequence.where(reduce(lambda x, y: x | y, asked) if asked else F.lit(False))


def _loaded(spark: SparkSession, path: str, m: dict) -> Corpus:
    live = _live(spark, path, m)
    contents = _read(spark, path, m["contents"], CONTENTS)
    texts = contents.join(live.drop("sha"), KEY).drop("gen")
    files = texts.select(*FILES.fieldNames())
    tokens = placed(_read(spark, path, m["tokens"], TOKENS), live, KEY)
    if m["loose"]:
        parts = [_read(spark, path, [x["folder"]], LOOSE).select("token", (F.col("pos") + m["total"] + x["start"]).alias("pos")) for x in m["loose"]]
        tokens = tokens.unionByName(with_next(reduce(DataFrame.unionByName, parts)), allowMissingColumns=True)
    out = StoredCorpus(files, tokens, m.get("kind", "core"), filed=not m["loose"])
    out.__dict__["stored_files"] = contents, live
    out.__dict__["stored_texts"] = None if m["loose"] else texts
    out.__dict__["layouts"] = {k: f"{path}/{v}" for k, v in (m.get("layouts") or {}).items()}
    return out


def load(spark: SparkSession, path: str) -> Corpus:
    """A saved corpus; empty if there is none or, with a warning, if it cannot be read. Versions 1 to 3 hold tokens only."""
    m = manifest(spark, path)
    if not m:
        return empty(spark)
    readers = {VERSION: _loaded, 5: _by_folder, 4: _without_next, 1: _tokens_only, 2: _tokens_only, 3: _tokens_only}
    if m.get("version") not in readers:
        warnings.warn(f"{path}: version {m.get('version')} is not known; starting empty", stacklevel=2)
        return empty(spark)
    return readers[m["version"]](spark, path, m)


def _with_first(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """Files of older versions with their first tokens."""
    return files.drop("first").join(tokens.where("local_pos = 0").select("doc_id", F.col("token").alias("first")), "doc_id", "left").select(*FILES.fieldNames())


def _by_folder(spark: SparkSession, path: str, m: dict) -> Corpus:
    at, rows = f"{path}/{m['folder']}", T.StructType([*TOKEN_ROWS, T.StructField("next", _S)])
    tokens = spark.read.schema(rows).parquet(f"{at}/tokens")
    return Corpus(_with_first(spark.read.schema(FILES).parquet(f"{at}/files"), tokens), tokens, m.get("kind", "core"))


def _without_next(spark: SparkSession, path: str, m: dict) -> Corpus:
    tokens = spark.read.schema(TOKEN_ROWS).parquet(f"{path}/tokens")
    return Corpus(_with_first(spark.read.schema(FILES).parquet(f"{path}/files"), tokens), tokens, m.get("kind", "core"))


def _tokens_only(spark: SparkSession, path: str, m: dict) -> Corpus:
    return Corpus.from_tokens(spark.read.schema(LOOSE).parquet(f"{path}/tokens"))


def storage_stats(spark: SparkSession, path: str) -> dict:
    """total and unique tokens, files, bytes stored, and how many folders of tokens the state has."""
    fs, p = _fs(spark, path)
    m = manifest(spark, path) or {}
    if m.get("version") == VERSION:
        total, unique, n_files = _counts(spark, path, m)
    else:
        row = load(spark, path).stats().first()
        total, unique, n_files = row["total_tokens"], row["unique_tokens"], row["n_files"]
    return {"total_tokens": total, "unique_tokens": unique, "n_files": n_files, "storage_bytes": fs.getContentSummary(p).getLength() if fs.exists(p) else 0, "folders": len(m.get("tokens", []))}


def _counts(spark: SparkSession, path: str, m: dict) -> tuple[int, int, int]:
    """Total and unique tokens, and files: totals are in the manifest, and tokens need their files only where some of these are no longer alive."""
    live = _live(spark, path, m).select(*KEY)
    stale = _read(spark, path, m["contents"], CONTENTS).select(*KEY).join(live, KEY, "left_anti")
    tokens = _read(spark, path, m["tokens"], TOKENS)
    words = (tokens if stale.isEmpty() else tokens.join(live, KEY, "left_semi")).select("token")
    if m["loose"]:
        words = words.unionByName(_read(spark, path, [x["folder"] for x in m["loose"]], LOOSE).select("token"))
    return m["total"] + sum(x["count"] for x in m["loose"]), words.distinct().count(), live.count()
