"""A trie of conversations by leaf-peeling message passing.

A node is a distinct sequence of first turns; it goes by the smallest conversation that begins so, and by its depth. Sequences are compared by
two 64-bit hashes, each the exclusive or of hashes of (depth, turn), so a prefix costs no chain of rounds. Nodes in a row with one smallest
conversation are a branch, which peels as one: each branch holds a counter of the branches that hang on it; those with none left send the
totals of their subtree to the branch above, round by round, until only the root's is left. So there are as many rounds as branches between the
root and a leaf, not as turns in the longest conversation. At last each node sums what its own branch holds from it on.

Cases: rows without a conversation id take no part; a null role or text counts as empty; turns go by number, null first, those of one number by role,
then text (the first 64 characters of each, then a hash, so that no text is shuffled or sampled); repeated rows are turns of their own; a conversation without turns is a member of the root alone; an empty table has no nodes; other
columns are left out. A conversation with very many turns, and a turn, node or conversation with very many copies, is spread over
tasks: turns are numbered from counts by partition, sums along a branch are taken in blocks of depths, and ids of members are joined to strings of
at most 4,096 before they are hashed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, written

BLOCK, IDS, HEAD = 1 << 16, 1 << 12, 64
BEFORE, UP_TO = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, 0)
KEY = ["depth", "x1", "x2"]


def numbered(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), two hashes t1 and t2 of role and text, and words: the turns of each conversation in order."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.left(said[0], F.lit(HEAD)).alias("role"), F.left(said[1], F.lit(HEAD)).alias("head"),
        F.xxhash64(F.lit(1), *said).alias("t1"), F.xxhash64(F.lit(2), *said[::-1]).alias("t2"), F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row"),
    ).where("conv is not null")
    order = ["conv", "turn", "role", "head", "t1", "row"]  # equal rows differ by where they were read, so that even those can be parted
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    out = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "t1", "t2", "words", F.spark_partition_id().alias("part"), place.alias("at"))
    placed = written(out, "trie-turns")
    runs = placed.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row for each conversation and partition
    runs = runs.select("conv", "part", (F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(*BEFORE)), F.lit(0)) - F.col("first") + 1).alias("more"))
    return placed.join(runs, ["conv", "part"]).select("conv", (F.col("at") + F.col("more")).alias("place"), "t1", "t2", "words")


def rebuilt(rows: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """conv, depth, t1, t2 and words, and the conversations: each begins with the first turns of the first one of its group.

    So many turns (crc32 of the id, modulo most) come from that one, where it has them, and the turns after as many come from the conversation itself.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % F.lit(most)
    sizes = rows.groupBy("conv").agg(F.count("*").alias("size")).withColumns({"base": F.col("conv") - F.col("conv") % group, "h": h})
    bases = sizes.where("conv = base").select("base", F.col("size").alias("__s"))
    convs = sizes.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("__s", F.lit(0))).alias("lead"))
    own = rows.join(convs.select("conv", "h", "lead"), "conv").where("place > h").select("conv", (F.col("lead") + F.col("place") - F.col("h")).alias("depth"), "t1", "t2", "words")
    heads = rows.where((F.col("place") < most) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    copied = convs.where("h > 0").select("conv", "base", "h").join(heads, "base").where("place <= h").select("conv", F.col("place").alias("depth"), "t1", "t2", "words")
    return own.unionByName(copied), convs.select("conv")


def _prefixes(rows: DataFrame) -> DataFrame:
    """The rows with x1 and x2, the hashes of the turns up to each, and p1 and p2, those of the turns before it."""
    one, two = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "depth", "t1")
    rows = rows.select("conv", "depth", "words", one.alias("s1"), two.alias("s2"), F.floor(F.col("depth") / BLOCK).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(*UP_TO)
    rows = rows.withColumns({"x1": F.bit_xor("s1").over(inside), "x2": F.bit_xor("s2").over(inside)})
    blocks = Window.partitionBy("conv").orderBy("block").rowsBetween(*UP_TO)  # a row for each 65,536 turns
    full = rows.where((F.col("depth") + 1) % BLOCK == 0).select("conv", (F.col("block") + 1).alias("block"), F.bit_xor("x1").over(blocks).alias("y1"), F.bit_xor("x2").over(blocks).alias("y2"))
    rows = rows.join(full, ["conv", "block"], "left").withColumns({f"x{k}": F.col(f"x{k}").bitwiseXOR(F.coalesce(f"y{k}", F.lit(0))) for k in (1, 2)})
    return rows.select("conv", *KEY, "words", F.col("x1").bitwiseXOR(F.col("s1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("s2")).alias("p2"))


def _digests(ends: DataFrame) -> DataFrame:
    """The keys with n_ends and ends_sha256 of ends(conv and key): the ids in order, joined by commas."""
    few = ends.groupBy(*KEY, F.floor(F.col("conv") / IDS).alias("part")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))  # at most 4,096 distinct ids
    few = few.select(*KEY, "part", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, sha = None, 0, None
        schema = pa.schema([*[(k, pa.int64()) for k in KEY], ("n_ends", pa.int64()), ("ends_sha256", pa.string())])
        done: list[tuple] = []
        for batch in batches:
            for *here, more, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)], strict=True):
                if here != key:
                    if key is not None:
                        done.append((*key, n, sha.hexdigest()))
                    key, n, sha = here, 0, hashlib.sha256()
                sha.update(("," if n else "").encode() + ids.encode())
                n += more
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
            done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, n, sha.hexdigest()), schema, strict=True)], schema=schema)

    return few.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInArrow(run, "depth long, x1 long, x2 long, n_ends long, ends_sha256 string")


def _peeled(branches: DataFrame) -> DataFrame:
    """conv, parent, top, leaves and saved of each branch with all that hangs on it; branches has these and open, how many branches hang on it."""
    spark, done = branches.sparkSession, []
    state = written(branches, "trie-peel")
    while not state.isEmpty():
        over = state.where("open = 0")
        done.append(over.drop("open"))
        sent = over.groupBy(F.col("parent").alias("conv")).agg(F.count("*").alias("k"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        rest = state.where("open > 0").join(sent, "conv", "left").na.fill(0, ["k", "l", "s"])
        after = written(rest.select("conv", "parent", "top", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"), (F.col("open") - F.col("k")).alias("open")), "trie-peel")
        if after.where("open < 0").limit(1).count() or (over.isEmpty() and not after.isEmpty()):
            raise RuntimeError("branches do not form a tree")
        state = after
    out = written(_union(done), "trie-totals") if done else state.drop("open")
    for x in done:
        drop(spark, x)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends and ends_sha256 of every node.

    rows has conv, depth (from 1, without gaps), t1, t2 and words of the turns; convs all ids, once each. saved_tokens sums (n_convs - 1) * words over a subtree.
    """
    spark = rows.sparkSession
    paths = written(_prefixes(rows), "trie-paths")
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    root = convs.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(*zero, "conv", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    each = paths.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    bare = written(each.unionByName(root), "trie-bare")
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = bare.where("depth > 0").groupBy(*above).agg(F.count("*").alias("n_children"))
    last = paths.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("k")).select("conv", "k.*")
    ends = convs.join(last, "conv", "left").na.fill(0, KEY)
    known = written(bare.join(children, KEY, "left").join(_digests(ends), KEY, "left").na.fill(0, ["n_children", "n_ends"]), "trie-nodes")
    drop(spark, paths)

    # A branch begins where a conversation becomes the smallest; what it hangs on is the node before.
    saved = (F.col("n_convs") - 1) * F.col("words")
    branch = known.groupBy("conv").agg(F.min(F.struct("depth", "p1", "p2")).alias("t"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.sum(saved).alias("saved"))
    branch = branch.select("conv", "leaves", "saved", F.col("t.depth").alias("top"), (F.col("t.depth") - 1).alias("depth"), F.col("t.p1").alias("x1"), F.col("t.p2").alias("x2"))
    owners = bare.select(*KEY, F.col("conv").alias("parent"))
    branch = written(branch.join(owners, KEY, "left").select("conv", "parent", "top", "leaves", "saved"), "trie-branches")
    hanging = branch.groupBy(F.col("parent").alias("conv")).agg(F.count("*").alias("open"))
    total = _peeled(branch.join(hanging, "conv", "left").na.fill(0, ["open"]))
    drop(spark, bare)
    drop(spark, branch)

    hung = total.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    tops = total.where("parent is not null").select("conv", F.col("top").alias("depth"), "parent")
    own = known.join(hung, ["conv", "depth"], "left").join(tops, ["conv", "depth"], "left").na.fill(0, ["l", "s"])
    own = own.withColumns({"l": F.col("l") + F.when(F.col("n_children") == 0, 1).otherwise(0), "s": F.col("s") + saved, "block": F.floor(F.col("depth") / BLOCK)})
    inside = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(*UP_TO)
    own = own.withColumns({"l": F.sum("l").over(inside), "s": F.sum("s").over(inside)})
    blocks = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(*UP_TO)  # a row for each 65,536 turns
    later = own.where((F.col("depth") % BLOCK == 0) & (F.col("depth") > 0)).select("conv", (F.col("block") - 1).alias("block"), F.sum("l").over(blocks).alias("ml"), F.sum("s").over(blocks).alias("ms"))
    own = own.join(later, ["conv", "block"], "left").na.fill(0, ["ml", "ms"])
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return own.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", (F.col("l") + F.col("ml")).alias("n_leaves"), (F.col("s") + F.col("ms")).alias("saved_tokens"),
        "n_ends", F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


def trie(turns: DataFrame, *, rebuild: bool = False, **columns: str) -> DataFrame:
    """The nodes of the trie of conversations: those of turns(conv_id, turn, role, text) as they stand, or first rebuilt."""
    rows = numbered(turns, **columns)
    if rebuild:
        return nodes(*rebuilt(rows))
    return nodes(rows.withColumnRenamed("place", "depth"), rows.select("conv").distinct())
