"""Trie of conversation prefixes by van Emde Boas recursion.

A problem is a set of turn sequences below one root, all at most ``span`` turns
long.  It is cut at half its depth: equal upper halves get one name (the
smallest conversation that has it, which with its depth is a trie node), one
sequence with the weight of all stands for them in the upper trie, and what is
left of each sequence goes to the lower forest below its name.  Upper tries and
lower forests are problems of half the span and are cut together in the next
round, so the rounds are the logarithm of the longest conversation, not its
length.  At span one each problem is a root and its children.  Going back up,
the totals of each lower trie are grafted on the path that leads to its root in
the upper trie; the paths are put together from those of the halves.

Equal halves are found by two 64-bit hashes: the exclusive or, over the turns,
of a hash of depth and turn (role and text by SHA-256).  It needs no order, so
partial aggregates serve, and a conversation is never held in one task.

On Spark: texts are read once and turned into keys and word counts; all rounds
are equi joins and aggregates over those rows, each written as a table below the
shared checkpoint folder and read again (a checkpointed plan keeps what the
optimizer inferred of it, which would grow with every round); joined sides are
plain exchanges, which AQE splits where many conversations share a prefix.  Turns are numbered by a sort over ranges of (conversation, turn, key),
so a conversation may span many tasks.  The digest of a node's ends runs over
texts of up to 256 ids that are streamed in order (SHA-256 is sequential; memory
is that of one Arrow batch).  Only two numbers reach the driver.

Defined results: rows without conversation id take no part; null turns come
first; equal turn numbers are ordered by the hash of role and text, repeated
rows are turns of their own; null role or text is empty; conversations without
turns (possible when rebuilt) are members and ends of the root only; an empty
table has no nodes; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.session import checkpoint_dir

SWAP_EVERY = 20
_IDS = 8  # bits of the ids that one text of ids covers
_TURN = ("k1", "k2", "w")


def _stored(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read from it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/trie-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def turn_keys(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, k1, k2, w)``: two keys of role and text, and the text's words."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    x = conversations.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w"),
    )
    part = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    return x.select("conv", "turn", part(1).alias("k1"), part(16).alias("k2"), "w")


def numbered(keys: DataFrame) -> DataFrame:
    """``(conv, pos, k1, k2, w)``: turns numbered from 1 in each conversation."""
    order = (F.col("turn").asc_nulls_first(), "k1", "k2")
    rows = keys.groupBy("conv", "turn", *_TURN).agg(F.count("*").alias("n"))
    rows = _stored(rows.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order).withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("conv", "part").agg(F.sum("n").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv", "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    here = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("before") + F.sum("n").over(here)
    rows = rows.join(sizes, ["conv", "part"]).select("conv", *_TURN, "n", last.alias("last"))
    return rows.select("conv", F.explode(F.sequence(F.col("last") - F.col("n") + 1, "last")).alias("pos"), *_TURN)


def rebuilt(turns: DataFrame, every: int = SWAP_EVERY) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``h = crc32(id) % 4`` turns are those of
    conversation ``id - id % every``: ``(conv, pos, k1, k2, w)`` and ``(conv)``."""
    conv = F.col("conv")
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("size"))
    plan = sizes.select("conv", (F.crc32(conv.cast("string")) % 4).alias("h"), (conv - conv % every).alias("base"), "size")
    base = sizes.where(conv % every == 0).select(conv.alias("base"), F.col("size").alias("base_size"))
    plan = _stored(plan.join(base, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken")))
    own = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), *_TURN)
    heads = turns.where((F.col("pos") <= 3) & (conv % every == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(plan, "base").where("pos <= taken").select("conv", "pos", *_TURN)
    return own.unionByName(heads), plan.select("conv")


def _mixed(lane: int) -> Column:
    """Hash of a turn at its depth; the exclusive or of these names a prefix."""
    return F.xxhash64(F.lit(lane), "pos", "k1", "k2") if lane == 1 else F.xxhash64("k2", F.lit(lane), "k1", "pos")


def cut(u: DataFrame, half: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: sequences ``u(a, root, p1, p2, seq, weight, size, pos, k1, k2, w)`` of
    ``half`` to twice ``half`` turns below depth ``a`` to those of at most ``half``;
    the names of the cut prefixes ``(a, rep)`` and of all sequences ``(a, seq, rep)``."""
    upper = F.col("pos") <= F.col("a") + half
    sides = [F.bit_xor(F.when(upper, _mixed(i))).alias(f"x{i}") for i in (1, 2)]
    s = u.groupBy("a", "root", "seq", "weight").agg(*sides)
    key = ["a", "root", "x1", "x2"]
    names = _stored(s.groupBy(*key).agg(F.min("seq").alias("rep"), F.sum("weight").alias("total")))
    named = _stored(s.join(names, key).select("a", "seq", "rep", "total", "x1", "x2"))
    x = u.join(named, ["a", "seq"]).where(~upper | (F.col("rep") == F.col("seq")))
    first = lambda up, low: F.when(upper, up).otherwise(low)
    out = x.select(
        first(F.col("a"), F.col("a") + half).alias("a"),
        first(F.col("root"), F.col("rep")).alias("root"),
        *[first(F.col(f"p{i}"), F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}"))).alias(f"p{i}") for i in (1, 2)],
        "seq",
        first(F.col("total"), F.col("weight")).alias("weight"),
        first(F.lit(half).cast("long"), F.col("size") - half).alias("size"),
        "pos",
        *_TURN,
    )
    return _stored(out), names.select("a", "rep"), named.select("a", "seq", "rep")


def cut_all(u: DataFrame, span: int) -> tuple[DataFrame, list[tuple[int, DataFrame, DataFrame]]]:
    """All rounds from ``span`` down: sequences of one turn, and each round's
    ``(half, names, named)``.

    A round takes the sequences that reach its cut.  Shorter ones wait, in the table
    they are in, for the round that cuts them, so a long conversation among many
    short ones costs the short ones nothing.
    """
    waiting: list[DataFrame] = []
    cuts = []
    while span > 1:
        span //= 2
        # of the round before, whose upper parts have twice ``span`` turns, and of all others
        now = [u.where(F.col("size") >= span)] + [w.where((F.col("size") >= span) & (F.col("size") < 2 * span)) for w in waiting]
        waiting.append(u)
        u, names, named = cut(functools.reduce(DataFrame.unionAll, now), span)
        cuts.append((span, names, named))
    return u, cuts


def children(u: DataFrame) -> DataFrame:
    """Sequences of one turn to their nodes: ``(depth, conv, parent, q1, q2, k1, k2, w, n_convs)``."""
    n = u.groupBy("a", "root", *_TURN).agg(F.min("seq").alias("conv"), F.sum("weight").alias("n_convs"), *[F.first(F.col(f"p{i}").bitwiseXOR(_mixed(i))).alias(f"q{i}") for i in (1, 2)])
    return n.select((F.col("a") + 1).alias("depth"), "conv", F.col("root").alias("parent"), "q1", "q2", *_TURN, "n_convs")


def _needed(cuts: list[tuple[int, DataFrame, DataFrame]]) -> dict[int, DataFrame]:
    """Per span the ``(a, seq)`` whose path through their problem is needed: those
    that stand for a cut prefix, and the lower halves of needed longer paths."""
    need: dict[int, DataFrame] = {}
    for half, names, _ in cuts:  # from the widest span on
        need[half] = names.select("a", F.col("rep").alias("seq"))
        if 2 * half in need:
            need[half] = need[half].unionAll(need[2 * half].select((F.col("a") + half).alias("a"), "seq"))
        need[half] = _stored(need[half])
    return need


def graft(u: DataFrame, nodes: DataFrame, single: DataFrame, cuts: list[tuple[int, DataFrame, DataFrame]]) -> DataFrame:
    """``single(depth, conv, parent, n_leaves, saved)`` of nodes alone to
    ``(depth, conv, n_leaves, saved)`` of their subtrees, from the narrowest cuts up.

    What a lower trie adds to the nodes above it is kept as rows of its own, so a
    round touches the nodes below and above its cuts only.
    """
    need = _needed(cuts)
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved")]
    parts, paths = [single], None
    for half, _, named in reversed(cuts):
        if paths is None:
            at = nodes.select((F.col("depth") - 1).alias("a"), F.col("parent").alias("root"), *_TURN, "conv")
            paths = _stored(u.join(need[half], ["a", "seq"], "left_semi").join(at, ["a", "root", *_TURN]).select("a", "seq", "pos", "conv", F.col("root").alias("parent")))
        below = [p.where((F.col("depth") - 1) % (2 * half) == half) for p in parts]
        below = functools.reduce(DataFrame.unionAll, below).groupBy((F.col("depth") - 1 - half).alias("a"), F.col("parent").alias("seq")).agg(*sums)
        # written first: paths of one sequence, or of many with one root, can then be split
        added = paths.join(_stored(below), ["a", "seq"]).groupBy(F.col("pos").alias("depth"), "conv", "parent").agg(*sums)
        parts.append(_stored(added))
        if 2 * half in need:
            wide, of = need[2 * half], ["a", "seq", "pos", "conv", "parent"]
            first = wide.join(named, ["a", "seq"]).join(paths.withColumnRenamed("seq", "rep"), ["a", "rep"])
            second = wide.withColumn("m", F.col("a") + half).join(paths.withColumnRenamed("a", "m"), ["m", "seq"])
            paths = _stored(first.select(*of).unionAll(second.select(*of)))
    return functools.reduce(DataFrame.unionAll, parts).groupBy("depth", "conv").agg(*sums)


def ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``(depth, q1, q2, ends_sha256)``: digest of the ids of the conversations that
    end at a node, ascending and joined by commas."""
    full = turns.groupBy("conv").agg(F.count("*").alias("depth"), *[F.bit_xor(_mixed(i)).alias(f"q{i}") for i in (1, 2)])
    key = ["depth", "q1", "q2"]
    own = convs.join(full, "conv", "left").select("conv", *[F.coalesce(c, F.lit(0)).alias(c) for c in key])
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    parts = own.groupBy(*key, F.shiftright("conv", _IDS).alias("part")).agg(ids.alias("ids"))
    parts = parts.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        names = [*key, "ends_sha256"]
        for batch in batches:
            done = []
            *keys, texts = batch.columns
            for node, text in zip(zip(*[k.to_pylist() for k in keys]), texts.to_pylist()):
                if node == last:
                    digest.update(b",")
                else:
                    if last is not None:
                        done.append((*last, digest.hexdigest()))
                    last, digest = node, hashlib.sha256()
                digest.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*last, digest.hexdigest())))], schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()), ("ends_sha256", pa.string())])
    return parts.mapInArrow(run, "depth long, q1 long, q2 long, ends_sha256 string")


_OUT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes of the prefix trie over ``turns(conv, pos, k1, k2, w)`` (numbered from
    1) and all conversations ``convs(conv)``: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``."""
    spark = turns.sparkSession
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("size"))
    turns = _stored(turns.join(sizes, "conv"))
    size = convs.agg(F.min("conv").alias("least"), F.count("*").alias("n")).first()
    if not size.n:
        return spark.createDataFrame([], _OUT)
    longest = turns.agg(F.max("pos")).first()[0] or 0
    span = 1 << max(0, longest - 1).bit_length()

    zero = F.lit(0).cast("long")
    u = turns.select(zero.alias("a"), F.lit(size.least).cast("long").alias("root"), zero.alias("p1"), zero.alias("p2"), F.col("conv").alias("seq"), F.lit(1).cast("long").alias("weight"), "size", "pos", *_TURN)
    u, cuts = cut_all(u, span)
    nodes = _stored(children(u))
    below = _stored(nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(F.count("*").alias("n_children")))
    nodes = _stored(nodes.join(below, ["depth", "conv"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    single = nodes.select("depth", "conv", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("w")).alias("saved"))
    totals = _stored(graft(u, nodes, single, cuts))

    below_root = totals.where("depth = 1").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), zero), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved"), zero).alias("saved"))
    top = below_root.select(F.lit(size.least).cast("long").alias("conv"), zero.alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(size.n).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved", zero.alias("q1"), zero.alias("q2"))
    rest = nodes.join(totals, ["depth", "conv"]).select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "q1", "q2")
    return (
        rest.unionAll(top)
        .join(ends(turns, convs), ["depth", "q1", "q2"], "left")
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            F.col("parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            F.col("saved").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def rebuilt_trie(conversations: DataFrame, **cols: str) -> DataFrame:
    """The trie of ``conversations`` after ``rebuilt``."""
    return trie(*rebuilt(_stored(numbered(turn_keys(conversations, **cols)))))


def conversation_trie(conversations: DataFrame, **cols: str) -> DataFrame:
    """The trie of ``conversations`` as they are."""
    turns = _stored(numbered(turn_keys(conversations, **cols)))
    return trie(turns, turns.select("conv").distinct())
