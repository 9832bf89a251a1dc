"""The trie of conversation prefixes, by prefix doubling.

A node of depth d is a distinct sequence of first d turns.  Names come in rounds: a block of one turn is named by
its digest, a block of 2^k turns by the pair of names of its halves; only blocks that begin at a multiple of their
length are named, so a conversation of n turns has fewer than 2n of them.  The binary digits of d cut a prefix
into such blocks, so the prefix is known by the depth and the names of at most log2(n) + 1 blocks, and one
grouping by both gives the nodes.

What a node tells of its subtree needs no walk down the tree.  Each node is charged to its smallest member, and the
nodes charged to one conversation are the prefixes of it from some depth on.  So a subtree's sum is the sum over
members of all that is charged to them, less what is charged to the node's own smallest member above the node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.scratch import Scratch
from tideline.llm.turns import STRETCH, digest, positions, running

#: Hash buckets in which names are counted; each runs without gaps.
NAME_BUCKETS = 4096
#: Bits of an id that one piece of a list of ids spans.
PIECE_BITS = 12


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``digest`` and ``size`` (UTF-8 bytes of the text) of each turn; rows without conv_id are in no conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), digest(role, text).alias("digest"), F.octet_length(text).cast("bigint").alias("size")
    )
    return positions(rows, "conv_id").select("conv_id", "pos", "digest", "size")


def shared_openings(turns: DataFrame, group: int, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilds each conversation c from the first h turns of conversation c - c % group and its own turns after its first h.

    h is crc32 of the decimal c, modulo ``longest``.  Returns the turns, each with ``n_turns`` of its conversation, and
    the conversations with theirs (0 where nothing is left).  At most ``group`` x ``longest`` rows arise of an opening.
    """
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    first = own.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", taken).join(first, "base", "left")
    convs = convs.withColumn("kept", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("n_turns", F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = scratch.table("convs", convs.select("conv_id", "base", "h", "kept", "n_turns"))
    opening = turns.where(F.col("pos") < longest - 1).withColumnRenamed("conv_id", "base").join(convs, "base").where(F.col("pos") < F.col("h"))
    rest = turns.where(F.col("pos") >= taken).join(convs, "conv_id").withColumn("pos", F.col("pos") - F.col("h") + F.col("kept"))
    columns = ("conv_id", "pos", "digest", "size", "n_turns")
    return scratch.table("rebuilt", opening.select(*columns).unionByName(rest.select(*columns))), convs.select("conv_id", "n_turns")


def dense_names(rows: DataFrame, *columns: str) -> DataFrame:
    """A number for each distinct combination of ``columns``: the same on every run, without gaps within each hash bucket."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(NAME_BUCKETS))
    rank = F.row_number().over(Window.partitionBy("bucket_").orderBy(*columns))
    return rows.select(*columns).distinct().withColumn("bucket_", bucket).select(*columns, ((rank - 1) * NAME_BUCKETS + F.col("bucket_")).cast("bigint").alias("name"))


def named_blocks(turns: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """``conv_id``, ``level``, ``block``, ``name`` of each whole block of 2^level turns."""
    block, half = F.col("block"), F.col("block") % 2
    rows = turns.select("conv_id", F.col("pos").alias("block"), "digest")
    out = [scratch.table("blocks-0", rows.join(dense_names(rows, "digest"), "digest").select("conv_id", "block", "name"))]
    for level in range(1, longest.bit_length()):
        pairs = out[-1].groupBy("conv_id", F.shiftright(block, 1).alias("block")).agg(F.max(F.when(half == 0, F.col("name"))).alias("left"), F.max(F.when(half == 1, F.col("name"))).alias("right"))
        pairs = pairs.where(F.col("right").isNotNull())
        named = pairs.join(dense_names(pairs, "left", "right"), ["left", "right"])
        out.append(scratch.table(f"blocks-{level}", named.select("conv_id", "block", "name")))
    whole = out[0].withColumn("level", F.lit(0))
    for level, rows in enumerate(out[1:], 1):
        whole = whole.unionByName(rows.withColumn("level", F.lit(level)))
    return whole


def named_prefixes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id``, ``n_turns``, ``depth``, ``prefix`` (names of its blocks) and ``size`` of the last turn, of every prefix of every conversation."""
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    roots = convs.select("conv_id", "n_turns", F.lit(0).cast("bigint").alias("depth"), F.array().cast("array<bigint>").alias("prefix"), F.lit(0).cast("bigint").alias("size"))
    if not longest:
        return scratch.table("prefixes", roots)
    levels = longest.bit_length()
    depth = F.col("pos") + 1
    digits = F.filter(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.expr("pos + 1").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), k)) != 0)
    cut = turns.select("conv_id", "n_turns", depth.alias("depth"), "size", F.explode(digits).alias("level"))
    cut = cut.withColumn("block", F.expr("shiftright(depth, level + 1) * 2"))
    found = cut.join(named_blocks(turns, longest, scratch), ["conv_id", "level", "block"])
    names = F.transform(F.sort_array(F.collect_list(F.struct("level", "name"))), lambda x: x["name"])
    prefixes = found.groupBy("conv_id", "depth").agg(F.max("n_turns").alias("n_turns"), names.alias("prefix"), F.max("size").alias("size"))
    return scratch.table("prefixes", prefixes.select(*roots.columns).unionByName(roots))


def ends_digests(ends: DataFrame) -> DataFrame:
    """``depth``, ``prefix`` and the SHA-256 of the ids of ``ends`` in ascending order, joined by commas.

    Ids are listed by pieces of ids that share all but their last bits, so no list grows with its node; the pieces
    of a node are hashed one after the other.
    """
    pieces = ends.groupBy("depth", "prefix", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "piece")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        schema = pa.schema([("depth", pa.int64()), ("prefix", pa.list_(pa.int64())), ("ends_sha256", pa.string())])
        for batch in batches:
            done = []
            for depth, prefix, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "prefix", "ids"))):
                if node == (depth, prefix):
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (depth, prefix), hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)] if done else [pa.array([], f.type) for f in schema], schema=schema)
        if node:
            yield pa.RecordBatch.from_pylist([{"depth": node[0], "prefix": node[1], "ends_sha256": state.hexdigest()}], schema=schema)

    return dealt.select("depth", "prefix", "ids").mapInArrow(run, "depth bigint, prefix array<bigint>, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row a node of the trie of ``turns`` (``conv_id``, ``pos`` from 0 without gaps, ``digest``, ``size``, ``n_turns``).

    ``convs`` has every ``conv_id`` once, with ``n_turns``, also those without turns, which are members of the root.
    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.  No conversations: no nodes.
    """
    prefixes = named_prefixes(turns, convs, scratch)
    node = ["depth", "prefix"]
    grouped = prefixes.groupBy(*node).agg(F.count("*").alias("members"), F.min("conv_id").alias("least"), F.max("size").alias("size"), F.max("n_turns").alias("longest"))
    charged = scratch.table("charged", grouped.select("least", *node, ((F.col("members") - 1) * F.col("size")).alias("weight"), (F.col("longest") == F.col("depth")).cast("int").alias("leaf")))
    above = running(charged.select("least", "depth", "weight"), "least", F.floor(F.col("depth") / STRETCH), [F.col("depth")], F.col("weight"), "above")
    above = above.select(F.col("least").alias("conv_id"), "depth", (F.col("above") - F.col("weight")).alias("above"))
    shares = scratch.table("shares", charged.groupBy(F.col("least").alias("conv_id")).agg(F.min("depth").alias("own_from"), F.sum("weight").alias("share"), F.max("leaf").alias("leaf")))
    joined = prefixes.join(shares, "conv_id", "left")
    child = (F.col("n_turns") > F.col("depth")) & (F.col("own_from") <= F.col("depth") + 1)
    nodes = joined.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.coalesce(child, F.lit(False)).cast("bigint")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0)).cast("bigint")).alias("n_leaves"), F.sum(F.coalesce("share", F.lit(0))).alias("below"),
    )
    # where a conversation leaves the path of a smaller one, its parent is that one's node; deeper, its own
    leaving = joined.where(F.col("depth") == F.col("own_from") - 1).select(*node, "conv_id")
    parents = leaving.join(charged.select(*node, F.col("least").alias("parent")), node).select("conv_id", (F.col("depth") + 1).alias("depth"), "parent")
    ends = ends_digests(prefixes.where(F.col("depth") == F.col("n_turns")).select(*node, "conv_id"))
    out = nodes.join(ends, node, "left").join(above, ["conv_id", "depth"]).join(parents, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def opening_trie(conversations: DataFrame, group: int, longest: int) -> DataFrame:
    """``prefix_trie`` of conversations rebuilt by ``shared_openings``.

    Turns are ordered by turn (null first), then role, then a digest of role and text; null role or text is empty.
    Repeated rows are turns like any other; rows without conv_id are left out; an empty table has no nodes.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = scratch.table("turns", ordered_turns(conversations))
    return prefix_trie(*shared_openings(turns, group, longest, scratch), scratch)
