"""Conversation prefix trie by the Euler-tour technique.

A node is a distinct sequence of the first d turns of some conversation, from the textless
root (d = 0). A turn is identified by the SHA-256 of its role and text; a node by the exclusive
or of 64-bit hashes of (position, turn) under two seeds, 128 bits in all, so that running sums
give the nodes of a conversation and texts are never shuffled.

Tour: every node has an enter and an exit arc. The children of a node are in the order of
their smallest member. enter(v) is followed by enter(first child), or by exit(v) if there is
none; exit(v) by enter(next sibling), or by exit(parent). The tour is ranked by pointer
jumping: in each round an arc adds up what lies between it and the arc it points to, and
then points four times as far, so that 2n arcs take log4(2n) rounds of joins on unique keys.
The sums that are jumped are the rank itself, the leaves and the savings, so the results are
suffix sums at arc positions: the subtree of v is what lies between enter(v) and exit(v).

Scale: no group is gathered. Turns are numbered and hashed within ranges of (conversation,
order) with a carry between ranges (``ordered``), siblings are linked in the same way, counts
are combined map-side, and parents with more than a thousandth of all nodes as children are
joined by broadcast. Arcs that have reached the end leave the joins. Rounds are written tables,
of which the last two are kept. A digest of members reads its sorted conv_ids in blocks, as a stream.

Defined results: rows with a null conv_id belong to no conversation and are left out; turns
come in the order of ``turn``, null first, ties by the digest of role and text, so repeated
rows are repeated turns; null roles and texts are empty; an empty table has no nodes; extra
columns are ignored. ``conv_id % 100`` has the sign of conv_id, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import common, ordered

#: Conversations of one hundred share the first turns of the first of them.
SHARED = 100
#: A conversation takes crc32(conv_id) % HEADS turns from there.
HEADS = 6
#: Links followed in one round; an arc then points (JUMPS + 1) times as far.
JUMPS = 3
#: conv_ids that are joined to one block before a digest reads them.
BLOCK_IDS = 4096

_KEY = ("depth", "k1", "k2")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn digest, chars; dealt in ranges with the number of the range."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    order = ["turn", "digest"]
    return ordered.counted(ordered.dealt(rows, "turns", ["conv_id"], order), ["conv_id"], order, "pos").drop("turn")


def _halves(pos: Column | str, digest: Column | str) -> tuple[Column, Column]:
    """Two hashes of a turn at its place; the hash tells ints from longs, so the place is always a long."""
    pos = (F.col(pos) if isinstance(pos, str) else pos).cast("long")
    return F.xxhash64(F.lit(1), pos, digest), F.xxhash64(F.lit(2), pos, digest)


def paths(turns: DataFrame, shared: int = SHARED, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, depth, k1, k2, p1, p2, chars), a row for each node on the path
    but the root, and (conv_id, length)."""
    turns = common.materialise(turns, "turns-numbered")
    x1, x2 = _halves("pos", "digest")
    step = F.struct(F.col("pos").cast("int").alias("pos"), x1.alias("x1"), x2.alias("x2"), "chars")
    # at most heads - 1 rows of each conversation that others may start with
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % shared == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(step)).alias("first"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % shared)
    convs = convs.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int"))
    head = F.when(F.col("first").isNull(), F.array().cast("array<struct<pos:int,x1:bigint,x2:bigint,chars:bigint>>")).otherwise(F.slice("first", F.lit(1), F.col("h")))
    convs = common.materialise(convs.join(first, "base", "left").select("conv_id", "n", "h", head.alias("head")).withColumn("held", F.size("head")), "conversations")
    total = turns.count()

    whole = lambda half: F.aggregate("head", F.lit(0).cast("long"), lambda acc, s: acc.bitwiseXOR(s[half]))
    keyed = convs.select("conv_id", "n", "h", "held", whole("x1").alias("h1"), whole("x2").alias("h2"))
    own = common.join_by_key(turns, keyed, "conv_id", "n", total).where(F.col("pos") > F.col("h"))
    own = own.withColumn("depth", (F.col("pos") - F.col("h") + F.col("held")).cast("int"))
    y1, y2 = _halves("depth", "digest")
    own = own.select("conv_id", ordered.PART, "depth", "chars", "h1", "h2", y1.alias("x1"), y2.alias("x2"), y1.alias("k1"), y2.alias("k2"))
    own = ordered.xored(own, ["conv_id"], ["depth"], "k1", "k2").withColumns({"k1": F.col("k1").bitwiseXOR(F.col("h1")), "k2": F.col("k2").bitwiseXOR(F.col("h2"))})

    upto = lambda half: F.aggregate(F.slice("head", F.lit(1), F.col("s.pos")), F.lit(0).cast("long"), lambda acc, s: acc.bitwiseXOR(s[half]))
    begun = convs.select("conv_id", "head", F.explode("head").alias("s")).select("conv_id", F.col("s.pos").alias("depth"), F.col("s.chars").alias("chars"), F.col("s.x1").alias("x1"), F.col("s.x2").alias("x2"), upto("x1").alias("k1"), upto("x2").alias("k2"))
    both = begun.unionByName(own.select(*begun.columns))
    steps = both.select("conv_id", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"), "chars")
    lengths = convs.select("conv_id", (F.col("held") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("int").alias("length"))
    return steps, lengths


def nodes_of(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each node: id, key, parent key, conv_id (smallest member), n_convs, chars, n_children, first_child."""
    zero = F.lit(0).cast("long")
    found = steps.groupBy(*_KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    found = found.select(F.struct(*_KEY).alias("key"), F.struct((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).alias("parent"), "conv_id", "n_convs", "chars")
    root = lengths.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.struct(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2")).alias("key"), F.lit(None).cast(found.schema["parent"].dataType).alias("parent"), "conv_id", "n_convs", zero.alias("chars"))
    nodes = common.materialise(found.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.min_by("id", "conv_id").alias("first_child"))
    return common.materialise(nodes.join(kids, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-children")


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes with parent_id, parent_conv_id and the id of the next sibling; the root has none of them."""
    above = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("often"))
    below = common.join_by_key(nodes.where("parent IS NOT NULL"), above, "parent", "often", nodes.count())
    linked = ordered.followed(ordered.dealt(below, "siblings", ["parent_id"], ["conv_id"]), ["parent_id"], "conv_id", F.col("id"), "next_sibling").drop(ordered.PART)
    root = nodes.where("parent IS NULL").withColumns({c: F.lit(None).cast("long") for c in ("parent_id", "parent_conv_id", "next_sibling")})
    return common.materialise(linked.unionByName(root.select(*linked.columns)), "nodes-placed")


def arcs_of(nodes: DataFrame) -> DataFrame:
    """The tour as a linked list: arc (2 id to enter, 2 id + 1 to leave), next (negative at the end), and what the arc adds."""
    leave = F.col("id") * 2 + 1
    arcs = F.array(
        F.struct((F.col("id") * 2).alias("arc"), F.coalesce(F.col("first_child") * 2, leave).alias("next"), F.lit(1).cast("long").alias("rank"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")),
        F.struct(leave.alias("arc"), F.coalesce(F.col("next_sibling") * 2, F.col("parent_id") * 2 + 1, -1 - leave).alias("next"), F.lit(1).cast("long").alias("rank"), F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")),
    )
    return nodes.select(F.inline(arcs))


def ranked(arcs: DataFrame, n: int) -> DataFrame:
    """Each of the ``n`` arcs with the sums of rank, leaves and saved from it to the end of the tour."""
    spark = arcs.sparkSession
    sums = ("rank", "leaves", "saved")
    written: list[str] = []

    def write(df: DataFrame) -> DataFrame:
        written.append(common.fresh_path(spark, "tour"))
        df.write.parquet(written[-1])
        if len(written) > 2:
            common.delete_path(spark, written[-3])
        return spark.read.schema(df.schema).parquet(written[-1])

    tour, reach = write(arcs), 1
    while reach < n:
        ended = tour.where("next < 0")
        ahead = tour.select(F.col("arc").alias("next"), F.col("next").alias("_next"), *(F.col(c).alias(f"_{c}") for c in sums))
        moved = tour.where("next >= 0")
        for _ in range(JUMPS):
            # an arc that has reached the end points to a negative number of its own: it meets nothing, and no task gathers them
            on = moved.join(ahead, "next", "left")
            moved = on.select("arc", F.when(F.col("_next") >= 0, F.col("_next")).otherwise(-1 - F.col("arc")).alias("next"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums))
        tour = write(ended.unionByName(moved))
        reach *= JUMPS + 1
    return tour


_BLOCKS = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
_DIGESTS = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
    """Rows in order as (key, [remaining columns of one row])."""
    for batch in batches:
        for depth, k1, k2, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield (depth, k1, k2), rest


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to blocks (key, first conv_id, conv_ids joined by commas)."""
    out: list[tuple] = []
    key, ids = None, []
    for now, (conv_id,) in _runs(batches):
        if now != key or len(ids) >= BLOCK_IDS:
            if ids:
                out.append((*key, ids[0], ",".join(map(str, ids))))
            key, ids = now, []
            if len(out) >= BLOCK_IDS:
                yield _table(out, _BLOCKS)
                out = []
        ids.append(conv_id)
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
    if out:
        yield _table(out, _BLOCKS)


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to one digest a key; the state of a digest is all that is held."""
    out: list[tuple] = []
    key, state = None, None
    for now, (_, ids) in _runs(batches):
        if now != key:
            if key is not None:
                out.append((*key, state.hexdigest()))
                if len(out) >= BLOCK_IDS:
                    yield _table(out, _DIGESTS)
                    out = []
            key, state = now, hashlib.sha256()
        else:
            state.update(b",")
        state.update(ids.encode())
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield _table(out, _DIGESTS)


def ends_of(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """For each node at which conversations end: the SHA-256 of their conv_ids, ascending, joined by commas."""
    last = steps.join(lengths.withColumnRenamed("length", "depth"), ["conv_id", "depth"]).select(*_KEY, "conv_id")
    zero = F.lit(0).cast("long")
    turnless = lengths.where("length = 0").select(F.lit(0).alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id")
    ends = last.unionByName(turnless)
    blocks = ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(common.tidy(_join_ids), "depth int, k1 long, k2 long, first long, ids string")
    digests = blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(common.tidy(_digest_ids), "depth int, k1 long, k2 long, ends_sha256 string")
    return digests.select(F.struct(*_KEY).alias("key"), "ends_sha256")


def prefix_trie(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of the conversations whose paths are given: a row for each node, with what lies below it and
    the place of its arcs in the tour (enter_at, leave_at, from 0)."""
    steps = common.materialise(steps, "steps")
    nodes = placed(nodes_of(steps, lengths))
    n = 2 * nodes.count()
    tour = ranked(arcs_of(nodes), n)
    entered = F.col("arc") % 2 == 0
    signed = lambda c: F.sum(F.when(entered, F.col(c)).otherwise(-F.col(c)))
    at = lambda mine: F.lit(n) - F.max(F.when(mine, F.col("rank")))
    below = tour.groupBy((F.col("arc") - F.col("arc") % 2).alias("arc")).agg(signed("leaves").alias("n_leaves"), signed("saved").alias("saved_tokens"), at(entered).alias("enter_at"), at(~entered).alias("leave_at"))
    below = below.select((F.col("arc") / 2).cast("long").alias("id"), "n_leaves", "saved_tokens", "enter_at", "leave_at")
    none = F.lit(hashlib.sha256().hexdigest())
    out = nodes.join(below, "id").join(ends_of(steps, lengths), "key", "left")
    return out.select("conv_id", F.col("key.depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), "enter_at", "leave_at")


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of(common.read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    steps, lengths = paths(turns)
    return prefix_trie(steps, lengths).drop("enter_at", "leave_at")


OP13_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT c, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns FROM turns GROUP BY c),
crc(c, k, v) AS (
  SELECT c, 0, 4294967295::BIGINT FROM own
  UNION ALL
  SELECT c, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END
  FROM (SELECT c, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(c::VARCHAR, k // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE k < 8 * length(c::VARCHAR))),
heads AS (SELECT c, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE k = 8 * length(c::VARCHAR)),
rebuilt AS (
  SELECT own.c, list_concat(coalesce(base.turns[1:h], []), coalesce(own.turns[h + 1:], [])) AS turns
  FROM own JOIN heads USING (c) LEFT JOIN own AS base ON base.c = own.c - own.c % 100),
steps AS (SELECT c, d, turns[1:d] AS prefix, d = len(turns) AS ended FROM (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ended), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[d].t) END AS saved
  FROM steps GROUP BY d, prefix),
kids AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a.d, a.prefix, sum(b.saved) AS saved_tokens, sum(b.childless) AS n_leaves
  FROM (SELECT nodes.saved, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS childless, nodes.prefix AS whole, unnest(range(nodes.d + 1)) AS d
        FROM nodes LEFT JOIN kids ON kids.d = nodes.d AND kids.prefix = nodes.prefix) AS b
  JOIN nodes AS a ON a.d = b.d AND a.prefix = b.whole[1:b.d] GROUP BY a.d, a.prefix)
SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children,
  below.n_leaves::BIGINT AS n_leaves, below.saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below ON below.d = nodes.d AND below.prefix = nodes.prefix
LEFT JOIN kids ON kids.d = nodes.d AND kids.prefix = nodes.prefix
LEFT JOIN nodes AS up ON up.d = nodes.d - 1 AND up.prefix = nodes.prefix[1:nodes.d - 1]
"""
