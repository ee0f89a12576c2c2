"""12. Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns.  Its key is its depth and four sums, over its turns, of a part of the turn's SHA-256 times a
pseudo-random factor of the turn's place, modulo 2^31 - 1: sums go over the parts of a long conversation one by one.
The heavy child of a node is the one with most members (then the one with the smallest id); heavy children make up
paths.  A light child has half of its parent's members at most, so no conversation crosses more than log2 of them all.
What is summed over subtrees goes up in rounds, the paths below most light children first: a suffix sum along each path,
whose first entry is attached to the parent of the path's head, in a path of a later round.

No step needs a conversation, a path, a node's members or its children in one task: sums along more than CHUNK turns are
taken in chunks, keys with very many rows join by broadcast, and the ids that end at a node are joined piece by piece and hashed as a stream.

Turns are ordered by turn (null first), then role and text, so ties have one order; a null role or text is empty.
Repeated rows are turns of their own.  Rows without a conversation id are in none and left out.  Further columns don't matter.
An empty table gives an empty result.  Ids are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import hot_join, written

#: Rows that one window sums along at most.
CHUNK = 4096
#: Sums of a key, and their modulus.
SUMS, PRIME = 4, (1 << 31) - 1
KEY = ["depth", "k1", "k2"]


def running(rows: DataFrame, by: list[str], place: str, columns: dict[str, Column], of: Callable[[Column], Column], longest: int, chunk: int, down: bool = False) -> DataFrame:
    """rows with further columns: of (sum or max) of each column over the rows with the same `by` up to this place (down: from this place on).

    Places are distinct whole numbers; longest: how many a group has at most.  Beyond `chunk` of them the
    running values of chunks start from the chunks before.
    """
    order = F.col(place).desc() if down else F.col(place)
    up_to = lambda keys: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if longest <= chunk:
        return rows.withColumns({c: of(x).over(up_to(by)) for c, x in columns.items()})
    rows = written(rows.withColumns(columns).withColumn("chunk", F.floor(F.col(place) / chunk)), "chunks")
    earlier = Window.partitionBy(*by).orderBy(F.col("chunk").desc() if down else F.col("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*by, "chunk").agg(*[of(F.col(c)).alias(f"before_{c}") for c in columns])
    before = before.withColumns({f"before_{c}": of(F.col(f"before_{c}")).over(earlier) for c in columns})
    rows = rows.withColumns({c: of(F.col(c)).over(up_to([*by, "chunk"])) for c in columns}).join(before, [*by, "chunk"])
    both = lambda c: of_two(F.col(c), F.col(f"before_{c}"))
    of_two = (lambda x, y: F.greatest(x, y)) if of is F.max else (lambda x, y: x + F.coalesce(y, F.lit(0)))
    return rows.withColumns({c: both(c) for c in columns}).drop("chunk", *[f"before_{c}" for c in columns])


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (1 for the first turn), digest, n_bytes of every turn.

    Turns are dealt by ranges of the whole order, so a long conversation lies in many tasks; a turn's place is its place
    within its task's part of the conversation, after the parts of earlier tasks.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")
    rows = written(rows.select("conv_id", digest, F.octet_length("text").cast("long").alias("n_bytes"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "turns")
    parts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + 1 + F.col("before")).alias("pos"), "digest", "n_bytes")


def rebuilt(conversations: DataFrame, most: int = 9, group: int = 5) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, n_bytes) and members (conv_id) of the rebuilt conversations.

    Conversation c starts with the first h turns of conversation c - c % group, h being crc32 of c's digits % most, and goes on with
    its own turns after its first h.
    """
    turns = written(placed(conversations), "placed")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("k"))
    head = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).alias("h")
    convs = convs.select("conv_id", "k", head, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("k").alias("there"))
    convs = written(convs.join(lengths, "base", "left").withColumn("cut", F.least("h", F.coalesce("there", F.lit(0)))), "convs")
    own = hot_join(turns, convs.select("conv_id", "k", "h", "cut"), ["conv_id"], turns.count()).where("pos > h")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("pos <= h")
    columns = ["conv_id", "depth", "digest", "n_bytes"]
    return first.withColumnRenamed("pos", "depth").select(*columns).unionByName(own.withColumn("depth", F.col("cut") + F.col("pos") - F.col("h")).select(*columns)), convs.select("conv_id")


def joined_ids(ends: DataFrame) -> DataFrame:
    """KEY and the SHA-256 of the ids (ascending, joined by commas) of the rows with that key, for rows of KEY and conv_id."""
    schema = "depth long, k1 long, k2 long"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # in order: each key's ids of this batch are one piece
            out: dict[tuple, list[int]] = {}
            for *key, i in zip(*(b.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                out.setdefault(tuple(key), []).append(i)
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array([x[0] for x in out.values()], pa.int64()), pa.array([",".join(map(str, x)) for x in out.values()], pa.string())], [*KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            done = []
            for *key, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
                if key == now:
                    state.update(b",")
                else:
                    done += [(*now, state.hexdigest())] if now else []
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield rows(done)
        yield rows([(*now, state.hexdigest())] if now else [])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in done], pa.int64()) for i in range(3)), pa.array([x[3] for x in done], pa.string())], [*KEY, "ends_sha256"])

    ordered = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    parts = ordered.mapInArrow(pieces, f"{schema}, first long, ids string")
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashed, f"{schema}, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv_id, depth (1, 2, ...), digest (hex), n_bytes of the members' turns; members: conv_id, also of those without turns.
    """
    part = lambda i: F.conv(F.substring("digest", 1 + 7 * i, 7), 16, 10).cast("long")
    factor = lambda i: F.pmod(F.xxhash64(F.col("depth").cast("long"), F.lit(i)), F.lit(PRIME))
    terms = {f"t{i}": part(i) * factor(i) % PRIME for i in range(SUMS)}
    turns = written(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "n_bytes", *[x.alias(c) for c, x in terms.items()]), "terms")
    longest = turns.agg(F.max("depth")).first()[0] or 0
    sums = running(turns, ["conv_id"], "depth", {f"s{i}": F.col(f"t{i}") for i in range(SUMS)}, F.sum, longest, chunk)
    pack = lambda x, y: F.shiftleft(x % PRIME, 31).bitwiseOR(y % PRIME)
    s, before = [F.col(f"s{i}") for i in range(SUMS)], [F.col(f"s{i}") - F.col(f"t{i}") for i in range(SUMS)]
    rows = sums.select("conv_id", "depth", "n_bytes", pack(s[0], s[1]).alias("k1"), pack(s[2], s[3]).alias("k2"), pack(before[0], before[1]).alias("p1"), pack(before[2], before[3]).alias("p2"))
    zero = F.lit(0).cast("long")
    none = F.lit(None).cast("long")
    root = members.select(F.col("conv_id").cast("long").alias("conv_id"), *[zero.alias(c) for c in ("depth", "n_bytes", "k1", "k2")], none.alias("p1"), none.alias("p2"))
    rows = written(rows.unionByName(root), "rows")

    own = rows.groupBy(*KEY).agg(F.min("conv_id").alias("c"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_bytes").alias("n_bytes"))
    own = written(own, "own")
    best = F.max(F.struct("n_convs", (-F.col("c")).alias("last"), F.col("k1").alias("h1"), F.col("k2").alias("h2"))).alias("best")
    below = own.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), best)
    nodes = written(own.join(below, KEY, "left").select(*own.columns, F.coalesce("n_children", zero).alias("n_children"), "best.h1", "best.h2"), "nodes")
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("c").alias("parent_conv_id"), F.col("n_children").alias("k"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    marked = hot_join(nodes.where("depth > 0").drop("h1", "h2"), above, ["depth", "p1", "p2"], nodes.count())
    marked = marked.withColumn("light", (~((F.col("k1") == F.col("g1")) & (F.col("k2") == F.col("g2")))).cast("int"))
    columns = [*KEY, "c", "n_convs", "p1", "p2", "n_bytes", "n_children", "parent_conv_id", "light"]
    first = nodes.where("depth = 0").withColumns({"parent_conv_id": none, "light": F.lit(1)})
    marked = written(marked.select(*columns).unionByName(first.select(*columns)), "marked")

    along = hot_join(rows.select("conv_id", *KEY), marked.withColumn("k", F.col("n_convs")), KEY, rows.count())
    head = F.when(F.col("light") == 1, F.struct(F.col("depth").alias("hd"), F.col("k1").alias("h1"), F.col("k2").alias("h2")))
    along = running(running(along, ["conv_id"], "depth", {"head": head}, F.max, longest + 1, chunk), ["conv_id"], "depth", {"level": F.col("light")}, F.sum, longest + 1, chunk)
    # a node's smallest member passes each of its nodes once
    paths = written(along.where("conv_id = c").select(*columns, "head.*", "level").withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}), "paths")

    sums_of = ("n_leaves", "saved_tokens")
    attached, done = None, []
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        now = paths.where(F.col("level") == level)
        if attached is not None:
            now = now.join(attached, KEY, "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", zero) for c in sums_of}).select(*paths.columns)
        now = running(now, ["hd", "h1", "h2"], "depth", {c: F.col(c) for c in sums_of}, F.sum, longest + 1, chunk, down=True)
        done.append(written(now.select(*paths.columns), "level"))
        attached = done[-1].where("depth = hd and depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums_of])
    total = paths
    for i, x in enumerate(done):
        total = total.unionByName(x) if i else x
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last")).select("conv_id", "last.*")
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return total.join(joined_ids(last), KEY, "left").select(F.col("c").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)


def conversation_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(conversations), chunk)


#: Every node against all nodes below it, by the turns of its smallest member.
ORACLE = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
turns AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc),
parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, r, x FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, r, x FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h),
steps AS (SELECT conv_id, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM parts),
rows AS (
  SELECT conv_id, depth, x, list({'r': r, 'x': x}) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS key FROM steps
  UNION ALL SELECT conv_id, 0, '', [] FROM convs),
nodes AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(x) AS x FROM rows GROUP BY key, depth),
ups AS (SELECT n.key, p.key AS up, q.conv_id AS parent_conv_id FROM nodes n JOIN rows p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.key = p.key AND q.depth = p.depth),
kids AS (SELECT up AS key, count(*) AS n FROM ups GROUP BY up),
facts AS (SELECT n.*, u.parent_conv_id, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN ups u USING (key) LEFT JOIN kids k USING (key)),
sums AS (
  SELECT a.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * strlen(f.x))::BIGINT AS saved
  FROM facts f JOIN rows a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.key),
lasts AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(key, depth) AS key FROM rows GROUP BY conv_id) GROUP BY key)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(coalesce(l.ids, '')) AS ends_sha256
FROM facts f JOIN sums s USING (key) LEFT JOIN lasts l USING (key)
"""
