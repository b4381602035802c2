"""Prefix trie of conversations from mergeable partial tries.

Conversations are rebuilt first: ``h`` original turns of the conversation that opens its family of 20, then its own turns
after its first ``h`` (``h``: CRC-32 of the decimal id, modulo 4).

1. Turns become digests and numbers of words, ordered once by (conversation, turn) over a range partitioning: a conversation
   of any length is spread over as many partitions as its turns fill.  Places in a conversation are differences of row
   numbers, which need only the number of rows of each partition.
2. A node's key is the exclusive-or of two hashes of (place, digest) over its prefix: running within a partition, carried
   over for the conversations that cross a border (two rows a partition at most).
3. Each partition combines its prefixes into a partial trie: key, depth, members, least member, list of ends.  Partial tries
   merge by key: members and ends add up, least members compete; as partitions follow each other in order of ids, lists
   of ends are concatenated, never sorted.
4. The least member of a node owns it, and with it the stretch from its first owned node down to its own end.  The rollup
   sums each member's path from its end upwards within partial tries, then merges them by key: what a member adds to a
   node (a leaf, a child, words shared below) depends on that member's stretch alone, so no round for each level is needed.

Only the SHA-256 of a node's ends is made by one task for a node, as that hash is defined from front to back; it is
streamed, list after list, and never held.  Keys have 128 bits; equal keys are taken for equal sequences.

Defined results: a null role or text counts as empty; a null turn comes first; rows of equal turn are taken in order of the
SHA-256 of role and text (so repeated rows are turns of their own); rows without conv_id are left out; ``%`` has the sign
of the id; texts of any length are read whole; an empty table has no node, not even a root; columns besides conv_id, turn,
role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Conversations of a family, of which the first opens the others; turns taken from it at most.
FAMILY, HEAD = 20, 3


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn: the role's length, role and text."""
    return F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text).cast("binary"), 256)


def taken(conv_id: Column) -> Column:
    """Turns that a conversation takes from the one that opens its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("long")


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id, x (digest), words, pid, at (row number over all); conversations with their first row number and size."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("x")]
    rows = turns.repartitionByRange(n, *by).sortWithinPartitions(*by)
    rows = rows.select("conv_id", "x", "words", F.spark_partition_id().alias("pid"),
                       F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at"))
    rows = shared.table(rows, "ordered")
    # a row for each partition
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("pid").agg(F.count("*").alias("n"))
    counts = counts.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = rows.join(F.broadcast(counts), "pid").withColumn("at", F.col("at") + F.col("before")).drop("before")
    ends = [F.count("*").alias("n"), F.min("at").alias("start"), F.min("pid").alias("pid"), F.max("pid").alias("last")]
    return rows, shared.table(rows.groupBy("conv_id").agg(*ends), "convs")


def rebuilt(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """pid, conv_id, depth, x, words of each rebuilt conversation, from the root (depth 0, x null) on."""
    heads = rows.where(F.col("conv_id") % FAMILY == 0).join(convs.select("conv_id", "start", "n"), "conv_id")
    heads = heads.withColumn("at", F.col("at") - F.col("start")).where(F.col("at") < HEAD)  # three rows a conversation
    head = F.sort_array(F.collect_list(F.struct("at", "x", "words"))).alias("head")
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(head)
    h = taken(F.col("conv_id"))
    known = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    known = known.join(heads, "base", "left").withColumn("b", F.least("h", F.coalesce(F.size("head"), F.lit(0))))
    known = shared.table(known.select("conv_id", "pid", "start", "h", "b", "head"), "known")
    root = F.array(F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).cast("long").alias("words")))
    turns = F.transform(F.slice("head", 1, F.col("b").cast("int")), lambda t: F.struct(t.x.alias("x"), t.words.alias("words")))
    first = F.concat(root, F.coalesce(turns, F.array().cast("array<struct<x:string,words:bigint>>")))
    first = known.select("pid", "conv_id", F.posexplode(first).alias("depth", "t"))
    own = rows.join(known.select("conv_id", "start", "h", "b"), "conv_id").where("at - start >= h")
    own = own.select("pid", "conv_id", F.expr("at - start - h + b + 1").alias("depth"), "x", "words")
    return first.select("pid", "conv_id", F.col("depth").cast("long"), "t.x", "t.words").unionByName(own)


def keyed(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """pid, conv_id, depth, words, upto (words down to the node), last, a and b (key)."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here = Window.partitionBy("pid", "conv_id").orderBy("depth")
    one = F.when(F.col("x").isNull(), F.lit(0)).otherwise(F.xxhash64("x", "depth"))
    two = F.when(F.col("x").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit("second"), "depth", "x"))
    local = turns.repartition(n, "pid").select(
        "pid", "conv_id", "depth", "words", F.sum("words").over(here).alias("upto"),
        F.bit_xor(one).over(here).alias("a"), F.bit_xor(two).over(here).alias("b"),
    )
    local = shared.table(local, "local")
    # conversations that cross a border between partitions: two rows a partition at most
    crossing = F.broadcast(convs.where("pid < last").select("conv_id"))
    sums = local.join(crossing, "conv_id").groupBy("conv_id", "pid").agg(
        *[F.max_by(c, "depth").alias(c) for c in ("upto", "a", "b")], F.max("depth").alias("end")
    )
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "conv_id", "pid", F.sum("upto").over(before).alias("w"), F.bit_xor("a").over(before).alias("ca"),
        F.bit_xor("b").over(before).alias("cb"), F.max("end").over(Window.partitionBy("conv_id")).alias("end")
    )
    x = local.join(F.broadcast(sums), ["conv_id", "pid"], "left")
    ends = F.coalesce("end", F.max("depth").over(Window.partitionBy("pid", "conv_id")))
    zero = F.lit(0).cast("long")
    return x.repartition(n, "pid").select(
        "pid", "conv_id", "depth", "words", (F.col("upto") + F.coalesce("w", zero)).alias("upto"),
        (F.col("depth") == ends).alias("last"), F.col("a").bitwiseXOR(F.coalesce("ca", zero)).alias("a"),
        F.col("b").bitwiseXOR(F.coalesce("cb", zero)).alias("b"),
    )


def _hashes(lists: DataFrame) -> DataFrame:
    """a, b, ends_sha256 from lists of ends by partition: streamed in order, one hash at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, done = None, None, []

        def out() -> pa.RecordBatch:
            a, b, s = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.string())], ["a", "b", "ends_sha256"]
            )

        for batch in batches:
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ends")), strict=True):
                if (a, b) != key:
                    if key:
                        done.append((*key, sha.hexdigest()))
                    key, sha, comma = (a, b), hashlib.sha256(), ""
                sha.update((comma + ",".join(map(str, ids))).encode())
                comma = ","
            if len(done) > 4096:
                yield out()
        if key:
            done.append((*key, sha.hexdigest()))
            yield out()

    parts = lists.repartition("a", "b").sortWithinPartitions("a", "b", "pid")
    return parts.select("a", "b", "ends").mapInArrow(each, "a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A table in the shared folder.
    """
    shared.prepare(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    with shared.scratch() as keep:
        turns = conversations.where("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long"), "turn", digest(role, text).alias("x"), words
        )
        rows, convs = ordered(shared.table(turns, "turns"))
        paths = shared.table(keyed(rebuilt(rows, convs), convs), "paths")
        # partial tries: the rows of a partition stand together already
        ends = F.sort_array(F.collect_list(F.when(F.col("last"), F.col("conv_id")))).alias("ends")
        partial = paths.repartition("pid").groupBy("pid", "a", "b").agg(
            F.first("depth").alias("depth"), F.count("*").alias("n"), F.min("conv_id").alias("owner"), ends
        )
        partial = shared.table(partial, "partial")
        nodes = partial.groupBy("a", "b").agg(
            F.first("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("owner").alias("owner"),
            F.sum(F.size("ends")).alias("n_ends"),
        )
        nodes = shared.table(nodes, "nodes")
        # stretches: from the first node that a conversation owns; those that own none share their whole path
        chains = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
            F.min("depth").alias("own"), F.max(F.col("n_convs") == F.col("n_ends")).alias("leaf")
        )
        known = paths.where("last").select("conv_id", F.col("depth").alias("end")).join(chains, "conv_id", "left")
        known = known.select("conv_id", F.coalesce("own", F.col("end") + 1).alias("own"), "end",
                             F.coalesce("leaf", F.lit(False)).alias("leaf"))
        known = shared.table(known, "chains")
        top = paths.join(known, "conv_id").where("depth = own - 1")
        top = shared.table(top.select("conv_id", F.col("upto").alias("shared"), "a", "b"), "tops")
        known = known.join(top.select("conv_id", "shared"), "conv_id", "left")
        rolled = paths.join(known, "conv_id").select(
            "pid", "a", "b", F.col("leaf").cast("long").alias("leaf"),
            ((F.col("depth") + 1 >= F.col("own")) & (F.col("depth") < F.col("end"))).cast("long").alias("child"),
            F.when(F.col("depth") < F.col("own"), F.col("shared") - F.col("upto") + F.col("words")).otherwise(0).alias("saved"),
        )
        sums = [F.sum(c).alias(c) for c in ("leaf", "child", "saved")]
        rolled = rolled.groupBy("a", "b").agg(*sums)
        hashes = _hashes(partial.where("size(ends) > 0").select("pid", "a", "b", "ends"))
        parents = top.join(nodes.select("a", "b", F.col("owner").alias("parent")), ["a", "b"])
        first = nodes.join(
            known.join(parents.select("conv_id", "parent"), "conv_id", "left").select(
                F.col("conv_id").alias("owner"), "own", "parent"
            ), "owner"
        )
        out = first.join(rolled, ["a", "b"]).join(hashes, ["a", "b"], "left")
        nothing = F.lit(hashlib.sha256().hexdigest())
        return keep(shared.table(out.select(
            F.col("owner").alias("conv_id"), "depth",
            F.when(F.col("depth") > F.col("own"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
            "n_convs", F.col("child").alias("n_children"), F.col("leaf").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        ), "trie"))


_CODES = "list_transform(string_split(CAST({} AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))"
_STEP = "list_reduce(range(8), lambda y, j: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(v, w))"


def crc32_sql(value: str) -> str:
    """SQL for the unsigned CRC-32 of a value's ASCII text."""
    return f"xor(4294967295, list_reduce({_CODES.format(value)}, lambda v, w: {_STEP}, CAST(4294967295 AS BIGINT)))"


ORACLE = rf"""
WITH raw AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
dig AS (SELECT conv_id, turn, sha256(concat_ws(':', CAST(length(role) AS VARCHAR), role, text)) AS x, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM raw),
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, x) AS pos, x, words FROM dig),
cv AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql('conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
cb AS (SELECT cv.*, coalesce(least(h, n), 0) AS b FROM cv LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM own GROUP BY 1) USING (base)),
rb AS (SELECT conv_id, 0 AS d, '' AS x, 0 AS words FROM cb
 UNION ALL SELECT cb.conv_id, pos, x, words FROM cb JOIN own ON own.conv_id = cb.base AND pos <= b
 UNION ALL SELECT cb.conv_id, pos - h + b, x, words FROM cb JOIN own ON own.conv_id = cb.conv_id AND pos > h),
pt AS (SELECT conv_id, d, words, string_agg(x, '/') OVER w AS path, d = max(d) OVER (PARTITION BY conv_id) AS last FROM rb WINDOW w AS (PARTITION BY conv_id ORDER BY d)),
nd AS (SELECT path, min(d) AS depth, min(conv_id) AS owner, count(*) AS n, min(words) AS words, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends FROM pt GROUP BY path),
par AS (SELECT DISTINCT a.path, b.path AS parent FROM pt a JOIN pt b ON a.conv_id = b.conv_id AND b.d = a.d - 1),
kids AS (SELECT parent AS path, count(*) AS k FROM par GROUP BY 1),
ent AS (SELECT DISTINCT a.path, b.path AS below FROM pt a JOIN pt b ON a.conv_id = b.conv_id AND b.d >= a.d),
sub AS (SELECT ent.path, sum((nd.n - 1) * nd.words) AS saved, count(*) FILTER (kids.k IS NULL) AS leaves FROM ent JOIN nd ON nd.path = ent.below LEFT JOIN kids ON kids.path = ent.below GROUP BY 1)
SELECT nd.owner AS conv_id, CAST(nd.depth AS BIGINT) AS depth, up.owner AS parent_conv_id, nd.n AS n_convs, coalesce(kids.k, 0) AS n_children, sub.leaves AS n_leaves,
 CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(nd.ends, '')) AS ends_sha256
FROM nd JOIN sub USING (path) LEFT JOIN kids USING (path) LEFT JOIN par USING (path) LEFT JOIN nd up ON up.path = par.parent
"""
