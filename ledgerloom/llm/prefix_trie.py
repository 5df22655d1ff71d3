"""Operator 11: the trie of conversations that begin alike, by rolling prefix fingerprints.

1. Turns are numbered within their conversation over range partitions, so that a hot conversation fills many tasks.
2. A prefix's fingerprint is the sum of hash(turn) * BASE^depth mod a prime. Blocks of ``BLOCK`` turns are scanned with numpy; sums of
   earlier blocks are added where a conversation has more than one.
3. Prefixes of one depth and fingerprint are candidates for one node. Every group is verified: all members must have their parents' key
   and their last turn (its bytes) from the group's representative. By induction over depth they are then equal turn by turn. Groups
   that fail are split by what differs, what lies below them follows, and verification runs again.
4. Sums over subtrees need no step per level. A node belongs to its smallest member, and the nodes that one conversation owns are the
   end of its path. So each conversation sums its own nodes from its end upwards (a scan in blocks), and each node adds what its
   members have at its depth.

What meets in one task is bounded: groups (a first turn that a third of all conversations share, or the root) are aggregated before the
shuffle; their members meet nodes by (conversation, depth), a key of one row; the ids of conversations that end in one node pass one task as
a stream of chunks, as SHA-256 reads in order, never as rows.

Defined results: a null role or text is empty; a null turn comes first; of turns that tie, role, then the text's first 64 characters,
then its hash decide; rows of a null conv_id are left out; rows that repeat are turns of their own; a conversation whose rebuilt form has
no turn ends in the root; an empty table has no nodes; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.scans import laid_out, running

from .common import bounded_batches, materialize

PRIME = (1 << 61) - 1
BASE = 0x1B873593CC9E2D51 % PRIME
#: Turns of one conversation that a task scans at a time.
BLOCK = 4096
#: A conversation takes the first turns of the conversation that opens its group of so many ids, fewer than HEAD of them.
GROUP, HEAD = 5, 9
#: Bytes of a chunk of ids.
CHUNK = 1 << 16
KEY = ["depth", "fp", "tag"]
NOTHING = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame) -> DataFrame:
    """Written rows (conv_id, pos from 1, item, n_bytes, place) and the turns' role and text by ``place``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    turns = turns.select("*", F.xxhash64("role", "text").alias("item"), F.octet_length("text").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    return laid_out(turns, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("item"), F.col("row")], sized=False).drop("turn", "row")


def positions(turns: DataFrame) -> DataFrame:
    return materialize(running(turns.drop("role", "text"), ["conv_id"], {"pos": ("count", None)}, sized=False).drop("part"), "positions")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c as the first h turns of the one that opens its group, then its own after its first h: rows of turns, and the
    roster (conv_id, total). ``turns`` as from ``positions``."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))
    roster = lengths.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("opens"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h"))
    roster = roster.join(lengths.select(F.col("conv_id").alias("opens"), F.col("own").alias("there")), "opens", "left")
    head = F.least("h", F.coalesce("there", F.lit(0)))
    roster = materialize(roster.select("conv_id", "opens", "h", head.alias("head"), (head + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "roster")
    own = turns.join(roster.select("conv_id", "h", "head", "total"), "conv_id").where("pos > h").withColumn("depth", F.col("head") + F.col("pos") - F.col("h"))
    first = turns.where(F.col("pos") < HEAD).withColumnRenamed("conv_id", "opens").join(roster.where("head > 0"), "opens").where("pos <= head").withColumn("depth", F.col("pos"))
    columns = ["conv_id", "depth", "item", "n_bytes", "place", "total"]
    return own.select(columns).unionByName(first.select(columns)), roster.select("conv_id", "total")


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are, in the form of ``rebuilt``."""
    roster = materialize(turns.groupBy("conv_id").agg(F.max("pos").alias("total")), "roster")
    return turns.join(roster, "conv_id").withColumnRenamed("pos", "depth"), roster


def multiply(a: np.ndarray, b: np.ndarray, prime: int) -> np.ndarray:
    """a * b mod prime, for factors below it: for 2^61 - 1 by halves of 32 bits, of whose products the bits from 61 on are added at the bottom."""
    if prime != PRIME:
        if prime >= 1 << 31:
            raise ValueError("a prime other than 2^61 - 1 must be below 2^31")
        return a * b % np.uint64(prime)
    low, mask = np.uint64((1 << 32) - 1), np.uint64(PRIME)
    a1, a0, b1, b0 = a >> np.uint64(32), a & low, b >> np.uint64(32), b & low
    fold = lambda x: (x & mask) + (x >> np.uint64(61))
    middle = fold(a1 * b0 + a0 * b1)  # times 2^32
    middle = fold((middle >> np.uint64(29)) + ((middle & np.uint64((1 << 29) - 1)) << np.uint64(32)))
    total = fold(fold(a1 * b1 << np.uint64(3)) + middle + fold(a0 * b0))
    return np.where(total >= mask, total - mask, total)


def powers(n: np.ndarray, base: int, prime: int) -> np.ndarray:
    """base^n mod prime, by squaring."""
    out, square, left = np.ones(len(n), np.uint64), base % prime, n.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), multiply(out, np.full(len(n), square, np.uint64), prime), out)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def prefix_sums(values: np.ndarray, starts: np.ndarray, carry: int, prime: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums mod prime before and with each value; they begin anew where ``starts`` says so, at first with ``carry``."""
    half = np.uint64((1 << 31) - 1)
    low, high = np.cumsum(values & half, dtype=np.uint64), np.cumsum(values >> np.uint64(31), dtype=np.uint64)
    last = np.maximum.accumulate(np.where(starts, np.arange(len(values)), -1))
    less = lambda x: x - np.where(last > 0, x[np.maximum(last - 1, 0)], 0).astype(np.uint64)
    low, high, p = less(low), less(high), np.uint64(prime)
    shift = np.full(len(values), (1 << 31) % prime, np.uint64)
    total = (multiply(high % p, shift, prime) + low % p + np.where(last < 0, np.uint64(carry), np.uint64(0))) % p
    before = (total + p - values) % p
    return before, total


def fingerprints(steps: DataFrame, prime: int, block: int) -> DataFrame:
    """``steps`` with the fingerprint ``fp`` of the prefix that ends there and that of its parent, ``pfp``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, carry = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, depth = batch["conv_id"].to_numpy(), batch["depth"].to_numpy()
            of = (depth - 1) // block
            values = multiply(batch["item"].to_numpy().view(np.uint64) % np.uint64(prime), powers(depth, BASE, prime), prime)
            starts = np.concatenate([[(conv[0], of[0]) != open_], (conv[1:] != conv[:-1]) | (of[1:] != of[:-1])])
            before, after = prefix_sums(values, starts, carry, prime)
            open_, carry = (conv[-1], of[-1]), int(after[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before.view(np.int64)), pa.array(after.view(np.int64))], names=[*batch.schema.names, "pfp", "fp"])

    dealt = steps.select("conv_id", "depth", "item", "n_bytes", "place", "total", F.expr(f"(depth - 1) div {block}").alias("block")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "depth")
    scanned = dealt.mapInArrow(scan, "conv_id long, depth long, item long, n_bytes long, place long, total long, block long, pfp long, fp long")
    scanned = materialize(scanned.drop("item"), "scanned")
    long = scanned.where(F.col("total") > block)
    ends = long.groupBy("conv_id", "block").agg(F.max_by("fp", "depth").cast("decimal(20,0)").alias("sum"))
    ends = running(ends, ["conv_id"], {"upto": ("sum", "sum")}, part="block", place="block", sized=False).select("conv_id", "block", ((F.col("upto") - F.col("sum")) % prime).cast("long").alias("carry"))
    more = lambda c: ((F.col(c) + F.col("carry")) % prime).alias(c)
    columns = [c for c in scanned.columns if c not in ("pfp", "fp")]
    carried = long.join(ends, ["conv_id", "block"]).select(*columns, more("pfp"), more("fp"))
    return scanned.where(F.col("total") <= block).unionByName(carried)


def groups_of(rows: DataFrame) -> DataFrame:
    """One row for each key: members, the smallest one, and the least and largest parent and turn."""
    parent = F.struct("pfp", "ptag")
    return rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(parent).alias("parent"), F.max(parent).alias("other_parent"),
        F.min("place").alias("place"), F.max("place").alias("other_place"), F.max("n_bytes").alias("n_bytes"),
    )


def unverified(rows: DataFrame, groups: DataFrame, turns: DataFrame) -> DataFrame:
    """Keys whose members do not all have one parent and one last turn. Members that share the row of their turn need no look at its text."""
    differ = rows.select(*KEY, "place").join(groups.where("place < other_place").select(*KEY), KEY).select(*KEY, "place")
    turn = F.struct("role", "text")
    turns_of = differ.join(turns.select("place", "role", "text"), "place").groupBy(*KEY).agg(F.min(turn).alias("one"), F.max(turn).alias("other"))
    return groups.where("parent != other_parent").select(*KEY).unionByName(turns_of.where("one != other").select(*KEY)).distinct()


def split(rows: DataFrame, bad: DataFrame, turns: DataFrame) -> DataFrame:
    """``rows`` with new tags: members of a bad group are told apart by parent and turn, and what follows a split carries its tag."""
    what = [*KEY, "pfp", "ptag", "role", "text"]
    members = materialize(rows.join(bad, KEY).select("conv_id", "place", *what[:-2]), "members").join(turns.select("place", "role", "text"), "place")
    classes = members.groupBy(*what).agg(F.concat_ws(":", "depth", F.min("conv_id")).alias("new"))
    marks = materialize(members.join(classes, what).select("conv_id", "depth", "new"), "marks")
    later = marks.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("new").alias("above"))
    marked = rows.join(marks, ["conv_id", "depth"], "left").join(later, ["conv_id", "depth"], "left")
    ran = running(materialize(marked, "marked"), ["conv_id"], {"newest": ("last", "new"), "newest_above": ("last", "above")}, part="block", place="depth", sized=False)
    return ran.select(*[c for c in rows.columns if c not in ("tag", "ptag")], F.coalesce("newest", "tag").alias("tag"), F.coalesce("newest_above", "ptag").alias("ptag"))


def end_digests(ends: DataFrame) -> DataFrame:
    """For each key the SHA-256 of its conversations' decimal ids, ascending, joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[c] for c in KEY]
            ids = batch["conv_id"].to_numpy()
            depth, fp, tag = batch["depth"].to_numpy(), batch["fp"].to_numpy(), np.asarray(batch["tag"].to_pylist(), object)
            new = np.flatnonzero((depth[1:] != depth[:-1]) | (fp[1:] != fp[:-1]) | (tag[1:] != tag[:-1])) + 1
            cuts = [0, *new.tolist(), len(ids)]
            cuts = sorted({*cuts, *range(0, len(ids), CHUNK // 8)})
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:], strict=False)]
            at = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([*(k.take(at) for k in keys), pa.array(ids[cuts[:-1]]), pa.array(texts)], names=[*KEY, "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running_hash, done = None, None, []
        for batch in batches:
            for *own, ids in zip(*(batch[c].to_pylist() for c in (*KEY, "ids")), strict=True):
                if own == key:
                    running_hash.update(f",{ids}".encode())
                    continue
                if key:
                    done.append((*key, running_hash.hexdigest()))
                key, running_hash = own, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*KEY, "ends_sha256"])
                done = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, running_hash.hexdigest())], names=[*KEY, "ends_sha256"])

    by = [*KEY, "conv_id"]
    cut = ends.select(by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(chunks, "depth long, fp long, tag string, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, "depth long, fp long, tag string, ends_sha256 string")


def nodes_of(steps: DataFrame, roster: DataFrame, turns: DataFrame, prime: int = PRIME, block: int = BLOCK) -> DataFrame:
    """All nodes of the trie: those of ``prefix_trie`` and ``place``, the row in ``turns`` of a node's last turn (-1 for the root)."""
    none = F.lit("")
    rows = fingerprints(steps, prime, block).select("*", none.alias("tag"), none.alias("ptag"))
    zero = lambda *names: [F.lit(x).cast("long").alias(n) for n, x in names]
    roots = roster.select("conv_id", *zero(("depth", 0), ("n_bytes", 0), ("place", -1)), F.col("total").cast("long"), *zero(("block", -1), ("pfp", -1), ("fp", 0)), none.alias("tag"), none.alias("ptag"))
    rows = rows.unionByName(roots)
    while True:
        groups = materialize(groups_of(rows), "groups")
        bad = materialize(unverified(rows, groups, turns), "unverified")
        if bad.isEmpty():
            break
        rows = materialize(split(rows, bad, turns), "rows")

    children = groups.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent.pfp").alias("fp"), F.col("parent.ptag").alias("tag")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = groups.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.select(*KEY, "conv_id", "n_convs", "n_children", "parent", "place", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved")), "nodes")

    owned = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    path = rows.select("conv_id", *KEY, (-F.col("block")).alias("part"), (-F.col("depth")).alias("up")).join(owned, ["conv_id", "depth"], "left").fillna(0, ["leaf", "saved"])
    path = running(path, ["conv_id"], {"n_leaves": ("sum", "leaf"), "saved_tokens": ("sum", "saved")}, part="part", place="up", sized=False)
    below = path.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    full = nodes.join(below, KEY).join(end_digests(rows.where("depth = total")), KEY, "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("tag").alias("ptag"), F.col("conv_id").alias("parent_conv_id"))
    full = full.select("*", F.col("parent.pfp").alias("pfp"), F.col("parent.ptag").alias("ptag")).join(above, ["depth", "pfp", "ptag"], "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "place")


def prefix_trie(conversations: DataFrame, rebuild: bool = True, prime: int = PRIME, block: int = BLOCK) -> DataFrame:
    """One row for each node, named by its depth and conv_id, the smallest member: parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (bytes that members share with the node's first), ends_sha256, and role and text of the last turn."""
    bounded_batches(conversations)
    turns = number_turns(conversations)
    steps, roster = (rebuilt if rebuild else as_given)(positions(turns))
    return nodes_of(steps, roster, turns, prime, block).join(turns.select("place", "role", "text"), "place", "left").drop("place")


def trie_shape(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` without texts, which are then not read again."""
    bounded_batches(conversations)
    turns = number_turns(conversations)
    return nodes_of(*rebuilt(positions(turns)), turns).drop("place")


#: Nodes by their path of turn digests; the CRC-32 is worked out bit by bit.
SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS opens,
         xor(4294967295::BIGINT, list_reduce(
           list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (
  SELECT l.conv_id, l.opens, l.h, least(l.h, coalesce(m.own, 0)) AS head, least(l.h, coalesce(m.own, 0)) + greatest(l.own - l.h, 0) AS total
  FROM l LEFT JOIN l AS m ON m.conv_id = l.opens),
s AS (
  SELECT t.conv_id, head + pos - h AS depth, role, text FROM t JOIN r ON t.conv_id = r.conv_id WHERE pos > h
  UNION ALL SELECT r.conv_id, pos, role, text FROM t JOIN r ON t.conv_id = r.opens WHERE pos <= head),
p AS (
  SELECT conv_id, depth, text, string_agg(sha256(sha256(role) || sha256(text)), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
  UNION ALL SELECT conv_id, 0, '', '' FROM r),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS saved FROM p GROUP BY depth, path),
k AS (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
b AS (
  SELECT a.path, count(*) FILTER (k.path IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM n LEFT JOIN k ON k.path = n.path JOIN p AS a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.path),
e AS (SELECT p.path, sha256(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id)) AS ends_sha256 FROM p JOIN r ON p.conv_id = r.conv_id AND p.depth = r.total GROUP BY p.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM n JOIN b ON b.path = n.path LEFT JOIN k ON k.path = n.path LEFT JOIN e ON e.path = n.path
LEFT JOIN n AS up ON n.depth > 0 AND up.path = substr(n.path, 1, 64 * (n.depth - 1))
"""
