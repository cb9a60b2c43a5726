"""The prefix trie of rebuilt conversations, by composable fingerprints.

A run of turns is an element of a monoid: its length n and, in each of four lanes, the sum of v_i * B^i modulo a prime,
where v_i is the digest of its i-th turn. Two runs put together are (n1 + n2, s1 + B^n1 * s2), and what stands behind
a run's first h turns is again got from two sums. So the fingerprint of every prefix of a rebuilt conversation is
composed from its base's head and its own turns' sums, and no rebuilt text is ever made. Prefixes of one length and
fingerprint are one node; each holds a reference to its last turn.

That fingerprints don't lie is checked: turns with one digest are compared byte by byte, and all members of a node
must have the same last turn. As lanes can be solved for the sum before the last turn, equal prefixes follow by
induction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm.common import keep, spread_join, table

#: The four largest primes below 2^31, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525003, 1566083941, 1812433253)
LANES = [f"s{k}" for k in range(4)]
#: Conversations go in families of so many ids, whose first one is the base; h is below ``MOST_HEAD + 1``.
FAMILY, MOST_HEAD = 5, 8
#: Turns of a conversation that one window orders.
BUCKET = 4096
#: Ids in one piece of a node's list.
IDS = 1024


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, c1, c2 (120 bits of the digest of role and text), bytes (of the text), framed (role and text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.octet_length(text).cast("long").alias("bytes"), F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("framed"))
    sha = F.sha2("framed", 256)
    part = lambda i: F.conv(F.substring(sha, i, 15), 16, 10).cast("long")
    return rows.select("conv_id", "turn", part(1).alias("c1"), part(16).alias("c2"), "bytes", "framed")


def digests_hold(turns: DataFrame) -> bool:
    """Whether all turns with one digest are equal, byte by byte: then the least of them is the greatest."""
    same = turns.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min("framed").alias("low"), F.max("framed").alias("high"))
    return same.filter("n > 1 and low != high").isEmpty()


def local_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a partition's sorted turns: pos (from 1) and s0 to s3 count from where a conversation begins in it."""
    part, at, last, pos, held = TaskContext.get().partitionId(), 0, None, 0, [0] * 4
    powers = [np.ones(1, np.int64) for _ in PRIMES]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, c1, c2 = (np.asarray(batch.column(k)) for k in range(3))
        new = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
        begun = np.full(n, -pos, np.int64)  # where the conversation at hand begins, in rows of this batch
        begun[new] = new
        begun = np.maximum.accumulate(begun)
        place = np.arange(n) - begun + 1
        out = []
        for k, (p, base) in enumerate(zip(PRIMES, BASES)):
            while len(powers[k]) <= place.max():  # twice as many each time
                step = int(powers[k][-1]) * base % p
                powers[k] = np.concatenate([powers[k], powers[k] * step % p])
            value = ((c1, c2)[k // 2] >> (30 * (k % 2))) & ((1 << 30) - 1)
            sums = np.cumsum(value * powers[k][place] % p)
            start = np.where(begun < 0, 0, begun)
            before = np.where(start > 0, sums[start - 1], 0)
            out.append((sums - before + np.where(begun < 0, held[k], 0)) % p)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), batch.column(0), pa.array(place), *[pa.array(s) for s in out], *[batch.column(k) for k in (1, 2, 3)]], ["part", "at", "conv_id", "pos", *LANES, "c1", "c2", "bytes"])
        at, last, pos, held = at + n, conv[-1], int(place[-1]), [int(s[-1]) for s in out]


def prefix_sums(turns: DataFrame) -> DataFrame:
    """conv_id, idx (from 1, by turn, null first; ties by digest), s0 to s3 up to this turn, c1, c2, bytes.

    Turns are dealt by ranges, so one conversation may lie in many parts. What a part gives of the conversation at its
    end is one element, and the elements of the parts before are put together on the driver: a row a partition.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("c1"), F.col("c2")]
    rows = turns.select("conv_id", "c1", "c2", "bytes", "turn").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = keep(rows.mapInArrow(local_sums, "part int, at long, conv_id long, pos long, s0 long, s1 long, s2 long, s3 long, c1 long, c2 long, bytes long"), "trie-sums")
    ends = rows.groupBy("part").agg(F.min(F.struct("at", "conv_id")).alias("first"), F.max(F.struct("at", "conv_id", "pos", *LANES)).alias("last")).orderBy("part").collect()
    carried, conv, n, sums = [], None, 0, [0] * 4
    for r in ends:
        own, first = r["last"], r["first"]["conv_id"]
        if first == conv:
            carried.append((r["part"], conv, n, *[pow(b, n, p) for p, b in zip(PRIMES, BASES)], *sums))
        if own["conv_id"] == conv:  # the whole part is this conversation's
            sums = [(s + pow(b, n, p) * own[c]) % p for s, c, p, b in zip(sums, LANES, PRIMES, BASES)]
            n += own["pos"]
        else:
            conv, n, sums = own["conv_id"], own["pos"], [own[c] for c in LANES]
    if not carried:
        return rows.select("conv_id", F.col("pos").alias("idx"), *LANES, "c1", "c2", "bytes")
    schema = "part int, conv_id long, n long, " + ", ".join(f"a{k} long" for k in range(4)) + ", " + ", ".join(f"b{k} long" for k in range(4))
    before = rows.sparkSession.createDataFrame(carried, schema)
    rows = rows.join(F.broadcast(before), ["part", "conv_id"], "left")
    sums = [F.when(F.col("n").isNull(), F.col(f"s{k}")).otherwise((F.col(f"b{k}") + F.col(f"a{k}") * F.col(f"s{k}")) % p).alias(f"s{k}") for k, p in enumerate(PRIMES)]
    return rows.select("conv_id", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("idx"), *sums, "c1", "c2", "bytes")


def head_size() -> Column:
    """How many of the base's turns a conversation begins with."""
    return F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)


def prefixes(sums: DataFrame) -> DataFrame:
    """conv_id, depth, f1, f2 (the fingerprint), last (the whole conversation), c1, c2, bytes of the last turn and its
    reference (ref_conv, ref_idx): every prefix of every rebuilt conversation, the empty one included."""
    lanes = F.struct(*LANES)
    own = sums.withColumn("h", head_size()).groupBy("conv_id", "h").agg(F.max("idx").alias("own"), F.max(F.when(F.col("idx") == F.col("h"), lanes)).alias("skip"))
    heads = sums.filter((F.col("conv_id") % FAMILY == 0) & (F.col("idx") <= MOST_HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("idx", *LANES, "c1", "c2", "bytes"))).alias("head"))
    whole = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    whole = whole.withColumn("hb", F.when(F.col("head").isNotNull(), F.least("h", F.size("head").cast("long"))).otherwise(F.lit(0).cast("long")))
    whole = whole.withColumn("length", F.col("hb") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    whole = whole.withColumn("head", F.when(F.col("hb") > 0, F.slice("head", 1, F.col("hb").cast("int"))))
    top = F.element_at("head", F.when(F.col("hb") > 0, F.col("hb").cast("int")))
    for k, (p, b) in enumerate(zip(PRIMES, BASES)):
        powers = F.array(*[F.lit(pow(b, e, p)) for e in range(-MOST_HEAD, MOST_HEAD + 1)])
        whole = whole.withColumn(f"m{k}", F.element_at(powers, (F.col("hb") - F.col("h") + MOST_HEAD + 1).cast("int")))
        whole = whole.withColumn(f"t{k}", F.coalesce(top[f"s{k}"], F.lit(0))).withColumn(f"k{k}", F.coalesce(F.col("skip")[f"s{k}"], F.lit(0)))
    whole = keep(whole.drop("skip"), "trie-whole")
    packed = lambda s: [F.shiftleft(s[0], 31).bitwiseOR(s[1]).alias("f1"), F.shiftleft(s[2], 31).bitwiseOR(s[3]).alias("f2")]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = whole.select("conv_id", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), (F.col("length") == 0).alias("last"), zero.alias("c1"), zero.alias("c2"), zero.alias("bytes"), none.alias("ref_conv"), none.alias("ref_idx"))
    taken = whole.select("conv_id", "length", "base", F.explode("head").alias("x"))
    taken = taken.select("conv_id", F.col("x.idx").alias("depth"), *packed([F.col(f"x.{c}") for c in LANES]), (F.col("x.idx") == F.col("length")).alias("last"), "x.c1", "x.c2", "x.bytes", F.col("base").alias("ref_conv"), F.col("x.idx").alias("ref_idx"))
    names = ["h", "hb", "length", *[f"{x}{k}" for x in "mtk" for k in range(4)]]
    rest = spread_join(sums.filter(F.col("idx") > head_size()), whole.select("conv_id", "own", *names), ["conv_id"], "own")
    moved = [(F.col(f"t{k}") + F.col(f"m{k}") * ((F.col(f"s{k}") - F.col(f"k{k}") + p) % p)) % p for k, p in enumerate(PRIMES)]
    depth = F.col("idx") - F.col("h") + F.col("hb")
    rest = rest.select("conv_id", depth.alias("depth"), *packed(moved), (depth == F.col("length")).alias("last"), "c1", "c2", "bytes", F.col("conv_id").alias("ref_conv"), F.col("idx").alias("ref_idx"))
    return keep(roots.unionByName(taken).unionByName(rest), "trie-prefixes")


def id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to ``IDS`` ids of one node, joined by commas, of a partition sorted by node and id."""
    for batch in batches:
        cols = [np.asarray(batch.column(k)) for k in range(4)]
        if not len(cols[0]):
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        cut = np.unique(np.concatenate([[0], change, np.arange(0, len(cols[0]), IDS), [len(cols[0])]]))
        at = cut[:-1]
        text = [",".join(map(str, cols[3][a:b].tolist())).encode() for a, b in zip(at.tolist(), cut[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols], pa.array(text, pa.binary())], ["depth", "f1", "f2", "low", "ids"])


def id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's ids, whose pieces come in order; only the running digest is held."""
    now, sha = None, None
    for batch in batches:
        out = []
        for depth, f1, f2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
            if (depth, f1, f2) == now:
                sha.update(b",")
            else:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = (depth, f1, f2), hashlib.sha256()
            sha.update(ids)
        yield found(out)
    if now is not None:
        yield found([(*now, sha.hexdigest())])


def found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["depth", "f1", "f2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 of the nodes at which conversations (conv_id) end. Ids are dealt by ranges of node and
    id and put into pieces, and the pieces of a node go through one digest as a stream."""
    order = ["depth", "f1", "f2", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(id_pieces, "depth long, f1 long, f2 long, low long, ids binary")
    pieces = pieces.repartition("depth", "f1", "f2").sortWithinPartitions("depth", "f1", "f2", "low")
    return pieces.mapInArrow(id_digests, "depth long, f1 long, f2 long, ends_sha256 string")


def subtree_shares(rows: DataFrame) -> DataFrame:
    """``rows`` of ``prefixes`` with what each gives its node: own (1: its conversation is the node's least member),
    child (1: the next prefix is a node of its own conversation), saved and leaves (of the nodes that its conversation
    stands for from here on down).

    A conversation that is a node's least member is so for all nodes below on its way. Every node below v is
    stood for by one member of v, so v's sums are those of its members' shares, and one grouping gives them.
    """
    node = ["depth", "f1", "f2"]
    nodes = rows.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.bool_and("last").alias("leaf"))
    own = nodes.select("conv_id", "depth", F.lit(1).cast("long").alias("own"), ((F.col("n") - 1) * F.col("bytes")).alias("w"), F.col("leaf").cast("long").alias("l"))
    rows = rows.join(own, ["conv_id", "depth"], "left").fillna(0, ["own", "w", "l"]).withColumn("bucket", F.expr(f"depth div {BUCKET}"))
    sums = rows.groupBy("conv_id", "bucket").agg(F.sum("w").alias("w"), F.sum("l").alias("l"), F.min(F.struct("depth", "own"))["own"].alias("low"))
    behind = Window.partitionBy("conv_id").orderBy(F.col("bucket").desc())
    before = behind.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "bucket", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"), F.coalesce(F.lag("low").over(behind), F.lit(0)).alias("next"))
    within = Window.partitionBy("conv_id", "bucket").orderBy(F.col("depth").desc())
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"w1": F.sum("w").over(upto), "l1": F.sum("l").over(upto), "c": F.lag("own").over(within)}).join(sums, ["conv_id", "bucket"])
    return rows.withColumns({"saved": F.col("w0") + F.col("w1"), "leaves": F.col("l0") + F.col("l1"), "child": F.coalesce("c", "next")}).drop("w", "l", "w0", "l0", "w1", "l1", "c", "next", "bucket")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and the reference of the node's last turn (ref_conv_id, ref_turn: the how manieth turn,
    from 1, of which original conversation; null for the root).

    ``conversations``: conv_id, turn, role, text; other columns are ignored. Rebuilt are the first h turns of
    conversation c - c % 5 (h = crc32(c) % 9), then c's own turns behind its first h; % is the remainder as SQL
    has it, whose sign is c's. Rows without conv_id belong to none; a null turn comes first; ties in turn go by
    the digest of role and text, so repeated rows are repeated turns. Null role or text is empty. Texts and
    conversations may be of any length, and any number of conversations may be equal. No rows: no nodes, no root.
    Raises ValueError if two different turns share a digest.
    """
    turns = digested(conversations)
    if not digests_hold(turns):
        raise ValueError("two different turns share a digest")
    rows = keep(subtree_shares(prefixes(prefix_sums(turns))), "trie-shares")
    node = ["depth", "f1", "f2"]
    one = F.when((F.min("c1") == F.max("c1")) & (F.min("c2") == F.max("c2")), F.min(F.struct("conv_id", "ref_conv", "ref_idx")))
    nodes = rows.groupBy(*node).agg(F.coalesce(one, F.raise_error(F.lit("two different prefixes share a fingerprint"))).alias("x"), F.count(F.lit(1)).alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    nodes = keep(nodes.select(*node, "x.*", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-nodes")
    # Where a conversation's own nodes begin, their parent is another's: it is looked up, at nodes with many children by broadcast.
    tops = rows.filter("child = 1 and own = 0").select("conv_id", *node)
    tops = spread_join(tops, nodes.select(*node, F.col("conv_id").alias("parent"), "n_children"), node, "n_children")
    tops = tops.select("conv_id", (F.col("depth") + 1).alias("depth"), "parent")
    out = nodes.join(tops, ["conv_id", "depth"], "left").join(end_digests(rows.filter("last")), node, "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"), F.col("ref_conv").alias("ref_conv_id"), F.col("ref_idx").alias("ref_turn"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("ref_conv_id", "ref_turn")
