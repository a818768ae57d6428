"""Trie of rebuilt conversations from composable fingerprints.

A rebuilt conversation is the head of its base conversation followed by its own turns after the head. Turn
sequences form a monoid; ``x_1 .. x_n`` maps to the pair ``(sum x_i B^(n-i), B^n)`` modulo the prime
2^127 - 1, and pairs compose as ``(f, p) (g, q) = (f q + g, p q)``. Prefix products of stored conversations
are worked out once. The fingerprint of any rebuilt prefix follows from the head's product and two products
of the own conversation by arithmetic alone: no rebuilt text or sequence is ever made. Rows carry a
reference to their last turn: the digest under which its role and text are stored.

1. One range-partitioned sort of the light rows (id, turn, digest, bytes) gives positions and prefix
   products. Each partition works out its own products; those of a conversation that goes on from partition
   to partition are composed from one pair a partition.
2. Heads are at most 8 turns of a base, joined to the at most 5 conversations built on it. Own turns meet
   their conversation's constants on (id, slice of positions), so that a long conversation is many keys.
3. Nodes are groups of equal (depth, fingerprint), combined before the shuffle. Each group is verified: its
   members must share the reference of the last turn and the parent group, which by induction makes them
   equal sequences; and the turns stored under one reference must have one role and text, in full. If any
   check fails, all is done again with another base and other digests.
4. A node's owner is its smallest member. What a conversation owns is the lower end of its path, so subtree
   sums need no walk over levels: each conversation adds, to every node on its path, the sum over what it
   owns at or below it. Own nodes get running sums from a second sort; the path above gets one total, by
   slices as in 2.
5. The ids that end at a node are sorted by range, joined in texts of bounded size and hashed as a stream.

Parents with more than a thousandth of all nodes as children (there are less than 1000) are broadcast; the
others are joined.

Defined results: turns are ordered by ``turn`` (null first), repeated turn numbers by role, then text digest
(md5); null role or text is empty; rows with a null ``conv_id`` take no part; ``c % 5`` is not negative;
repeated rows are turns of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.session import cut_lineage

FAMILY, HEADS = 5, 9
PRIME = 2 ** 127 - 1
#: Positions of a conversation that share a join key.
SLICE = 4096
#: Bytes of joined ids in one row.
CHUNK_BYTES = 65536
MAX_TRIES = 8
_ROOT = bytes(16)


def head_length(conv_id: int) -> int:
    """How many turns of its base a conversation begins with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _head_length(c: Column) -> Column:
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(HEADS)).cast("int")


def _base(seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"base {seed}".encode()).digest()[:15], "big") + 2


def _pack(x: int) -> bytes:
    return x.to_bytes(16, "big")


def _num(b: bytes) -> int:
    return int.from_bytes(b, "big")


def turns(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """``conv_id, turn, role, text, ref``: ``ref`` is the digest of a turn's role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.lit(f"{seed}:"), F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.unhex(F.md5(framed.cast("binary"))).alias("ref"))


def _same_content(rows: DataFrame) -> bool:
    """Does each reference stand for one role and one text? Compared in full; equal turns are combined before
    the one shuffle."""
    return rows.select("ref", "role", "text").distinct().groupBy("ref").count().where("count > 1").isEmpty()


def scan(df: DataFrame, key: str, order: list, columns: dict[str, str], step: Callable, start: tuple,
         compose: Callable, out: str) -> DataFrame:
    """Running values of a monoid within each ``key`` in ``order``, for keys of any size.

    ``step(state, row)`` takes a row's values of ``columns`` on; ``out`` are the state's columns (a DDL
    string). Partitions are ranges of (key, order); each scans its rows from ``start``, and the states of the
    keys that go on over partitions are put together by ``compose(earlier, later)``. One state a partition
    reaches the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    schema = ", ".join([f"{key} long", *[f"{c} {t}" for c, t in columns.items()], out, "_pid int", "_first boolean"])
    target = _schema(schema)
    names = [f.strip().split(" ")[0] for f in out.split(",")]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, state, now, first = TaskContext.get().partitionId(), start, None, None
        for batch in batches:
            keys, *values = (c.to_pylist() for c in batch.columns)
            states, firsts = [], []
            for k, *row in zip(keys, *values):
                if first is None:
                    first = k
                if k != now:
                    state, now = start, k
                state = step(state, row)
                states.append(state)
                firsts.append(k == first)
            yield _rows([keys, *values, *zip(*states), [pid] * len(keys), firsts], target)

    done = cut_lineage(ranged.select(key, *columns).mapInArrow(local, schema))
    # The first and last key of each partition, and the state behind its last row.
    last = F.max(F.struct("_at", key, *names))
    ends = (done.withColumn("_at", F.monotonically_increasing_id()).groupBy("_pid")
                .agg(F.min(key).alias("lo"), F.max(key).alias("hi"), last.alias("last")).collect())
    carry, held = [], None  # the key that goes on, and its state so far
    for r in sorted(ends, key=lambda r: r["_pid"]):
        if held and held[0] == r["lo"]:
            carry.append((r["_pid"], *held[1]))
        state = tuple(r["last"][c] for c in names)
        held = (r["hi"], compose(held[1], state) if held and held[0] == r["lo"] == r["hi"] else state)
    if not carry:
        return done.drop("_pid", "_first")
    sent = spark.sparkContext.broadcast({p: s for p, *s in carry})  # one state a partition
    final = _schema(schema)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = 1 + len(columns)
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for i, (p, first) in enumerate(zip(cols[-2], cols[-1])):
                if first and p in sent.value:
                    state = compose(sent.value[p], tuple(c[i] for c in cols[lead:-2]))
                    for c, x in zip(cols[lead:-2], state):
                        c[i] = x
            yield _rows(cols, final)

    return done.mapInArrow(join, schema).drop("_pid", "_first")


def _schema(text: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(text))


def _rows(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def prefix_products(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``conv_id, ref, bytes, pos`` (from 1) ``, p``: fingerprint of the first ``pos`` turns."""
    base = _base(seed)

    def step(state, row):
        pos, p = state
        return pos + 1, _pack((_num(p) * base + _num(row[0])) % PRIME)

    def compose(a, b):
        return a[0] + b[0], _pack((_num(a[1]) * pow(base, b[0], PRIME) + _num(b[1])) % PRIME)

    light = rows.select("conv_id", "turn", "role", "ref", F.octet_length("text").cast("long").alias("bytes"))
    return scan(light, "conv_id", [F.asc_nulls_first("turn"), "role", "ref"], {"ref": "binary", "bytes": "long"},
                step, (0, _ROOT), compose, "pos long, p binary")


_TURN = "struct<pos:bigint,p:binary,ref:binary,bytes:bigint>"


def _plans(own: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id, n, h, k, length``, ``mine`` and ``head``: its own first turns and those
    of its base, at most 8 each."""
    first = F.collect_list(F.when(F.col("pos") < HEADS, F.struct("pos", "p", "ref", "bytes")))
    mine = own.groupBy("conv_id").agg(F.max("pos").alias("n"), F.array_sort(first).alias("mine"))
    mine = cut_lineage(mine.withColumn("h", _head_length(F.col("conv_id"))))
    heads = mine.select(F.col("conv_id").alias("_base"), F.col("mine").alias("_head"))
    joined = mine.withColumn("_base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(heads, "_base", "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("_head", F.array().cast(f"array<{_TURN}>")), 1, F.greatest("h", F.lit(1))))
    return (joined.withColumn("head", F.coalesce(head, F.array().cast(f"array<{_TURN}>")))
                  .withColumn("k", F.size("head"))
                  .withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
                  .select("conv_id", "n", "h", "k", "length", "mine", "head"))


def rebuilt_rows(own: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each prefix of each rebuilt conversation, the empty one included: ``conv_id, depth, p, parent,
    ref, bytes, ends``."""
    base = _base(seed)
    plans = cut_lineage(_plans(own))
    root = plans.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(_ROOT).alias("p"),
                        F.lit(None).cast("binary").alias("parent"), F.lit(_ROOT).alias("ref"),
                        F.lit(0).cast("long").alias("bytes"), (F.col("length") == 0).alias("ends"))
    before = F.when(F.col("_i") == 0, F.lit(_ROOT)).otherwise(F.get("head", F.col("_i") - 1)["p"])
    heads = (plans.where("k > 0").select("conv_id", "length", "head", F.posexplode("head").alias("_i", "_t"))
                  .select("conv_id", (F.col("_i") + 1).cast("long").alias("depth"), "_t.p", before.alias("parent"),
                          "_t.ref", "_t.bytes", (F.col("_i") + 1 == F.col("length")).alias("ends")))
    slices = (plans.where("n > h").select(
        "conv_id", "h", "k", "length", F.coalesce(F.get("head", F.col("k") - 1)["p"], F.lit(_ROOT)).alias("_head"),
        F.coalesce(F.get("mine", F.col("h") - 1)["p"], F.lit(_ROOT)).alias("_skip"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SLICE))).alias("_slice")))
    tails = (own.where(F.col("pos") > _head_length(F.col("conv_id")))
                .withColumn("_slice", F.floor(F.col("pos") / SLICE)).join(slices, ["conv_id", "_slice"])
                .select("conv_id", "pos", "p", "ref", "bytes", "h", "k", "length", "_head", "_skip"))
    schema = "conv_id long, depth long, p binary, parent binary, ref binary, bytes long, ends boolean"
    target = _schema(schema)

    def symbolic(batches):
        # head * own[h..pos] = own[..pos] + (head - own[..h]) B^(pos - h); the parent's is the same, one turn less.
        back = pow(base, -1, PRIME)
        powers = [1]
        for batch in batches:
            c = {f.name: batch.column(i).to_pylist() for i, f in enumerate(batch.schema)}
            p, parent = [], []
            for pos, own_p, ref, h, head, skip in zip(c["pos"], c["p"], c["ref"], c["h"], c["_head"], c["_skip"]):
                gap = (_num(head) - _num(skip)) % PRIME
                while pos - h >= len(powers) and len(powers) < SLICE:
                    powers.append(powers[-1] * base % PRIME)
                power = powers[pos - h] if pos - h < len(powers) else pow(base, pos - h, PRIME)
                p.append(_pack((_num(own_p) + gap * power) % PRIME))
                parent.append(_pack((_num(p[-1]) - _num(ref)) * back % PRIME))
            depth = [k + pos - h for k, pos, h in zip(c["k"], c["pos"], c["h"])]
            ends = [d == n for d, n in zip(depth, c["length"])]
            yield _rows([c["conv_id"], depth, p, parent, c["ref"], c["bytes"], ends], target)

    return root.unionByName(heads).unionByName(tails.mapInArrow(symbolic, schema))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("depth", "p").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
        F.min("parent").alias("parent"),
        ((F.min("parent").eqNullSafe(F.max("parent"))) & (F.min("ref") == F.max("ref"))).alias("_same"))


def _ends_digest(rows: DataFrame) -> DataFrame:
    """``depth, p, ends_sha256`` of the nodes at which conversations end."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["depth", "p", "conv_id"]
    ends = rows.where("ends").select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    part, out = "depth long, p binary, _at long, _ids string", "depth long, p binary, ends_sha256 string"
    part_schema, out_schema = _schema(part), _schema(out)

    def join(batches):
        """Texts of at most about ``CHUNK_BYTES``, numbered in order."""
        at, now, held, size = TaskContext.get().partitionId() << 40, None, [], 0
        made = []
        for batch in batches:
            for d, p, c in zip(*(x.to_pylist() for x in batch.columns)):
                if held and ((d, p) != now or size > CHUNK_BYTES):
                    made.append((*now, at, ",".join(held)))
                    at, held, size = at + 1, [], 0
                now = d, p
                held.append(str(c))
                size += len(held[-1]) + 1
            if made:
                yield _rows(list(zip(*made)), part_schema)
                made = []
        if held:
            yield _rows([[x] for x in (*now, at, ",".join(held))], part_schema)

    def digest(batches):
        now, state, made = None, None, []
        for batch in batches:
            for d, p, _, ids in zip(*(x.to_pylist() for x in batch.columns)):
                if (d, p) != now:
                    if state:
                        made.append((*now, state.hexdigest()))
                    now, state = (d, p), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if made:
                yield _rows(list(zip(*made)), out_schema)
                made = []
        if state:
            yield _rows([[x] for x in (*now, state.hexdigest())], out_schema)

    texts = cut_lineage(ends.mapInArrow(join, part))
    return texts.repartition(n, "depth", "p").sortWithinPartitions("depth", "p", "_at").mapInArrow(digest, out)


def _with_parents(nodes: DataFrame, children: DataFrame, total: int) -> DataFrame:
    """``nodes`` with ``n_children`` and ``parent_conv_id``."""
    wide = nodes.join(children, ["depth", "p"], "left").fillna({"n_children": 0})
    wide = cut_lineage(wide)
    up = wide.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("parent"),
                                             F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = F.col("n_children") * 1000 > total
    hot = F.broadcast(up.where(many).drop("n_children").withColumnRenamed("parent_conv_id", "_hot"))  # below 1000
    marked = wide.join(hot, ["depth", "parent"], "left")
    rest = marked.where("_hot is null").drop("_hot").join(up.where(~many).drop("n_children"), ["depth", "parent"], "left")
    return rest.unionByName(marked.where("_hot is not null").withColumnRenamed("_hot", "parent_conv_id"))


def _subtree_sums(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``depth, p, n_leaves, saved_tokens``."""
    weight = (F.col("n_convs") - 1) * F.col("bytes")
    leaf = (F.col("n_children") == 0).cast("long")
    owned = nodes.select("conv_id", "depth", "p", weight.alias("w"), leaf.alias("leaf"))
    # Below a node on its owner's path: running sums from the deepest node up.
    sums = scan(owned, "conv_id", [F.desc("depth")], {"depth": "long", "p": "binary", "w": "long", "leaf": "long"},
                lambda s, r: (s[0] + r[2], s[1] + r[3]), (0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]),
                "saved long, leaves long")
    chains = sums.groupBy("conv_id").agg(F.min("depth").alias("top"), F.max("saved").alias("saved"),
                                         F.max("leaves").alias("leaves"))
    above = chains.where("top > 0 and (saved > 0 or leaves > 0)").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - 1) / SLICE))))
    added = (rows.select("conv_id", "depth", "p").withColumn("_slice", F.floor(F.col("depth") / SLICE))
                 .join(above, ["conv_id", "_slice"]).where("depth < top").select("depth", "p", "saved", "leaves"))
    every = sums.select("depth", "p", "saved", "leaves").unionByName(added)
    return every.groupBy("depth", "p").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    for seed in range(MAX_TRIES):
        stored = turns(conversations, seed)
        rows = cut_lineage(rebuilt_rows(prefix_products(stored, seed), seed))
        nodes = cut_lineage(_groups(rows))
        if _same_content(stored) and nodes.where("not _same").isEmpty():
            break
    else:
        raise RuntimeError(f"fingerprints collided {MAX_TRIES} times")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("p")).agg(
        F.count(F.lit(1)).alias("n_children"))
    wide = cut_lineage(_with_parents(nodes.drop("_same"), children, nodes.count()))
    empty = hashlib.sha256(b"").hexdigest()
    return (wide.select("conv_id", "depth", "p", "parent_conv_id", "n_convs", "n_children")
                .join(_subtree_sums(rows, wide), ["depth", "p"])
                .join(_ends_digest(rows), ["depth", "p"], "left")
                .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))
