"""A trie of conversation prefixes, by vertical bitmaps.

Members (conversations) of neighbouring ids make a shard. In a shard, every pair
(position, turn) has the bitset of its members; a node's bitset cut with those of
the next position gives its children, the count of bits its members, and what no
child takes ends there. Nodes are walked depth first within a slab of positions,
slab after slab, so that a shard's memory is bounded by members times positions
of a slab, however long a conversation is.

A node's key is a hash of its turns, so nodes of different shards meet by key.
Sums over subtrees are put together from shards as well: a node belongs to the
shard of its smallest member, which knows all of the node's ancestors, so each
shard adds up the nodes that belong to it, children before parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged

#: Members of a shard, positions of a slab, rows of a batch that a task gives out.
SHARD, SLAB, ROWS = 512, 256, 8192
HEAD, PERIOD = 4, 20
LOCAL = "shard long, idx long, up long, key binary, depth long, first long, n long, weight long, inner boolean, ends array<long>"
PART = "key binary, depth long, first long, parent long, n long, children long, leaves long, held long, own long"


def turn_rows(conversations: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(member, at, turn, weight) for each row: its place from 1 on, a hash of role and text (null: empty), and the words of the text.

    Rows of one order value follow by role and then by the hash of their text;
    those with a null id are passed over. Texts stay where they are read.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    hashed = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("member"), F.col(order_col).alias("o"), role.alias("r"), hashed.alias("turn"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("weight")
    )
    w = Window.partitionBy("member").orderBy(F.asc_nulls_first("o"), "r", "turn")
    return rows.select("member", F.row_number().over(w).cast("long").alias("at"), "turn", "weight")


def spliced(turns: DataFrame, period: int = PERIOD, head: int = HEAD) -> DataFrame:
    """Each member c with the first h turns of member c - c % period (all if fewer, none if absent) instead of its own first h, where h = crc32(c) % head.

    Every member has a row of place 0 without a turn, so that members without
    turns stay.
    """
    c = F.col("member")
    members = turns.where("at = 1").select(c, (c - c % period).alias("base"), (F.crc32(c.cast("string").cast("binary")) % head).alias("h"))
    heads = turns.where(F.col("at") < head).withColumnRenamed("member", "base")
    taken = members.join(heads, "base").where("at <= h").select("member", "at", "turn", "weight")
    own = turns.where(F.col("at") > F.crc32(c.cast("string").cast("binary")) % head)
    w = Window.partitionBy("member").orderBy("at")
    rows = taken.unionByName(own).select("member", F.row_number().over(w).cast("long").alias("at"), "turn", "weight")
    return rows.unionByName(members.select("member", F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("weight")))


class _Shard:
    """The nodes of one shard, made slab after slab."""

    def __init__(self, start: int, shard: int):
        self.start, self.shard, self.made = start, shard, 0
        self.open: list[tuple] = []  # nodes at the end of the last slab: (parent, key, bits, depth, weight)
        self.clear()

    def clear(self) -> None:
        self.postings: dict[tuple[int, bytes], int] = {}
        self.turn_at: dict[tuple[int, int], bytes] = {}
        self.weight: dict[tuple[int, bytes], int] = {}
        self.has: dict[int, int] = {}

    def add(self, bit: int, at: int, turn: bytes | None, weight: int) -> None:
        self.has[at] = self.has.get(at, 0) | 1 << bit
        if turn is not None:
            self.postings[at, turn] = self.postings.get((at, turn), 0) | 1 << bit
            self.turn_at[at, bit], self.weight[at, turn] = turn, weight

    def walk(self, until: int | None) -> Iterator[tuple]:
        """Rows of the nodes whose next position lies before ``until`` (None: all that are left)."""
        if not self.made and not self.open:
            self.open = [(-1, b"", self.has[0], 0, 0)]
        stack, self.open = self.open[::-1], []
        while stack:
            node = up, key, bits, depth, weight = stack.pop()
            if until is not None and depth + 1 >= until:
                self.open.append(node)
                continue
            here, place = self.made, depth + 1
            self.made += 1
            rest = bits & self.has.get(place, 0)
            ended, inner = bits & ~rest, rest > 0
            while rest:
                turn = self.turn_at[place, (rest & -rest).bit_length() - 1]
                child = bits & self.postings[place, turn]
                rest &= ~child
                stack.append((here, hashlib.blake2b(key + turn, digest_size=16).digest(), child, place, self.weight[place, turn]))
            ends = []
            while ended:
                low = ended & -ended
                ends.append(self.start + low.bit_length() - 1)
                ended ^= low
            first = self.start + (bits & -bits).bit_length() - 1
            yield self.shard, here, up, key, depth, first, bits.bit_count(), weight, inner, ends
        self.clear()


def _framed(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    names, part = [c.split()[0] for c in schema.split(", ")], []
    for row in rows:
        part.append(row)
        if len(part) == ROWS:
            yield pd.DataFrame(part, columns=names)
            part = []
    if part:
        yield pd.DataFrame(part, columns=names)


def _grow(size: int, slab: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            now, before = None, 0
            for batch in batches:
                for shard, part, bit, at, turn, weight in batch.itertuples(index=False):
                    if now is None or shard != now.shard:
                        if now is not None:
                            yield from now.walk(None)
                        now, before = _Shard(shard * size, shard), part
                    elif part != before:
                        yield from now.walk(part * slab)
                        before = part
                    now.add(bit, at, turn, weight)
            if now is not None:
                yield from now.walk(None)

        return _framed(rows(), LOCAL)

    return run


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of a shard, children first: sums over what belongs to the shard in each node's subtree; a node waits for its parent's smallest member."""

    def rows() -> Iterator[tuple]:
        now, waiting = None, {}
        for batch in batches:
            for shard, idx, up, key, depth, n, weight, owner, mine, leaf in batch.itertuples(index=False):
                if shard != now:
                    now, waiting = shard, {}
                children = leaves = held = own = 0
                for *child, is_mine in waiting.pop(idx, ()):
                    yield (*child[:3], owner, *child[3:])
                    children += is_mine
                    leaves, held, own = leaves + child[5], held + child[6], own + child[7]
                if mine:
                    leaves, own = leaves + leaf, own + weight
                held += n * weight
                if up < 0:
                    yield key, depth, owner, None, n, children, leaves, held, own
                else:
                    waiting.setdefault(up, []).append((key, depth, owner, n, children, leaves, held, own, mine))

    for frame in _framed(rows(), PART):
        yield frame.astype({"parent": "Int64"})


def prefix_trie(rows: DataFrame, size: int = SHARD, slab: int = SLAB) -> tuple[DataFrame, DataFrame]:
    """The trie of rows (member, at, turn, weight): every member has a row of place 0 without a turn and its turns at 1, 2, ... without gaps.

    Returns the nodes (key, first, depth, parent, n_members, n_children, n_leaves,
    saved) and the lists of members that end at a node (key, shard, ends), in parts
    that follow by shard and inside by number. ``first`` is the smallest member,
    ``parent`` that of the parent (root: null), and ``saved`` the sum over the
    subtree of (members - 1) times weight. No rows give no nodes.
    """
    bit = F.pmod("member", F.lit(size))
    placed = rows.select(F.expr(f"(member - pmod(member, {size})) div {size}").alias("shard"), F.expr(f"at div {slab}").alias("slab"), bit.alias("bit"), "at", "turn", "weight")
    local = staged(placed.repartition("shard").sortWithinPartitions("shard", "slab").mapInPandas(_grow(size, slab), LOCAL))
    known = local.groupBy("key").agg(F.min("first").alias("owner"), (~F.max("inner")).alias("leaf"))
    joined = local.drop("ends", "inner").join(known, "key").select("shard", "idx", "up", "key", "depth", "n", "weight", "owner", (F.col("first") == F.col("owner")).alias("mine"), "leaf")
    parts = joined.repartition("shard").sortWithinPartitions("shard", F.desc("idx")).mapInPandas(_summed, PART)
    nodes = parts.groupBy("key").agg(
        F.min("first").alias("first"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("n").alias("n_members"),
        F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"), (F.sum("held") - F.sum("own")).alias("saved"),
    )
    return nodes, local.where(F.size("ends") > 0).select("key", "shard", "ends")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of a node's ending members, decimal and joined by commas. The parts of a node stream through one task, as such a digest can't be put together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            now, digest = None, None
            for batch in batches:
                for key, ids in zip(batch["key"], batch["ids"], strict=True):
                    if key != now:
                        if digest:
                            yield now, digest.hexdigest()
                        now, digest = key, hashlib.sha256(ids.encode())
                    else:
                        digest.update(b"," + ids.encode())
            if digest:
                yield now, digest.hexdigest()

        return _framed(rows(), "key binary, ends_sha256 string")

    parts = ends.select("key", "shard", F.array_join(F.col("ends").cast("array<string>"), ",").alias("ids"))
    return parts.repartition("key").sortWithinPartitions("key", "shard").mapInPandas(run, "key binary, ends_sha256 string")


#: The trie of the spliced conversations, for DuckDB.
TRIE_SQL = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {PERIOD} AS base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))),
    lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % {HEAD} AS h FROM k),
u AS (SELECT c.conv_id, t.place, t.role, t.txt FROM c JOIN t ON t.conv_id = c.base AND t.place <= c.h
    UNION ALL SELECT c.conv_id, t.place, t.role, t.txt FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
q AS (SELECT conv_id, row_number() OVER w AS d, list(struct_pack(r := role, x := txt)) OVER w AS path, len(regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+')) AS words FROM u
    WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT conv_id, 0, CAST([] AS STRUCT(r VARCHAR, x VARCHAR)[]), 0 FROM c),
n AS (SELECT min(conv_id) AS id, d, path, count(*) AS n, any_value(words) AS words FROM q GROUP BY d, path),
m AS (SELECT q.conv_id, q.d, n.id FROM q JOIN n ON n.d = q.d AND n.path = q.path),
e AS (SELECT conv_id, max(d) AS d FROM q GROUP BY 1),
p AS (SELECT n.id, n.d, n.n, n.words, m.id AS up FROM n LEFT JOIN m ON m.conv_id = n.id AND m.d = n.d - 1),
b AS (SELECT up AS id, d - 1 AS d, count(*) AS k FROM p WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT p.*, coalesce(b.k, 0) AS k FROM p LEFT JOIN b ON b.id = p.id AND b.d = p.d),
s AS (SELECT m.id, m.d, sum(CAST(f.k = 0 AS BIGINT)) AS leaves, sum((f.n - 1) * f.words) AS saved FROM f JOIN m ON m.conv_id = f.id AND m.d <= f.d GROUP BY 1, 2),
g AS (SELECT m.id, m.d, string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) AS ends FROM m JOIN e ON e.conv_id = m.conv_id AND e.d = m.d GROUP BY 1, 2)
SELECT f.id AS conv_id, f.d AS depth, f.up AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
    sha256(coalesce(g.ends, '')) AS ends_sha256 FROM f JOIN s ON s.id = f.id AND s.d = f.d LEFT JOIN g ON g.id = f.id AND g.d = f.d"""
