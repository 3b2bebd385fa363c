"""Merkle manifest of a dataset: a hash tree over the rows of every language, a tree over these, and a proof for every row.

A row's leaf is the hash of its columns (``leaf_digest``). In every group leaves ascend by doc_id (null first, equal ids by leaf); every
``fanout`` consecutive nodes become the hash of their hexadecimal digests in a row, the last run with what is left, until one
node, the subroot, remains. Subroots in the order of groups (null first, then by UTF-8 bytes) make the root likewise.

Radix-ranked trie: no sort runs over a group. Rows are counted by prefixes of doc_id's binary digits, the counts are rolled up digit by digit
(``common.starts``), and a row's rank is the start of its prefix and its place among the few rows of the prefix. A prefix
that repeated ids make heavy goes on with the id's last digits and those of the leaf. Ranks written in base ``fanout`` are the
keys of the trie: a node of height h is the rank's prefix without its last h digits. Prefixes are reduced longest first, ``block`` leaves at a
time: one group of at most ``BLOCK`` nodes gives one node of the next stage. Proofs go down the same way: a node's siblings in its block, then those of the
block's path. Equal rows are one entry with a count until they stand in their blocks, so that copies of one row, however many, are
no hot key. Leaves, counts and blocks are written to the checkpoint folder once each.

Defined results: null columns are told from empty ones in the leaf; repeated rows are leaves of their own with proofs of their own; an
empty table gives no rows; a group of one row has its leaf as subroot; a single group's subroot is the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import DIGIT_BITS, small, starts, written

#: Columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Most nodes of a block, and distinct rows from which a prefix of doc_id goes on with more digits.
BLOCK, HEAVY = 1_024, 65_536
_BLOCKS = "g string, n long, block long, nodes array<struct<first:int, copies:int, doc_id:long, leaf:binary, altered:binary>>"
_PROOF = "array<struct<left:string, right:string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 (binary) of values in a row, each as its UTF-8 byte count, ``:`` and itself, null as ``-``."""
    text = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _height(n: int, fanout: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def _levels(nodes: list[str], fanout: int, up: int) -> list[list[str]]:
    """Nodes of a block level by level: the given ones first, ``up`` more levels, the last of one node."""
    levels = [nodes]
    for _ in range(up):
        below = levels[-1]
        levels.append([_digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


class _Trie:
    """What the tasks need to know of the tree's shape."""

    def __init__(self, fanout: int, most: int) -> None:
        self.fanout, self.digits, self.size = fanout, 1, fanout
        while self.size * fanout <= BLOCK:
            self.digits, self.size = self.digits + 1, self.size * fanout
        self.stages = max(1, -(-_height(most, fanout) // self.digits))

    def up(self, n: int, stage: int) -> int:
        """Levels that a block of a stage makes in a group of ``n`` leaves."""
        return min(self.digits, max(0, _height(n, self.fanout) - self.digits * stage))

    def tops(self, blocks: DataFrame, stage: int) -> DataFrame:
        """One node for each block: g, n, idx, h."""

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tops = [_levels(_listed(nodes), self.fanout, self.up(n, stage))[-1][0] for n, nodes in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(tops, pa.string())], names=["g", "n", "idx", "h"])

        return blocks.mapInArrow(apply, "g string, n long, idx long, h string")

    def grouped(self, nodes: DataFrame) -> DataFrame:
        """Blocks of the nodes of a stage above the first."""
        entry = F.struct(F.expr(f"int(idx % {self.size})").alias("first"), F.lit(1).alias("copies"), F.lit(None).cast("long").alias("doc_id"), F.unhex("h").alias("leaf"), F.lit(None).cast("binary").alias("altered"))
        return nodes.groupBy("g", "n", F.expr(f"idx div {self.size}").alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("nodes"))

    def paths(self, blocks: DataFrame, above: DataFrame, stage: int) -> DataFrame:
        """One row for each node of the blocks: what ``above`` has for the block (``lefts`` and ``rights`` after the node's own), g, n,
        idx, doc_id, leaf, altered."""
        fanout, size = self.fanout, self.size
        joined = blocks.join(above.withColumnsRenamed({"idx": "block"}).drop("n"), ["g", "block"]).select("g", "n", "block", "nodes", "lefts", "rights", "subroot", "root")

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, n, block, nodes, more_left, more_right, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    levels = _levels(_listed(nodes), fanout, self.up(n, stage))
                    count, lefts, rights = len(levels[0]), [], []
                    for i in range(count):
                        at = i
                        for level in levels[:-1]:
                            lo = at - at % fanout
                            lefts.append("".join(level[lo:at]))
                            rights.append("".join(level[at + 1 : lo + fanout]))
                            at //= fanout
                        lefts += more_left
                        rights += more_right
                    every = len(levels) - 1 + len(more_left)
                    ends = pa.array(range(0, every * count + 1, every) if every else [0] * (count + 1), pa.int32())
                    proof = [pa.ListArray.from_arrays(ends, pa.array(x, pa.string())) for x in (lefts, rights)]
                    own = [x for x in nodes for _ in range(x["copies"])]
                    same = lambda v, kind: pa.array([v] * count, kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays(
                        [same(g, pa.string()), same(n, pa.int64()), pa.array(range(block * size, block * size + count), pa.int64()), *(pa.array([x[c] for x in own], kind) for c, kind in (("doc_id", pa.int64()), ("leaf", pa.binary()), ("altered", pa.binary()))), *proof, same(subroot, pa.string()), same(root, pa.string())],
                        names=["g", "n", "idx", "doc_id", "leaf", "altered", "lefts", "rights", "subroot", "root"],
                    )

        return joined.mapInArrow(apply, "g string, n long, idx long, doc_id long, leaf binary, altered binary, lefts array<string>, rights array<string>, subroot string, root string")

    def climb(self, blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        """Blocks of every stage and the last node of each group (g, n, idx, h)."""
        every = [blocks]
        for stage in range(self.stages):
            nodes = written(self.tops(every[-1], stage), "nodes")
            if stage + 1 < self.stages:
                every.append(self.grouped(nodes))
        return every, nodes

    def descend(self, every: list[DataFrame], above: DataFrame) -> DataFrame:
        """From paths of the groups' last nodes to the blocks' nodes."""
        for stage in reversed(range(self.stages)):
            above = self.paths(every[stage], above, stage)
            if stage:
                above = above.select("g", "n", "idx", "lefts", "rights", "subroot", "root")
        return above


def _listed(nodes: list[dict]) -> list[str]:
    """Digests of a block's nodes in order, equal rows as often as they stand."""
    return [h for x in nodes for h in [x["leaf"].hex()] * x["copies"]]


def ranked(entries: DataFrame) -> DataFrame:
    """Entries (g, doc_id, leaf, altered, copies) with ``rank``, the place of their first copy in their group, and ``n``, the group's rows."""
    bucket = F.shiftright("doc_id", DIGIT_BITS)
    lo, hi = entries.agg(F.min(bucket), F.max(bucket)).first()
    lo, hi = lo or 0, hi or 0
    entries = entries.withColumn("b", F.coalesce(bucket - F.lit(lo) + 1, F.lit(0)))
    counts = written(entries.groupBy("g", "b").agg(F.sum("copies").alias("rows"), F.count("*").alias("kinds")), "prefixes")
    sizes = counts.groupBy("g").agg(F.sum("rows").alias("n"))
    placed = starts(counts.select("g", "b", "rows"), ["g"], "b", "rows", hi - lo + 1).drop("rows")
    heavy = counts.where(F.col("kinds") > HEAVY).select("g", "b", F.lit(True).alias("heavy"))
    if n_heavy := heavy.count():
        more = F.coalesce(F.col("doc_id").bitwiseAND((1 << DIGIT_BITS) - 1) + 1, F.lit(0)) * 65_536 + F.conv(F.hex(F.substring("leaf", 1, 2)), 16, 10).cast("long")
        entries = entries.join(small(heavy, n_heavy), ["g", "b"], "left").withColumn("sub", F.when(F.col("heavy"), more).otherwise(0)).drop("heavy")
        subs = written(entries.groupBy("g", "b", "sub").agg(F.sum("copies").alias("rows")), "subs")
        inside = starts(subs, ["g", "b"], "sub", "rows", (2 << DIGIT_BITS) * 65_536).select("g", "b", "sub", F.col("start").alias("inside"))
        placed = inside.join(placed, ["g", "b"]).withColumn("start", F.col("start") + F.col("inside")).drop("inside")
        keys = ["g", "b", "sub"]
    else:
        keys = ["g", "b"]
    placed = placed.join(sizes, "g")
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("doc_id"), "leaf", "altered").rowsBetween(Window.unboundedPreceding, -1)
    return entries.join(placed, keys).withColumn("rank", F.col("start") + F.coalesce(F.sum("copies").over(before), F.lit(0))).select("g", "n", "rank", "copies", "doc_id", "leaf", "altered")


def manifest(docs: DataFrame, altered: Column | None = None, fanout: int = 2, columns: Sequence[str] = COLUMNS, group: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, the group column, rank (in its group), leaf, subroot, root and proof, which has the digests
    left and right of the node on every level, lowest first. ``altered`` is another leaf of the row that is carried along (binary, may be null)."""
    name = F.col(group).cast("string")
    g = F.when(name.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), name)).alias("g")
    other = (altered if altered is not None else F.lit(None).cast("binary")).alias("altered")
    leaves = docs.select(g, F.col("doc_id").cast("long").alias("doc_id"), leaf_digest([F.col(c) for c in columns]).alias("leaf"), other)
    entries = written(leaves.groupBy("g", "doc_id", "leaf", "altered").agg(F.count("*").alias("copies")), "leaves")
    place = ranked(entries)
    most = entries.groupBy("g").agg(F.sum("copies").alias("n")).agg(F.max("n"), F.count("*")).first()
    trie, top = _Trie(fanout, most[0] or 1), _Trie(fanout, most[1] or 1)
    size = trie.size
    first = F.expr(f"greatest(rank, block * {size})")
    entry = F.struct((first - F.col("block") * size).cast("int").alias("first"), (F.least(F.col("rank") + F.col("copies"), (F.col("block") + 1) * size) - first).cast("int").alias("copies"), "doc_id", "leaf", "altered")
    spread = place.withColumn("block", F.explode(F.sequence(F.expr(f"rank div {size}"), F.expr(f"(rank + copies - 1) div {size}"))))
    blocks = written(spread.groupBy("g", "n", "block").agg(F.sort_array(F.collect_list(entry)).alias("nodes")), "blocks")
    every, subroots = trie.climb(blocks)
    order = Window.orderBy("g")  # one row for each group: the only window without a key
    named = subroots.select("g", "h", (F.row_number().over(order) - 1).cast("long").alias("idx"))
    named = written(named, "subroots")
    above, roots = top.climb(top.grouped(named.select(F.lit("").alias("g"), F.lit(most[1]).cast("long").alias("n"), "idx", "h")))
    none = F.array().cast("array<string>")
    from_root = top.descend(above, roots.select("g", "n", "idx", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("h").alias("root")))
    tops = from_root.select("idx", "lefts", "rights", "root").join(named, "idx").select("g", F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("h").alias("subroot"), "root")
    rows = trie.descend(every, written(tops, "tops"))
    proof = F.zip_with("lefts", "rights", lambda a, b: F.struct(a.alias("left"), b.alias("right"))).alias("proof")
    return rows.select("doc_id", F.when(F.col("g") != "-", F.substr("g", F.lit(2))).alias(group), F.col("idx").alias("rank"), F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("altered")).alias("altered"), "subroot", "root", proof)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the proof's digests in a row, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def prove_documents(docs: DataFrame, every: int = 7) -> DataFrame:
    """The manifest with each row checked against the root; of rows whose doc_id has a CRC-32 that ``every`` divides, n_chars is one more
    than when the manifest was made."""
    changed = F.crc32(F.col("doc_id").cast("string")) % every == 0
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    rows = manifest(docs, F.when(changed & F.col("n_chars").isNotNull(), leaf_digest(more)))
    rows = rows.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _tree(name: str, source: str) -> str:
    """SQL: all nodes above the rows (k, lev, i, n, h) of a source, and the proof and fold of every one of its rows."""
    return f"""
{name}(k, lev, i, n, h) AS (SELECT k, 0::BIGINT, i, n, h FROM {source}
  UNION ALL SELECT k, lev + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY k, lev, i // 2, n)"""


ORACLE_SQL = f"""
WITH RECURSIVE bits(b, v, s) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM bits WHERE s < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE s = 8),
d AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 7 = 0 AS other FROM documents, crc),
p AS (SELECT doc_id, lang, other AND n_chars IS NOT NULL AS other, {", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END AS p_{c}" for c in COLUMNS)},
  CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END AS p_more FROM d),
l AS (SELECT doc_id, coalesce('=' || lang, '-') AS k, sha256({" || ".join(f"p_{c}" for c in COLUMNS)}) AS h, CASE WHEN other THEN sha256({" || ".join("p_more" if c == "n_chars" else f"p_{c}" for c in COLUMNS)}) END AS altered FROM p),
leaves AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM l),
{_tree("low", "leaves").strip()},
subs AS (SELECT '' AS k, k AS lang, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n, h FROM low WHERE n = 1),
{_tree("top", "subs").strip()},
root AS (SELECT h AS root FROM top WHERE n = 1),
ls AS (SELECT l.k, l.i AS leaf_at, string_agg(t.h, '' ORDER BY t.lev) AS sib FROM leaves l JOIN low t ON t.k = l.k AND t.n > 1 AND t.i = xor(l.i >> t.lev, 1) GROUP BY 1, 2),
ts AS (SELECT s.lang, string_agg(t.h, '' ORDER BY t.lev) AS sib FROM subs s JOIN top t ON t.n > 1 AND t.i = xor(s.i >> t.lev, 1) GROUP BY 1),
f(k, leaf_at, lev, i, n, h) AS (SELECT k, i, 0::BIGINT, i, n, coalesce(altered, h) FROM leaves
  UNION ALL SELECT f.k, leaf_at, f.lev + 1, f.i // 2, (f.n + 1) // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.h || coalesce(t.h, '') ELSE t.h || f.h END)
  FROM f LEFT JOIN low t ON t.k = f.k AND t.lev = f.lev AND t.i = xor(f.i, 1) WHERE f.n > 1),
g(k, leaf_at, lev, i, n, h) AS (SELECT f.k, leaf_at, 0::BIGINT, s.i, s.n, f.h FROM f JOIN subs s ON s.lang = f.k WHERE f.n = 1
  UNION ALL SELECT g.k, leaf_at, g.lev + 1, g.i // 2, (g.n + 1) // 2, sha256(CASE WHEN g.i % 2 = 0 THEN g.h || coalesce(t.h, '') ELSE t.h || g.h END)
  FROM g LEFT JOIN top t ON t.lev = g.lev AND t.i = xor(g.i, 1) WHERE g.n > 1)
SELECT doc_id, leaves.h AS leaf, subs.h AS subroot, root, sha256(coalesce(ls.sib, '') || coalesce(ts.sib, '')) AS proof_sha256, g.h AS folded_root, g.h = root AS verified
FROM leaves JOIN subs ON subs.lang = leaves.k CROSS JOIN root LEFT JOIN ls ON ls.k = leaves.k AND ls.leaf_at = leaves.i LEFT JOIN ts ON ts.lang = leaves.k
JOIN g ON g.k = leaves.k AND g.leaf_at = leaves.i AND g.n = 1
"""
