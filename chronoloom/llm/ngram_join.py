r"""Exact Jaccard join of documents' word-shingle sets by PartEnum signatures.

Two documents link where ``|A & B| >= 0.75 |A | B|``. For a pair of sizes ``a <= b`` this bounds the number of shingles that
only one of them has by ``d = (a + b) / 7 <= 2b / 7``. Sizes are grouped into bands; a set takes part in the band of its own
size and, as a possible smaller partner, in the next one.

* Bands of up to ``SMALL`` shingles: every shingle is a partition of its own and its own signature.
* Larger bands: the shingle domain is cut by hash into ``n1`` partitions of three sub-partitions each. A signature is the
  content of two sub-partitions of one partition (three subsets each). Where a partition holds at most one differing
  sub-partition, one of its subsets is equal on both sides; as fewer than ``d / 2`` partitions can hold two differing shingles
  or more and ``n1 > d / 2``, similar sets share a signature. Empty subsets are not signed; a set whose clean partitions (three
  non-empty subsets) outnumber ``d / 2`` needs none of them. Should a set have fewer, it and all sets that could be its
  smaller partners with too few clean partitions themselves are treated as open sets, see below.

Signatures travel in packed blocks: each task deals its signatures to buckets by hash, without the sets, one emission per
distinct set and task. The number of buckets follows from the number of signatures, copies in other tasks included, so that a bucket has
about ``PER_BUCKET`` at every size of the table. A bucket is sorted, and sets that share a signature meet there. Groups of up to ``LIGHT`` sets give their
pairs (a bounded number for each member). Larger groups are heavy: copies edited many times, or passages that many documents
share. A set that keeps more clean partitions than ``d / 2`` apart from its heavy signatures finds every partner elsewhere.
The others, the open sets, are joined among themselves by prefixes: shingles in order of their frequency among open sets,
rarest first, of which similar sets share one among the first ``n / 4 + 1``. The sets of such a shingle are linked to one hub
first; after the components are known, only pairs of different components that pass the size and position filters are left to
compare. All candidate pairs are checked on their full sets.

Equal sets are one node throughout, so copies never multiply; components are found by alternating star contractions, with
checkpoints in the session's checkpoint folder. Nothing that grows with the table goes through the driver.

Defined results: a null, empty or wordless text has no shingles and is linked with nothing, its component is its own doc_id;
texts of one to four words have one shingle; repeated rows of a doc_id link like any copies; rows without doc_id take part,
and a component of such rows alone has a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import free_name, with_checkpoint_dir
from chronoloom.llm.shingles import mix, set_digests, shingle_sets, text_chunks

NEAR, WHOLE = 75, 100
SMALL = 128
STEP = (4 / 3) ** 2
PARTITIONS_PER_SIZE = 0.17
LIGHT = 16
BROADCAST_ROWS = 500_000
PACK = 500_000
#: Buckets of signatures at least, and the signatures that one is to hold.
BUCKETS, PER_BUCKET = 48, 3_000_000
#: Signatures of a run (consecutive ones of one set and band) at most; its length and its band share 16 bits.
RUN_BITS = 10
RUN = (1 << RUN_BITS) - 1

_U = np.uint64
LIGHT_PAIR, HEAVY_MEMBER = 0, 1


def band_edges(upto: int = 1 << 40) -> np.ndarray:
    """Largest size of each band."""
    edges = [SMALL]
    while edges[-1] < upto:
        edges.append(int(edges[-1] * STEP))
    return np.array([1, 8, 24, 64, *edges])


_EDGES = band_edges()


def first_level(band: np.ndarray) -> np.ndarray:
    """Partitions of a band of sets larger than ``SMALL``."""
    return np.ceil(_EDGES[band] * PARTITIONS_PER_SIZE).astype(np.int64) + 4


def signatures(sets: np.ndarray, bounds: np.ndarray, band: np.ndarray, taking: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the sets that take part in their given band: (signature, index of the set), and clean partitions by set."""
    sizes = np.diff(bounds)
    n = len(sizes)
    clean = np.zeros(n, np.int64)
    owner = np.repeat(np.arange(n), sizes)
    salt = mix(band.astype(_U) + _U(1))
    # one partition for each shingle
    small = taking & (_EDGES[band] <= SMALL)
    clean[small] = sizes[small]
    own = small[owner]
    out_sig, out_set = [mix(sets[own] ^ salt[owner[own]])], [owner[own]]
    # three sub-partitions in each partition, signed two by two
    large = taking & ~small
    pick = large[owner]
    if pick.any():
        x, who = sets[pick], owner[pick]
        parts = np.where(large, first_level(band), 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        part = base[who] + ((x >> _U(32)) * parts[who].astype(_U) >> _U(32)).astype(np.int64)  # ascends as the sets do
        sub = (x & _U(0xFFFF)) % _U(3)
        content = mix(x ^ salt[who])
        ends = np.cumsum(np.bincount(part, minlength=base[-1]))
        sums, filled = [], []
        for j in range(3):
            here = sub == _U(j)
            total = np.concatenate([np.zeros(1, _U), np.cumsum(np.where(here, content, _U(0)))])
            count = np.concatenate([[0], np.cumsum(here)])
            before = np.concatenate([[0], ends[:-1]])
            sums.append(total[ends] - total[before])
            filled.append(count[ends] - count[before])
        part_set = np.repeat(np.arange(n), parts)
        twos = ((0, 1), (0, 2), (1, 2))
        full = np.stack([(filled[a] + filled[b]) > 0 for a, b in twos], 1)  # a set's signatures stay together
        out_sig.append(np.stack([mix(sums[a] + mix(sums[b] + _U(3 * a + b + 1))) for a, b in twos], 1)[full])
        out_set.append(np.repeat(part_set, 3)[full.ravel()])
        clean += np.bincount(part_set[full.all(axis=1)], minlength=n)
    return np.concatenate(out_sig), np.concatenate(out_set), clean


def takes_next(sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Sets that may be the smaller partner of a set of the next band."""
    return (sizes > 0) & (WHOLE * sizes >= NEAR * (_EDGES[band] + 1))


def _key(doc_id: str = "doc_id", text: str = "text") -> Column:
    return F.coalesce(F.col(doc_id), F.xxhash64(text))


def _text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, keys, n_shingles, digest of the set, its band, and its clean partitions in this band and the next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().cast("long").alias("key"), _text_key().alias("text_key"), "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(batch.column("text")):
                sets, bounds = shingle_sets(data, offsets)
                sizes = np.diff(bounds)
                band = np.searchsorted(_EDGES, sizes)
                clean = [signatures(sets, bounds, np.minimum(band + k, len(_EDGES) - 1), sizes > 0 if k == 0 else takes_next(sizes, band))[2] for k in (0, 1)]
                columns = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "key", "text_key")]
                columns += [pa.array(v) for v in (sizes, set_digests(sets, bounds).view(np.int64), band.astype(np.int32), clean[0], clean[1])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "text_key", "n_shingles", "digest", "band", "clean0", "clean1"])

    return rows.mapInArrow(apply, "doc_id long, key long, text_key long, n_shingles long, digest long, band int, clean0 long, clean1 long")


def _pack(sig: np.ndarray, band: np.ndarray, digest: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Signatures dealt to buckets by their upper bits: the lower 32 bits, with digests, lengths and bands run by run."""
    bucket = ((sig >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    sig, band, digest, bucket = sig[order], band[order], digest[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows: dict[str, list] = {k: [] for k in ("bucket", "low", "run_digest", "run")}
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        d, g = digest[lo:hi], band[lo:hi]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1])]))
        place = np.arange(hi - lo) - np.repeat(new, np.diff(np.concatenate([new, [hi - lo]])))
        new = np.flatnonzero(place % RUN == 0)
        length = np.diff(np.concatenate([new, [hi - lo]]))
        rows["bucket"].append(bucket[lo])
        rows["low"].append((sig[lo:hi] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes())
        rows["run_digest"].append(d[new].tobytes())
        rows["run"].append((g[new] << RUN_BITS | length).astype(np.uint16).tobytes())
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})


def signature_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed signatures of all documents, each distinct set once for each task."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                sets, bounds = shingle_sets(data, offsets)
                sizes, digests = np.diff(bounds), set_digests(sets, bounds)
                first = np.zeros(len(sizes), bool)
                for k, d in enumerate(digests.tolist()):
                    if d not in seen:
                        seen.add(d)
                        first[k] = True
                band = np.searchsorted(_EDGES, sizes)
                for k, taking in ((0, first & (sizes > 0)), (1, first & takes_next(sizes, band))):
                    sig, who, _ = signatures(sets, bounds, np.minimum(band + k, len(_EDGES) - 1), taking)
                    held.append((sig, band[who] + k, digests[who]))
                    n_held += len(sig)
                if n_held >= PACK:
                    yield _pack(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                    held, n_held = [], 0
        if n_held:
            yield _pack(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    return docs.select("text").mapInArrow(apply, "bucket int, low binary, run_digest binary, run binary")


def meet(sig: np.ndarray, band: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, ...]:
    """(kind, x, y, band, n) of the sets that share signatures of one bucket: pairs of light groups with their number of common
    signatures, and members of heavy groups."""
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    order = order[same[1:] | same[:-1]]  # in a group of two or more
    s, g, d = sig[order], band[order], digest[order]
    order = np.lexsort((d, s))
    s, g, d = s[order], g[order], d[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])]) if len(s) else np.zeros(0, bool)
    s, g, d = s[new], g[new], d[new]
    heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([heads, [len(s)]]))
    heavy = sizes > LIGHT
    is_heavy = np.repeat(heavy, sizes)
    place = np.arange(len(s)) - np.repeat(heads, sizes)
    left = np.repeat(sizes, sizes) - place - 1  # later members of the same group
    pairs = [np.zeros((3, 0), np.int64)]
    for k in range(1, LIGHT):
        at = np.flatnonzero(~is_heavy & (left >= k))
        if not len(at):
            break
        pairs.append(np.stack([d[at], d[at + k], g[at].astype(np.int64)]))
    every = np.concatenate(pairs, 1)
    a, b, band_of = every[:, np.lexsort(every)]
    new = np.flatnonzero(np.concatenate([[len(a) > 0], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (band_of[1:] != band_of[:-1])])[: len(a)])
    shared = np.diff(np.concatenate([new, [len(a)]]))
    hs, hg, hd = s[is_heavy].view(np.int64), g[is_heavy].astype(np.int64), d[is_heavy]
    kind = np.concatenate([np.full(len(new), LIGHT_PAIR, np.int32), np.full(len(hs), HEAVY_MEMBER, np.int32)])
    return kind, np.concatenate([a[new], hs]), np.concatenate([b[new], hd]), np.concatenate([band_of[new], hg]).astype(np.int32), np.concatenate([shared, np.ones(len(hs), np.int64)])


def meetings(blocks: DataFrame, buckets: int) -> DataFrame:
    """(kind, x, y, band, n) over all buckets."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for bucket, low, digest, run in zip(*(batch.column(c).to_pylist() for c in ("bucket", "low", "run_digest", "run")), strict=True):
                run = np.frombuffer(run, np.uint16)
                n = run & RUN
                parts.setdefault(bucket, []).append((np.frombuffer(low, np.uint32), np.repeat((run >> RUN_BITS).astype(np.uint8), n), np.repeat(np.frombuffer(digest, np.uint64).view(np.int64), n)))
        for b in list(parts):
            sig, band, digest = (np.concatenate(x) for x in zip(*parts.pop(b), strict=True))
            columns = meet(sig.astype(_U) | _U(b) << _U(32), band, digest)
            for lo in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[lo : lo + 100_000]) for v in columns], names=["kind", "x", "y", "band", "n"])

    return blocks.repartitionById(buckets, F.col("bucket")).mapInArrow(apply, "kind int, x long, y long, band int, n long")


def _edge(band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(e)) for e in _EDGES]), F.least(band + 1, F.lit(len(_EDGES))))


def n_buckets(of_set: DataFrame) -> int:
    """Buckets for the signatures of the given sets, in both of their bands."""
    count = lambda edge: F.when(edge <= SMALL, F.col("n_shingles")).otherwise(3 * (edge * PARTITIONS_PER_SIZE + 5))
    own, following = _edge(F.col("own_band")), _edge(F.col("own_band") + 1)
    total = of_set.agg(F.sum(count(own) + F.when(WHOLE * F.col("n_shingles") >= NEAR * (own + 1), count(following)).otherwise(0.0))).first()[0]
    return max(BUCKETS, int((total or 0) / PER_BUCKET) + 1)


def shingle_rows(docs: DataFrame) -> DataFrame:
    """(digest, shingles) of each document."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column("text")):
                sets, bounds = shingle_sets(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_digests(sets, bounds).view(np.int64)), lists], names=["digest", "shingles"])

    return docs.select("text").mapInArrow(apply, "digest long, shingles array<long>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where a count has shown it to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def sets_of(docs: DataFrame, profile: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, shingles) of the wanted digests, read again from one document of each."""
    wanted = profile.groupBy("digest").agg(F.min("key").alias("key")).join(digests, "digest", "left_semi").select("key").distinct().checkpoint()
    rows = docs.select("text", _key().cast("long").alias("key")).join(_small(wanted, wanted.count()), "key", "left_semi")
    return shingle_rows(rows).dropDuplicates(["digest"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    a = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return pairs.join(a, "a").join(b, "b").where(WHOLE * common >= NEAR * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, by large-star and small-star steps."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now


def enough_shared(light: DataFrame, part: DataFrame, edge: Column) -> DataFrame:
    """The pairs (a, b) of light groups whose sizes fit and that share as many signatures as similar sets must.

    With at most ``d`` differing shingles, a set of ``c`` clean partitions keeps ``max(2c - d, 3c - 2d)`` of its signatures (one
    difference in a partition costs two of three, a second one the last); of single shingles, similar sets share
    ``3 (a + b) / 7``. Heavy signatures aren't counted in light groups and are taken off.
    """
    side = lambda s: part.select(F.col("digest").alias(s), "band", *(F.col(c).alias(f"{c}_{s}") for c in ("n_shingles", "own_band", "clean", "n_heavy")))
    both = light.join(side("a"), ["a", "band"]).join(side("b"), ["b", "band"])
    na, nb = F.col("n_shingles_a"), F.col("n_shingles_b")
    own = F.when(na >= nb, F.col("own_band_a")).otherwise(F.col("own_band_b"))
    d = F.floor((na + nb) / 7)
    kept = lambda c: F.greatest(2 * c - d, 3 * c - 2 * d)
    single = F.ceil(3 * (na + nb) / 7)
    least = F.when(edge <= SMALL, single - F.least("n_heavy_a", "n_heavy_b")).otherwise(F.greatest(kept(F.col("clean_a")) - F.col("n_heavy_a"), kept(F.col("clean_b")) - F.col("n_heavy_b")))
    return both.where((own == F.col("band")) & (WHOLE * F.least(na, nb) >= NEAR * F.greatest(na, nb)) & (F.col("n") >= least)).select("a", "b")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, digest, n, place, centre): the ``n / 4 + 1`` rarest shingles of each set, without those that no other set has.

    ``centre`` is the mean frequency of all shingles of the set: of copies edited in different places, the original has most.
    """
    tokens = sets.select("digest", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ranked = tokens.join(counts, "token").groupBy("digest", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("order"), F.avg("df").alias("centre"))
    first = F.slice("order", F.lit(1), F.col("n") - F.ceil(F.col("n") * NEAR / WHOLE).cast("int") + 1)
    return ranked.select("digest", "n", "centre", F.posexplode(first).alias("place", "t")).where("t.df > 1").select("t.token", "digest", "n", "place", "centre")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' profiles, and (digest, component) of all sets that have a link to another set."""
    with_checkpoint_dir(docs.sparkSession)
    profile = profiles(docs).checkpoint()
    of_set = profile.where("n_shingles > 0").select("digest", "n_shingles", F.col("band").alias("own_band"), "clean0", "clean1").dropDuplicates(["digest"]).checkpoint()
    of_task = profile.where("n_shingles > 0").select(F.spark_partition_id().alias("task"), "digest", "n_shingles", F.col("band").alias("own_band")).distinct()  # as they are emitted
    buckets = n_buckets(of_task)
    met = meetings(signature_blocks(docs, buckets), buckets).checkpoint()
    light = met.where(F.col("kind") == LIGHT_PAIR).select(F.col("x").alias("a"), F.col("y").alias("b"), "band", "n")
    heavy = met.where(F.col("kind") == HEAVY_MEMBER).select(F.col("x").alias("group"), F.col("y").alias("digest"), "band")

    # each set in each band it takes part in: clean partitions, heavy signatures
    both = F.array(F.struct(F.col("own_band").alias("band"), F.col("clean0").alias("clean")), F.struct((F.col("own_band") + 1).alias("band"), F.col("clean1").alias("clean")))
    n_heavy = heavy.groupBy("digest", "band").agg(F.count("*").alias("n_heavy"))
    part = of_set.select("digest", "n_shingles", "own_band", F.inline(both)).join(n_heavy, ["digest", "band"], "left").fillna(0, ["n_heavy"]).checkpoint()

    edge = _edge(F.col("band"))
    pairs = enough_shared(light.groupBy("a", "b", "band").agg(F.sum("n").alias("n")), part, edge).distinct().checkpoint()

    # members of heavy groups that may have a partner there alone
    largest = F.floor(F.col("n_shingles") * WHOLE / NEAR)  # partner that a set of this size may have
    largest = F.when(F.col("band") == F.col("own_band"), F.least(largest, edge)).otherwise(largest)
    apart = F.floor((F.col("n_shingles") + largest) / 7)
    allowed = F.when(edge <= SMALL, apart).otherwise(F.floor(apart / 2))
    open_sets = part.where((F.col("n_heavy") > 0) & (F.col("clean") - F.col("n_heavy") <= allowed)).select("digest", "band")
    as_larger = F.floor(2 * F.col("n_shingles") / 7)
    loose = part.where((F.col("band") == F.col("own_band")) & (F.col("clean") <= F.when(edge <= SMALL, as_larger).otherwise(F.floor(as_larger / 2))))
    if not loose.isEmpty():  # then partners that rely on clean partitions of the larger set may share none: all such sets are open
        before = F.element_at(F.array(*[F.lit(int(e)) for e in _EDGES]), F.greatest(F.col("band"), F.lit(1)))
        takes_part = (F.col("band") == F.col("own_band")) | (WHOLE * F.col("n_shingles") >= NEAR * (before + 1))
        open_sets = part.where(takes_part & (F.col("clean") - F.col("n_heavy") <= allowed)).select("digest", "band")
    open_digests = open_sets.select("digest").distinct().checkpoint()

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("digest")).unionByName(open_digests).distinct()
    sets = sets_of(docs, profile, nodes).checkpoint()
    links = verified(pairs, sets).checkpoint()
    prefix = prefixes(sets.join(open_digests, "digest", "left_semi")).checkpoint()
    hubs = prefix.groupBy("token").agg(F.max_by("digest", F.struct("centre", "digest")).alias("a")).checkpoint()
    star = prefix.join(hubs, "token").where("a <> digest").select(F.least("a", "digest").alias("_a"), F.greatest("a", "digest").alias("_b")).toDF("a", "b").distinct().join(pairs, ["a", "b"], "left_anti").checkpoint()
    links = links.unionByName(verified(star, sets)).checkpoint()
    found = components(links).checkpoint()

    # what the hubs have not joined: pairs of different components that share a shingle of their prefixes
    label = prefix.join(found.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    split = label.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token").checkpoint()
    rest = label.join(split, "token", "left_semi").checkpoint()
    side = lambda s: rest.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("digest", "component", "n", "place")))
    na, nb = F.col("n_a"), F.col("n_b")
    near_size = WHOLE * F.least(na, nb) >= NEAR * F.greatest(na, nb)
    reach = F.least(na - F.col("place_a"), nb - F.col("place_b")) >= F.ceil(3 * (na + nb) / 7)
    more = side("a").join(side("b"), "token").where((F.col("component_a") < F.col("component_b")) & near_size & reach)
    more = more.select(F.least("digest_a", "digest_b").alias("a"), F.greatest("digest_a", "digest_b").alias("b")).distinct()
    more = more.join(pairs, ["a", "b"], "left_anti").join(star, ["a", "b"], "left_anti").checkpoint()
    extra = verified(more, sets).checkpoint()
    if extra.isEmpty():
        return profile, found
    return profile, components(extra.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def assign(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, label (of its component, null without shingles), component_id."""
    profile, found = classes(docs)
    some = profile.where("n_shingles > 0").join(found.withColumnRenamed("node", "digest"), "digest", "left")
    some = some.select("doc_id", "text_key", "n_shingles", F.coalesce("component", "digest").alias("label")).checkpoint()
    least = some.groupBy("label").agg(F.min("doc_id").alias("component_id")).checkpoint()  # a table of its own, so that the join may split a large group
    none = profile.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return some.join(least, "label").select("doc_id", "text_key", "n_shingles", "label", "component_id").unionByName(none)


def score_documents(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id (rows without one come last), of several texts of this id in the
    component that of the smallest hash, of repeated rows any. Texts of one doc_id in different components all stay, as do rows
    without words, which are in no group. A row is told by its doc_id and the hash of its text."""
    with_checkpoint_dir(docs.sparkSession)
    rows = assign(docs).where("n_shingles > 0").select("label", "doc_id", "text_key").checkpoint()
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = rows.groupBy("label").agg(F.min(place).alias("first")).checkpoint()
    gone = rows.join(first, "label").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_key").distinct().checkpoint()
    again = first.join(rows.groupBy("label", "doc_id", "text_key").count().where("count > 1"), "label").where(place.eqNullSafe(F.col("first"))).select("doc_id", "text_key").checkpoint()
    own = free_name(docs, "_text_key")
    keyed = docs.withColumn(own, _text_key())

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.toDF("_doc_id_", "_text_key_")
        return left.join(_small(right, right.count()), left["doc_id"].eqNullSafe(right["_doc_id_"]) & (left[own] == right["_text_key_"]), how)

    kept = joined(keyed, gone, "left_anti")
    if not again.isEmpty():
        kept = joined(kept, again, "left_anti").unionByName(joined(kept, again, "left_semi").dropDuplicates(["doc_id", own]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
