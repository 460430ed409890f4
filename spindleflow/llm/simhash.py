"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints that differ in at most ``t`` bits, cut into ``m`` parts with thresholds that sum to ``t - m + 1``,
differ in some part by no more than that part's threshold. Parts hold correlated bits; their thresholds are allocated
unequally by dynamic programming on the number of candidates and probes expected from each choice. Every fingerprint
probes the values within the threshold of each part; candidates are verified on all bits inside the join.

The near copies of the pipeline are found by the same fingerprints and parts, each link decided by exact Jaccard
similarity; links that differ in more bits come from bands of smallest values (``similar_groups``).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindleflow.llm.common import staged, text_slices
from spindleflow.llm.graph import components

# Seeds of the further fingerprints made from the same shingle hashes.
WIDER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def shingle_hashes(text: str, words: int, step: int = 1_000_000):
    """XXH64 (seed 42) of every run of ``words`` words, lower-cased in A-Z and joined by spaces, in slices."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(found) - words + 1]
    ends = ends[words - 1 :]
    for k in range(0, len(begins), step):
        pairs = zip(begins[k : k + step].tolist(), ends[k : k + step].tolist())
        yield np.array([digest(joined[i:j], 42) for i, j in pairs], np.uint64)


def _mixed(hashes: np.ndarray, seed: int) -> np.ndarray:
    x = hashes ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str, words: int, more: int = 0) -> list[int]:
    """The majority bits of a text's shingle hashes as signed 64-bit integers, ``more`` further ones behind the first."""
    return majority_bits(shingle_hashes(text, words), more)


def majority_bits(slices, more: int = 0) -> list[int]:
    counts = np.zeros((more + 1, 64), np.int64)
    total = 0
    for hashes in slices:
        total += len(hashes)
        for row in range(more + 1):
            mixed = hashes if row == 0 else _mixed(hashes, WIDER[row - 1])
            for k in range(0, len(mixed), 65_536):
                bits = np.unpackbits(mixed[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                counts[row] += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(counts * 2 > total, axis=1)
    return majority.view(">i8").reshape(-1).tolist()


def fingerprints(docs: DataFrame, words: int, more: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns id and f0 (, f1 ...) for every row. A text that is NULL or has no word gets zeros."""
    names = [f"f{k}" for k in range(more + 1)]

    def run(batches):
        for batch in batches:
            rows = [fingerprint(t or "", words, more) for t in batch.column(1).to_pylist()]
            values = np.array(rows, np.int64).reshape(-1, more + 1)
            yield pa.record_batch([batch.column(0), *(pa.array(values[:, k]) for k in range(more + 1))], names=["id", *names])

    slim = docs.select(F.col(id_column).cast("long"), F.col(text_column))
    return slim.mapInArrow(run, ", ".join(["id long", *(f"{n} long" for n in names)]))


def group_bits(sample: np.ndarray, parts: int) -> list[int]:
    """Cut the 64 bits into ``parts`` masks, each grown from a bit by those most correlated with it."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
    centred = bits - bits.mean(axis=0)
    spread = np.sqrt((centred**2).mean(axis=0))
    spread[spread == 0] = 1
    tie = np.abs((centred / spread).T @ (centred / spread)) / max(1, len(bits))
    left, masks = list(range(64)), []
    for part in range(parts):
        size = 64 // parts + (part < 64 % parts)
        members = [max(left, key=lambda b: tie[b, left].sum())]
        left.remove(members[0])
        while len(members) < size:
            best = max(left, key=lambda b: tie[b, members].sum())
            members.append(best)
            left.remove(best)
        masks.append(sum(1 << (63 - b) for b in members))
    return masks


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each row of ``costs`` (column t + 1 holds the cost of t), summing to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for held, (cost, chosen) in best.items():
            for place, more in enumerate(row):
                key = held + place - 1
                if key not in following or cost + more < following[key][0]:
                    following[key] = (cost + more, [*chosen, place - 1])
        best = following
    return best[total]


def plan_parts(sample: np.ndarray, rows: int, max_bits: int, row_cost: float = 50.0) -> list[tuple[int, int]]:
    """(mask, threshold) of each part that is probed, for ``rows`` fingerprints like those of the sample.

    The cost of a threshold is the rows its probes make (``row_cost`` pair checks each) and the pairs it brings
    together, estimated from the pairs of the sample and never below what independent bits give. Any answer finds all
    links; the estimate only decides how much work that takes.
    """
    some = sample[:: max(1, len(sample) // 3000)]
    best, answer = np.inf, []
    for parts in range(1, max_bits + 2):
        masks, costs = group_bits(sample, parts), []
        for mask in masks:
            width = mask.bit_count()
            ways = np.array([float(np.prod([(width - k) / (k + 1) for k in range(r)])) for r in range(min(width, max_bits) + 1)])
            probes = np.cumsum(np.round(ways))
            cut, near = some & np.uint64(mask), np.zeros(65, np.int64)
            for k in range(0, len(cut), 500):
                near += np.bincount(np.bitwise_count(cut[k : k + 500, None] ^ cut[None, :]).ravel(), minlength=65)
            near[0] -= len(cut)
            shares = np.cumsum(near)[: len(probes)] / max(1, len(cut) * (len(cut) - 1))
            shares = np.maximum(shares, probes / 2.0**width)
            cost = rows * (1 + probes) * row_cost + rows * (rows - 1) / 2.0 * shares
            costs.append([0.0, *cost.tolist(), *[np.inf] * (max_bits + 1 - len(cost))])
        cost, chosen = allocate(np.array(costs), max_bits - parts + 1)
        if cost < best:
            best, answer = cost, [(m, t) for m, t in zip(masks, chosen) if t >= 0]
    return answer


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _distance(left: str, right: str, columns: list[str]) -> Column:
    return sum((F.bit_count(F.col(f"{left}.{c}").bitwiseXOR(F.col(f"{right}.{c}"))) for c in columns), F.lit(0))


def near_links(
    prints: DataFrame, max_bits: int, max_wide_bits: int | None = None, size_column: str | None = None,
    sample_rows: int = 20_000, hot: int = 4_096,
) -> DataFrame:
    """All links (key_a < key_b) between rows of ``prints``: a unique key, f0 and, if given, further fingerprints.

    Links differ in at most ``max_bits`` bits of f0 and, where asked, ``max_wide_bits`` bits of all fingerprints
    together. ``sample_rows`` rows in hash order steer the plan. A value that more than ``hot`` rows share is dealt
    over slices: its probes are split, its rows repeated for each slice, so no task gets a whole hot value.
    """
    columns = [c for c in prints.columns if c.startswith("f")]
    picked = prints.orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("f0").toPandas()["f0"].to_numpy()
    parts = plan_parts(picked.astype(np.int64).view(np.uint64), prints.count(), max_bits) if len(picked) else []
    if not parts:
        return prints.select(F.col("key").alias("key_a"), F.col("key").alias("key_b")).limit(0)
    entries, flips = [], []
    for number, (mask, threshold) in enumerate(parts):
        bits = [1 << b for b in range(64) if mask >> b & 1]
        entries.append(F.struct(F.lit(number).alias("part"), F.col("f0").bitwiseAND(F.lit(_signed(mask))).alias("value")))
        for size in range(threshold + 1):
            for some in itertools.combinations(bits, size):
                flips.append((number, _signed(mask), _signed(sum(some))))
    index = prints.select("*", F.explode(F.array(*entries)).alias("e")).select(*prints.columns, "e.part", "e.value")
    # The flips are a short literal array, so every probe is made in place by one explode.
    listed = F.from_json(
        F.lit("[" + ",".join(f'{{"p":{p},"m":{m},"x":{x}}}' for p, m, x in flips) + "]"), "array<struct<p int, m long, x long>>"
    )
    probes = prints.select("*", F.explode(listed).alias("e")).select(
        *prints.columns, F.col("e.p").alias("part"), F.col("f0").bitwiseAND(F.col("e.m")).bitwiseXOR(F.col("e.x")).alias("value")
    )
    crowded = index.groupBy("part", "value").count().where(F.col("count") > hot)
    crowded = staged(crowded.select("part", "value", F.ceil(F.col("count") / hot).cast("int").alias("slices")), "hot-values")
    slices = F.coalesce(F.col("slices"), F.lit(1))
    left = probes.join(crowded, ["part", "value"], "left").withColumn("slice", F.pmod(F.xxhash64("key"), slices).cast("int"))
    right = index.join(crowded, ["part", "value"], "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    near = (
        (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.slice") == F.col("b.slice"))
        & (F.col("a.key") < F.col("b.key")) & (_distance("a", "b", ["f0"]) <= max_bits)
    )
    if max_wide_bits is not None:
        near &= _distance("a", "b", columns) <= max_wide_bits
    pairs = left.alias("a").join(right.alias("b"), near)
    return pairs.select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))


def forests(links: DataFrame) -> DataFrame:
    """Links that join the same nodes with fewer rows: of each task's links a spanning forest. A dense group sends on as
    many links as it has members in the task, not as it has pairs; what the tasks share is joined later."""
    a, b = links.columns

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            kept = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    kept.append((x, y))
            if kept:
                yield pa.record_batch([pa.array([k for k, _ in kept], pa.int64()), pa.array([k for _, k in kept], pa.int64())], names=[a, b])

    return links.mapInArrow(run, f"{a} long, {b} long")


def near_groups(
    docs: DataFrame, words: int = 4, max_bits: int = 4, more: int = 0, max_wide_bits: int | None = None,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Fingerprint and component of every row: id, f0, component_id (the smallest id reachable by links).

    Equal fingerprints are one node, so copies make no pairs. NULL and empty texts have fingerprint zero and are linked
    like any other; NULL ids are kept and take part, but a component is named by its smallest id that is not NULL. An
    empty table gives no row.
    """
    rows = staged(fingerprints(docs, words, more, id_column, text_column), "fingerprints")
    columns = [c for c in rows.columns if c != "id"]
    nodes = rows.groupBy(*columns).agg(F.min("id").alias("least"))
    # The key of a node is its first fingerprint, or a hash of all of them.
    key = F.col("f0") if not more else F.xxhash64(*columns)
    nodes = staged(nodes.select(key.alias("key"), *columns, "least"), "nodes")
    links = near_links(nodes.drop("least"), max_bits, max_wide_bits)
    found = components(forests(links))
    named = nodes.join(found.withColumnRenamed("node", "key"), "key").select("key", "root", "least")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only nodes with a link need their component looked up; all others are named by their own smallest id.
    linked = staged(named.join(smallest, "root").select("key", "component_id"), "linked")
    own = nodes.join(linked, "key", "left").select(*columns, F.coalesce("component_id", "least").alias("component_id"))
    same = [rows[c] == own[c] for c in columns]
    return rows.join(own, same).select(rows["id"], rows["f0"], "component_id")


def distinct_hashes(slices: list[np.ndarray]) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    found = [np.unique(h) for h in slices] or [np.zeros(0, np.uint64)]
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def band_values(own: np.ndarray, bands: int, rows: int) -> list[int]:
    """For each band a hash of ``rows`` smallest mixed values. A text without words has no shingle and no band."""
    if not len(own):
        return []
    draw = np.random.default_rng(20_240_501).integers(0, 2**64, (2, bands * rows, 1), np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for k in range(0, len(own), 2_048):
        least = np.minimum(least, ((own[None, k : k + 2_048] ^ draw[0]) * (draw[1] | np.uint64(1))).min(axis=1))
    held = np.arange(bands, dtype=np.uint64)
    for row in least.reshape(bands, rows).T:
        held = _mixed(held * np.uint64(WIDER[0]) + row, WIDER[1])
    return held.view(np.int64).tolist()


def set_key(own: np.ndarray) -> int:
    """Equal for equal sets of shingle hashes."""
    import xxhash

    return _signed(xxhash.xxh64_intdigest(own.tobytes()))


def jaccard_links(owners: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, similarity: float, sides: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of at least ``similarity``.

    ``owners`` names the set (a place in ``sizes``) of each of ``hashes``. Pairs of one side are left out if there are two
    sides. All intersections are counted exactly, as products of slices of the incidence matrix.
    """
    columns, counts = np.unique(hashes, return_inverse=True, return_counts=True)[1:]
    several = counts[columns] > 1
    columns, owners = columns[several], owners[several]
    order = np.argsort(columns, kind="stable")
    owners = owners[order]
    columns = np.cumsum(np.concatenate([[0], np.diff(columns[order]) > 0])) if len(order) else columns
    common = np.zeros((len(sizes), len(sizes)))
    for k in range(0, int(columns[-1]) + 1 if len(columns) else 0, 4_096):
        begin, end = np.searchsorted(columns, [k, k + 4_096])
        has = np.zeros((len(sizes), min(4_096, int(columns[-1]) + 1 - k)), np.float32)
        has[owners[begin:end], columns[begin:end] - k] = 1
        common += has @ has.T
    linked = np.triu(common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9, 1)
    if len(set(sides.tolist())) > 1:
        linked &= sides[:, None] != sides[None, :]
    root, kept = list(range(len(sizes))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*(v.tolist() for v in np.nonzero(linked))):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float, hot: int = 256) -> DataFrame:
    """The rows of ``pairs`` (key, head) whose sets reach the similarity, counted on the whole sets.

    A head that more than ``hot`` keys name has its set repeated for as many slices; the keys are dealt over them.
    """
    slices = pairs.groupBy("head").agg(F.ceil(F.count("*") / hot).cast("int").alias("slices"))
    dealt = pairs.join(slices, "head").withColumn("slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int"))
    heads = slices.join(sets.withColumnsRenamed({"key": "head", "shingles": "other"}), "head")
    heads = heads.select("head", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "other")
    met = dealt.select("head", "slice", "key").join(sets, "key").join(heads, ["head", "slice"])
    common = F.size(F.array_intersect("shingles", "other"))
    return met.where(common >= similarity * (F.size("shingles") + F.size("other") - common) - 1e-9).select("key", "head")


def _star_pairs(met: DataFrame, labels: DataFrame, turn: int) -> DataFrame:
    """For each node the one head it shares most bands with and is not yet known to be linked to: columns key, head.

    A band's head is the first of its nodes in an order that changes with every turn."""
    named = met.join(labels, "key")
    place = F.xxhash64("key", F.lit(turn))
    heads = named.groupBy("band").agg(F.min_by(F.struct("key", "label"), F.struct(place, F.col("key"))).alias("h"))
    shared = named.join(heads, "band").where("key <> h.key AND label <> h.label").groupBy("key", F.col("h.key").alias("head")).count()
    return shared.groupBy("key").agg(F.max_by("head", F.struct("count", "head")).alias("head"))


def bloom(rows: DataFrame, bits_a_row: int = 16, most_bits: int = 1 << 28, probes: int = 4) -> np.ndarray:
    """A Bloom filter (64-bit words) of rows of two longs. Its size follows the number of rows up to a fixed bound of
    ``most_bits`` (32 MB); beyond that more rows pass it, which costs work but loses nothing."""
    a, b = rows.columns
    bits = min(most_bits, 1 << max(16, int(rows.count() * bits_a_row).bit_length()))
    place = F.explode(F.array(*[F.pmod(F.xxhash64(a, b, F.lit(k)), F.lit(bits)) for k in range(probes)]))
    words = rows.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word"))
    held = words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[held["word"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    return out


def _places(filter_words: np.ndarray, a: str, b: str, probes: int = 4) -> Column:
    """The bits of a Bloom filter that a row of two longs asks for."""
    return F.array(*[F.pmod(F.xxhash64(a, b, F.lit(k)), F.lit(len(filter_words) * 64)) for k in range(probes)])


def _all_set(filter_words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((filter_words[places >> 6] >> (places & 63)) & 1 == 1).all(axis=1)


def maybe_in(filter_words: np.ndarray, spark, a: str, b: str, probes: int = 4) -> Column:
    """Whether a row of two longs may be in a Bloom filter; never false for one that is."""
    shared = spark.sparkContext.broadcast(filter_words)

    @F.pandas_udf("boolean")
    def passes(places: pd.Series) -> pd.Series:
        return pd.Series(_all_set(shared.value, np.stack(places.to_numpy()) if len(places) else np.zeros((0, probes), np.int64)))

    return passes(_places(filter_words, a, b, probes))


def _compared_in_slices(sized: DataFrame, sets: DataFrame, similarity: float, most: int, most_shingles: int) -> DataFrame:
    """Links among the nodes (key, size, settled) of each group (root). Settled nodes are known to be linked to each
    other and need only be compared with the rest of their group.

    Both kinds are dealt over slices of up to ``most`` nodes or ``most_shingles`` shingles, about. Every two slices meet in
    a task, but no two settled ones, so a settled set is sent once for each slice of the others; a task sends on a
    spanning forest of its links.
    """
    slices = F.ceil(F.greatest(F.count("*") / most, F.sum("size") / most_shingles)).cast("int")
    per = sized.groupBy("root", "settled").agg(slices.alias("slices"))
    count = lambda kind: F.coalesce(F.max(F.when(F.col("settled") == kind, F.col("slices"))), F.lit(0))
    placed = sized.join(per.groupBy("root").agg(count(False).alias("open"), count(True).alias("shut")), "root")
    side = F.pmod(F.xxhash64("key"), F.when(F.col("settled"), F.col("shut")).otherwise(F.col("open"))).cast("int")
    # Open slices are numbered from 0, settled ones behind them.
    placed = placed.withColumn("side", F.when(F.col("settled"), F.col("open") + side).otherwise(side))
    partners = F.when(F.col("settled"), F.col("open")).otherwise(F.col("open") + F.col("shut"))
    meeting = placed.where(partners > 0).select("key", "root", "side", F.explode(F.sequence(F.lit(0), partners - 1)).alias("other"))
    meeting = meeting.select("key", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))

    def compared(table: pa.Table) -> pa.Table:
        keys, first = np.unique(table.column("key").to_numpy(), return_index=True)
        table = table.take(pa.array(first)).combine_chunks()
        lists = table.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = jaccard_links(np.repeat(np.arange(len(keys)), sizes), lists.flatten().to_numpy(zero_copy_only=False), sizes, similarity, table.column("side").to_numpy())
        return pa.table({"key_a": pa.array([int(keys[x]) for x, _ in pairs], pa.int64()), "key_b": pa.array([int(keys[y]) for _, y in pairs], pa.int64())})

    return meeting.join(sets, "key").groupBy("root", "i", "j").applyInArrow(compared, "key_a long, key_b long")


def _print_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Pairs (key, head) that connect all nodes (key, f0) whose fingerprints differ in at most ``max_bits`` bits.

    The first node of a fingerprint stands for it, so equal fingerprints make no pairs among themselves; of the links
    between fingerprints each task keeps a forest."""
    heads = staged(nodes.groupBy("f0").agg(F.min("key").alias("key"), F.count("*").alias("n")), "prints")
    links = forests(near_links(heads.select("key", "f0"), max_bits))
    same = nodes.join(heads.where("n > 1").select("f0", F.col("key").alias("head")), "f0").where("key <> head")
    return same.select("key", "head").unionByName(links.select(F.col("key_a").alias("key"), F.col("key_b").alias("head")))


def _linked_sets(nodes: DataFrame, texts: DataFrame, words: int, similarity: float, max_bits: int, turns: int, most: int, most_shingles: int) -> DataFrame:
    """Links (key_a, key_b) that connect all sets of a Jaccard similarity of at least ``similarity`` whose fingerprints
    differ in at most ``max_bits`` bits or which share a band.

    Pairs of near fingerprints are verified first and what they link is contracted; bands whose nodes are all of one
    component are settled and go. Of the rest, groups of candidates that one task can hold are compared whole: each set
    goes there once. In larger groups each node is first compared with heads of its bands, one comparison a node and
    turn, and what is linked so is contracted; only nodes that share a band with a node of another component then meet in
    slices.
    """
    spark = nodes.sparkSession
    pairs = staged(_print_pairs(nodes.select("key", "f0"), max_bits), "print-pairs")
    entries = nodes.select("key", F.explode("bands").alias("band"))
    several = entries.groupBy("band").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "low")
    met = staged(entries.join(several, "band"), "shared-bands")
    asked = met.select("key").unionByName(pairs.select("key")).unionByName(pairs.select(F.col("head").alias("key"))).distinct()
    asked = staged(asked.join(nodes.select("key", "size", "least"), "key"), "candidates")
    # Texts stay where they are: rows that may be a candidate's are told by a filter and give their sets in place.
    wanted = bloom(asked.select(F.col("least.own").alias("own"), F.col("least.hash").alias("hash")))
    shared = spark.sparkContext.broadcast(wanted)

    def whole(batches):
        for batch in batches:
            places = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            found = batch.column(0).filter(pa.array(_all_set(shared.value, places), pa.bool_()))
            for _, _, texts in text_slices(found):
                sets = [distinct_hashes(list(shingle_hashes(t, words))) for t in texts]
                yield pa.record_batch([pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "shingles"])

    # The filter and the sets share one worker: a filter of its own would take a second one for every task.
    sets = staged(texts.select("t", _places(wanted, "own", "hash").alias("places")).mapInArrow(whole, "key long, shingles array<long>"), "shingles")
    links = staged(_verified(pairs, sets, similarity), "print-links")
    known = components(forests(links)).withColumnRenamed("node", "key")
    named = met.join(known, "key", "left").select("key", "band", "low", F.coalesce("root", "key").alias("label"))
    mixed = named.groupBy("band").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("band")
    met = staged(named.join(mixed, "band").select("key", "band", "low"), "mixed-bands")
    groups = components(forests(met.where("key <> low").select("key", "low").distinct())).withColumnRenamed("node", "key")
    sized = staged(groups.join(asked.select("key", "size"), "key"), "band-groups")
    large = sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s")).where((F.col("n") > most) | (F.col("s") > most_shingles)).select("root")
    large = staged(large, "large-groups")
    small = sized.join(large, "root", "left_anti").select("key", "root", "size", F.lit(False).alias("settled"))
    small_links = _compared_in_slices(small, sets, similarity, most, most_shingles)
    if large.isEmpty():
        return small_links.unionByName(links.select(F.col("key").alias("key_a"), F.col("head").alias("key_b")))
    crowd = staged(sized.join(large, "root").select("key", "size"), "crowd")
    sets = staged(sets.where(maybe_in(bloom(crowd.select("key", F.col("key").alias("same"))), spark, "key", "key")), "crowd-shingles")
    met = staged(met.join(crowd.select("key"), "key").select("key", "band"), "crowded-bands")
    for turn in range(turns):
        # Nodes linked to one head belong together; chains of heads are followed below.
        best = links.groupBy("key").agg(F.min("head").alias("head"))
        labels = crowd.join(best, "key", "left").select("key", F.coalesce("head", "key").alias("label"))
        links = links.unionByName(staged(_verified(_star_pairs(met, labels, turn), sets, similarity), "star-links"))
    links = links.select(F.col("key").alias("key_a"), F.col("head").alias("key_b"))
    known = components(forests(links)).withColumnRenamed("node", "key")
    contracted = crowd.join(known, "key", "left").select("key", F.coalesce("root", "key").alias("label"))
    named = staged(met.join(contracted, "key"), "contracted")
    mixed = named.groupBy("band").agg(F.min("label").alias("first"), F.max("label").alias("last")).where("first <> last").select("band", "first")
    left = staged(named.join(mixed, "band").select("key", "label", "first").distinct(), "undecided")
    ties = components(forests(left.where("label <> first").select("label", "first").distinct())).withColumnRenamed("node", "label")
    rest = staged(left.select("key", "label").distinct().join(ties, "label").join(crowd, "key"), "undecided-sizes")
    # Of each group the component with the most nodes is settled.
    main = rest.groupBy("root", "label").count().groupBy("root").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    rest = rest.join(main, "root").select("key", "root", "size", (F.col("label") == F.col("main")).alias("settled"))
    rest_links = _compared_in_slices(staged(rest, "undecided-groups"), sets, similarity, most, most_shingles)
    return small_links.unionByName(links).unionByName(rest_links)


def _similar_rows(docs: DataFrame, words: int, similarity: float, max_bits: int, bands: int, rows: int, turns: int, most: int, most_shingles: int, id_column: str, text_column: str) -> DataFrame:
    """own, hash and least of every row: its id and the hash of its text, and the same two of the first row of its
    component (in the order of ids, then hashes)."""
    slim = docs.select(F.col(id_column).cast("long").alias("own"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    slim = slim.select("own", F.xxhash64("t").alias("hash"), "t")

    def sketched(batches):
        for batch in batches:
            for begin, end, texts in text_slices(batch.column(2)):
                found = []
                for text in texts:
                    slices = list(shingle_hashes(text, words))
                    own = distinct_hashes(slices)
                    found.append((set_key(own), len(own), majority_bits(slices)[0], band_values(own, bands, rows)))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)]
                ids = batch.slice(begin, end - begin)
                yield pa.record_batch([ids.column(0), ids.column(1), *columns], names=["own", "hash", "key", "size", "f0", "bands"])

    every = staged(slim.mapInArrow(sketched, "own long, hash long, key long, size long, f0 long, bands array<long>"), "sketches")
    least = F.min(F.struct("own", "hash")).alias("least")
    # Equal sets are one node, so copies make no entries of their own.
    merged = every.groupBy("key").agg(least, F.first("size").alias("size"), F.min("f0").alias("f0"), F.first("bands").alias("bands"))
    nodes = staged(merged, "nodes")
    links = _linked_sets(nodes, slim, words, similarity, max_bits, turns, most, most_shingles)
    found = components(forests(links)).withColumnRenamed("node", "key")
    named = nodes.select("key", "least").join(found, "key")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("key", "first")
    linked = staged(named, "linked")
    own = nodes.select("key", "least").join(linked, "key", "left").select("key", F.coalesce("first", "least").alias("least"))
    return every.select("own", "hash", "key").join(own, "key").select("own", "hash", "least")


def _own_ids(docs: DataFrame, id_column: str, text_column: str) -> Column:
    """The id of a row; rows without one come behind all others and are told apart by their text."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))), F.lit(1 << 61)))


def similar_groups(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 40, rows: int = 5, turns: int = 2, most: int = 512, most_shingles: int = 2_000_000,
    max_bits: int = 4, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Columns id and component_id of every row: components of the links between texts whose sets of shingles have a
    Jaccard similarity of at least ``similarity``, each named by its smallest id.

    Equal sets are one node. Candidates are nodes whose fingerprints differ in at most ``max_bits`` bits, all of them
    found as in ``near_links``, and, as texts of a similarity of 0.8 differ in some ten bits, nodes that share a band of
    smallest values; a pair at 0.8 shares none of the 40 bands of 5 with a probability of 1.3e-7. What is linked is decided on the whole sets, see ``_linked_sets``; the
    result is the same for any ``turns``, ``most`` and ``most_shingles``. Texts without words are one node, like no other.
    NULL ids take part; a component of rows without ids alone has none.
    """
    own = _own_ids(docs, id_column, text_column)
    named = docs.select(own.alias("own"), F.col(text_column).alias("text"))
    found = _similar_rows(named, words, similarity, max_bits, bands, rows, turns, most, most_shingles, "own", "text")
    known = lambda c: F.when(c < F.lit(1 << 62), c)
    return found.select(known(F.col("own")).alias("id"), known(F.col("least.own")).alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest id.

    Texts are linked when the Jaccard similarity of their shingles, counted exactly, is ``similarity`` or more. Rows of
    one id and one text count as one document (the row of the smallest hash stays); rows of one id and unlike texts are
    documents of their own, told apart by the hash of the text. Rows without an id rank behind all others of their group.
    """
    own, text = _own_ids(docs, id_column, text_column), F.coalesce(F.col(text_column), F.lit(""))
    found = _similar_rows(docs.select(own.alias("own"), F.col(text_column).alias("text")), words, similarity, 4, 40, 5, 2, 512, 2_000_000, "own", "text")
    stays = F.col("own").eqNullSafe(F.col("least.own")) & F.col("hash").eqNullSafe(F.col("least.hash"))
    once = found.groupBy("own", "hash").agg(F.count("*").alias("n"), F.first(stays).alias("stays"))
    # Most rows are single and stay: only those that may go, or that stand more than once, are looked up.
    doubtful = staged(once.where(~F.col("stays") | (F.col("n") > 1)), "doubtful")
    rows = docs.select(own.alias("own"), F.xxhash64(text).alias("hash"), F.struct("*").alias("row"))
    rows = rows.withColumn("doubt", maybe_in(bloom(doubtful.select("own", "hash")), docs.sparkSession, "own", "hash"))
    looked_up = rows.where("doubt").join(doubtful, ["own", "hash"], "left").where(F.coalesce("stays", F.lit(True)))
    single = looked_up.where(F.coalesce("n", F.lit(1)) == 1).select("row.*")
    several = looked_up.where("n > 1").groupBy("own", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return rows.where(~F.col("doubt")).select("row.*").unionByName(single).unionByName(several)
