"""SimHash near-duplicates by a Gray-order hierarchical index.

``fingerprints`` gives each text 64 bits from its word shingles. Equal fingerprints fall together before anything else,
so groups of copies cost one entry each. Fingerprints that differ in ``distance`` bits or fewer agree on at least one
of ``distance + 1`` blocks of bits (or two of ``distance + 2``, and so on); each is dealt once for each, by its bits.
Within such a bucket the fingerprints are sorted by their Gray rank, so that neighbours share most bits, and indexed
bottom-up: a node holds the bits that all entries below it share, and of these only the ones that its parent lacks are
compared, on top of the differences counted so far; past ``distance`` the whole node is left out, and where even the bits
that its entries don't share can't lead past it, all of it is taken at once. A bucket above ``group_rows`` entries is
dealt in parts: a part is indexed in a task of its own, past which the bucket's fingerprints are streamed.

A task passes on a spanning forest of the links it found, not the pairs; ``components`` joins the forests.

``one_of_each`` looks for texts that are much less alike, and so takes longer fingerprints of ``WIDE`` bits: each of
``TABLES`` buckets is named by ``KEY_BITS`` of them, and in a bucket the same index compares the first 128 bits.

Null texts count as empty; a text without words has fingerprint 0 and links like any other. A text with fewer words than
a shingle is one shingle; texts of any length are read whole, some 65,536 shingles at a time. Rows, repeated ones too,
come out one for one. A row without an id gets a fingerprint, takes the component of the others with that fingerprint and
no part in links of its own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from .common import drop, fresh_name, list_array, ranges, release, small, small_batches, stored, table
from .components import components

SEED = 42
FANOUT = 8
GROUP_ROWS = 65_536
#: Pairs of fingerprints that a search looks at together, at most.
PAIRS = 20_000_000
#: Bits of a long fingerprint, the buckets that it is dealt to, and the bits of it that name one.
WIDE, TABLES, KEY_BITS = 512, 64, 24
#: How many rows of a component a round settles at first and at most, and the text that a part of it holds.
HEADS, MOST_HEADS, PART_BYTES = 32, 256, 2_000_000
#: What tells the words of a long fingerprint apart.
STEPS, MIX = np.arange(WIDE // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of the text's word shingles, in lower case A-Z, in turn; nothing for a text without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(found))
    digest = xxhash.xxh64_intdigest
    n = len(found) - k + 1
    for at in range(0, n, 65_536):
        some = zip(starts[at : min(n, at + 65_536)].tolist(), ends[at + k - 1 : at + 65_536 + k - 1].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in some], np.uint64)


def majority(text: str | None, shingle: int, width: int = 64) -> np.ndarray:
    """The fingerprint as numbers of 64 bits: the first from the shingles' hashes, the others from what is mixed of them."""
    total, n = np.zeros(width, np.int64), 0
    for some in hashes(text, shingle):
        mixed = np.empty((len(some), width // 64), "<u8")
        for i in range(width // 64):
            x = some + STEPS[i]
            mixed[:, i] = some if not i else (x ^ x >> np.uint64(31)) * MIX
        for at in range(0, len(some), 255 * 64):  # bytes hold sums of 255 ones
            bits = np.unpackbits(mixed[at : at + 255 * 64].view(np.uint8), axis=1, bitorder="little")
            for k in range(0, len(bits), 255):
                total += bits[k : k + 255].sum(0, dtype=np.uint8)
        n += len(some)
    return np.packbits(total * 2 > n, bitorder="little").view("<i8")


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3, drop_text: bool = False) -> DataFrame:
    """``df`` with ``out``; a column of that name is replaced."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != out and not (drop_text and c == text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([majority(x.as_py(), shingle)[0] for x in batch.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), bits], names=[*kept, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.LongType())]))


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the sequence of Gray codes."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Indexes over many groups at once. ``bits``, a row of 64-bit numbers for each entry, are in order of group, then
    Gray rank; ``group`` counts up from 0."""

    def __init__(self, bits: np.ndarray, group: np.ndarray, distance: int, fanout: int = FANOUT):
        self.distance = distance
        self.levels = []  # from the entries up: patterns, shared bits, first child, number of children, first entry, loose bits
        every, some, owner = bits, bits, group
        first, count, entry = np.arange(len(bits)), np.ones(len(bits), np.int64), np.arange(len(bits))
        tied = np.zeros(len(bits), bool)  # to the entry before, in one node whose entries are all within the distance
        while True:
            shared = ~(every ^ some)
            loose = np.bitwise_count(~shared).sum(1, dtype=np.int64)
            self.levels.append((every, shared, first, count, entry, loose))
            narrow = np.flatnonzero(loose <= distance)
            ends = np.append(entry[1:], len(bits))
            tied[ranges(entry[narrow] + 1, ends[narrow] - entry[narrow] - 1)] = True
            sizes = np.bincount(owner)
            if sizes.max(initial=0) <= 1:
                break
            place = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
            first = np.flatnonzero(place % fanout == 0)
            count = np.diff(np.append(first, len(owner)))
            entry = entry[first]
            every, some, owner = np.bitwise_and.reduceat(every, first), np.bitwise_or.reduceat(some, first), owner[first]
        self.tied = np.flatnonzero(tied)
        self.roots = np.full(int(group[-1]) + 1 if len(group) else 0, -1)
        self.roots[owner] = np.arange(len(owner))

    def search(self, queries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query's number and an entry's number, within the distance and of the same group. Of a node that is
        within it as a whole the first entry is told; the others are ``tied`` to it."""
        every, shared, *_ = self.levels[-1]
        q = np.arange(len(group))
        node = self.roots[group]
        differ = np.bitwise_count((queries[q] ^ every[node]) & shared[node]).sum(1, dtype=np.int64)
        found = [], []
        for depth in range(len(self.levels) - 1, -1, -1):
            _, above, first, count, entry, loose = self.levels[depth]
            whole = differ + loose[node] <= self.distance
            found[0].append(q[whole])
            found[1].append(entry[node[whole]])
            ok = ~whole & (differ <= self.distance)
            q, node, differ = q[ok], node[ok], differ[ok]
            if not depth or not len(q):
                break
            below, settled, *_ = self.levels[depth - 1]
            child = ranges(first[node], count[node])
            parent, q, differ = np.repeat(node, count[node]), np.repeat(q, count[node]), np.repeat(differ, count[node])
            # Only the bits that the node above didn't settle.
            differ = differ + np.bitwise_count((queries[q] ^ below[child]) & settled[child] & ~above[parent]).sum(1, dtype=np.int64)
            node = child
        return np.concatenate(found[0]), np.concatenate(found[1])


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, by which each node leads to the least one of its component so far, after the links a-b."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _in_order(bits: np.ndarray, number: np.ndarray) -> np.ndarray:
    return np.lexsort((*(gray_rank(bits[:, i]) for i in range(bits.shape[1] - 1, -1, -1)), number))


def _blocks(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of queries that each look at no more than so many pairs, or are one query."""
    at, upto = 0, np.cumsum(cost)
    while at < len(cost):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        yield at, end
        at = end


def links(dealt: DataFrame, words: list[str], distance: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``a``, ``b`` that join the ids of all fingerprints within ``distance`` bits of each other in one bucket.

    ``dealt`` has ``tab`` and ``bits``, which name a bucket, ``id``, and the columns ``words`` of the fingerprint.
    """
    kind = dealt.schema["id"].dataType
    out = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    # Buckets too large for one task; partial counts are made before they are shuffled.
    large = dealt.groupBy("tab", "bits").count().where(F.col("count") > group_rows)
    large = stored(large.select("tab", "bits", F.ceil(F.col("count") / group_rows).cast("int").alias("parts")), "large")

    def columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
        return [rows.column(c).to_numpy() for c in names]

    def patterns(rows: pa.Table) -> np.ndarray:
        return np.stack(columns(rows, *words), axis=1).view(np.uint64)

    def told(label: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], names=["a", "b"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            if rest.num_rows < group_rows:
                continue
            tab, bits = columns(rest, "tab", "bits")
            begins = int(np.argmax((tab == tab[-1]) & (bits == bits[-1])))  # the last bucket may go on in the next batch
            if begins:
                yield joined(rest.slice(0, begins))
                rest = rest.slice(begins)
        if rest is not None:
            yield joined(rest)

    def joined(rows: pa.Table) -> pa.RecordBatch:
        tab, bucket, ids = columns(rows, "tab", "bits", "id")
        bits = patterns(rows)
        number = np.cumsum(np.concatenate([[False], (tab[1:] != tab[:-1]) | (bucket[1:] != bucket[:-1])]))
        some = np.bincount(number)[number] > 1
        bits, ids, number = bits[some], ids[some], np.unique(number[some], return_inverse=True)[1]
        order = _in_order(bits, number)
        bits, ids, number = bits[order], ids[order], number[order]
        label = np.arange(len(bits))
        if len(bits):
            index = GrayIndex(bits, number, distance)
            label = forest(label, index.tied, index.tied - 1)
            for a, b in _blocks(np.bincount(number)[number]):
                q, e = index.search(bits[a:b], number[a:b])
                label = forest(label, q + a, e)
        return told(label, ids)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each part the entries come first, then all fingerprints of the bucket."""
        part, own, index = None, [], None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            keys = columns(rows, "tab", "bits", "part", "asks")
            cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), rows.num_rows]):
                *name, asks = (k[a] for k in keys)
                if name != part:
                    part, own, index = name, [], None
                if not asks:
                    own.append(rows.slice(a, b - a))
                    continue
                if index is None:
                    held = pa.concat_tables(own)
                    bits, ids = patterns(held), held.column("id").to_numpy()
                    order = _in_order(bits, np.zeros(len(bits), np.int64))
                    ids = ids[order]
                    index = GrayIndex(bits[order], np.zeros(len(bits), np.int64), distance)
                    yield told(forest(np.arange(len(ids)), index.tied, index.tied - 1), ids)
                some = rows.slice(a, b - a)
                asking, both = patterns(some), np.concatenate([ids, some.column("id").to_numpy()])
                label = np.arange(len(both))
                for x, y in _blocks(np.full(len(asking), len(ids))):
                    q, e = index.search(asking[x:y], np.zeros(y - x, np.int64))
                    label = forest(label, q + x + len(ids), e)
                yield told(label, both)

    if large.isEmpty():
        drop(large)
        return dealt.repartition("tab", "bits").sortWithinPartitions("tab", "bits").mapInArrow(whole, out)
    small = dealt.join(large, ["tab", "bits"], "left_anti").repartition("tab", "bits").sortWithinPartitions("tab", "bits").mapInArrow(whole, out)
    split = dealt.join(large, ["tab", "bits"])
    home = F.pmod(F.xxhash64(*words, "id"), F.col("parts")).cast("int")
    entries = split.withColumns({"part": home, "asks": F.lit(0)})
    asking = split.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "asks": F.lit(1)})
    both = entries.unionByName(asking).drop("parts").repartition("tab", "bits", "part").sortWithinPartitions("tab", "bits", "part", "asks")
    return small.unionByName(both.mapInArrow(streamed, out))


def blocks(entries: DataFrame, distance: int, agree: int = 1) -> DataFrame:
    """Deals each row ``fingerprint``, ``id`` once for each choice of ``agree`` of ``distance + agree`` blocks of bits:
    fingerprints within the distance share one choice at least."""
    n = distance + agree
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in some) for some in combinations(range(n), agree)]
    keys = F.array(*(F.col("fingerprint").bitwiseAND(m - (1 << 64) if m >> 63 else m) for m in masks))
    return entries.select("fingerprint", "id", F.posexplode(keys).alias("tab", "bits"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2, agree: int = 1) -> DataFrame:
    """``key``, ``fingerprint`` and ``component_id``, the least key that a row's fingerprint reaches over links."""
    marked = stored(fingerprints(df.select(F.col(key).alias(key), F.col(text).alias("text")), shingle=shingle, drop_text=True), "fingerprints")
    entries = marked.groupBy("fingerprint").agg(F.min(key).alias("id"))
    found = components(links(blocks(entries.where(F.col("id").isNotNull()), distance, agree), ["fingerprint"], distance))
    labels = entries.join(found, entries["id"] == found["node"], "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return marked.join(stored(labels, "labels"), "fingerprint", "left").select(key, "fingerprint", "component_id")


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, in order."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes(text, shingle)]))


def similar(left: np.ndarray, right: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``least`` or more; that of two empty ones is 1."""
    small, large = sorted((left, right), key=len)
    if len(small) < least * len(large):
        return False
    if not len(small):
        return True  # both are empty
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= least * (len(small) + len(large) - both)


def _wide(texts: DataFrame, shingle: int) -> DataFrame:
    """``digest``, two words ``fingerprint`` and ``more`` of the long fingerprint, and ``keys``, the bits that name its
    buckets."""
    small_batches(texts.sparkSession)
    places = np.stack([np.random.default_rng([SEED, t]).choice(WIDE, KEY_BITS, replace=False) for t in range(TABLES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array([majority(x.as_py(), shingle, WIDE) for x in batch.column("text")], "<i8").reshape(-1, WIDE // 64)
            bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
            keys = (bits[:, places].astype(np.int32) << np.arange(KEY_BITS, dtype=np.int32)).sum(2, dtype=np.int32)
            lists = list_array(keys.ravel(), np.arange(len(words) + 1) * TABLES, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(words[:, 0]), pa.array(words[:, 1]), lists], names=["digest", "fingerprint", "more", "keys"])

    return texts.select("digest", "text").mapInArrow(run, "digest binary, fingerprint long, more long, keys array<int>")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, distance: int = 26) -> DataFrame:
    """``df`` without near-duplicates. Of equal texts the row with the least key stays, whatever else the rows hold; rows
    without a key come last, and of equal keys any one is the least. The texts left that long fingerprints of three-word
    shingles link, within ``distance`` of 128 bits, are then taken in that order by component, and one stays unless its
    ``shingle``-word shingles are ``least`` similar or more to those of one that stays.

    Rows are told apart by their texts, as SHA-256, and keys together, so rows that share an id or have none stay or go
    each for itself, and of rows that repeat both one stays. Null and empty texts are equal. An empty table gives no rows,
    and columns of any name are kept. Each round settles the first ``HEADS`` of each component, or more in later rounds,
    and what is near to those that stay; a component with many rows is dealt in parts, each with these heads."""
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    rows = df.select(sha.alias("digest"), F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col(text).alias("text"))
    places = stored(rows.groupBy("digest", "none", "k").agg(F.count("*").alias("n")), "places")
    firsts = places.groupBy("digest").agg(F.min(F.struct("none", "k", "n")).alias("first")).select("digest", "first.*")
    firsts = stored(firsts.withColumn("id", F.monotonically_increasing_id()), "firsts")
    # Copies have their fingerprints made again, which costs less than to bring the texts together.
    wide = stored(_wide(rows, 3), "fingerprints")
    entries = wide.join(firsts.select("digest", "id"), "digest").dropDuplicates(["id"])
    dealt = entries.select("id", "fingerprint", "more", F.posexplode("keys").alias("tab", "bits"))
    found = components(links(dealt, ["fingerprint", "more"], distance)).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
    members = stored(firsts.drop("n").join(found, "id"), "members")
    drop(wide)
    release(df.sparkSession)
    texts = rows.select("digest", "text").join(small(members.select("digest", "id"), F.lit(48)), "digest").groupBy("id").agg(F.first("text").alias("text"))
    left = stored(texts.join(members, "id"), "left")
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("near", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, []
        for batch in batches:
            ids, near = [], []
            fields = [batch.column(c).to_pylist() for c in ("component_id", "part", "head", "id")]
            for i, (component, part, head, number) in enumerate(zip(*fields)):
                if group != (component, part):
                    group, kept = (component, part), []
                own = shingles(batch.column("text")[i].as_py(), shingle)
                gone = any(similar(own, other, least) for other in kept)
                if head and not gone:
                    kept.append(own)
                if gone and not head or head and part == 0:
                    ids.append(number)
                    near.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.bool_())], names=kind.names)

    heads, near = HEADS, None
    while True:
        size = F.greatest(F.count("*") / (8 * heads), F.sum(F.octet_length(F.coalesce("text", F.lit("")))) / PART_BYTES)
        # A row that is alone has been held against all that stay.
        sizes = stored(left.groupBy("component_id").agg(F.count("*").alias("n"), F.ceil(size).cast("int").alias("parts")).where("n > 1"), "sizes")
        first = Window.partitionBy("component_id").orderBy("none", "k", "id")
        ahead = left.select("component_id", "none", "k", "id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= heads).select("id", F.lit(True).alias("head"))
        dealt = left.join(sizes.drop("n"), "component_id").join(stored(ahead, "ahead"), "id", "left").withColumn("head", F.coalesce("head", F.lit(False)))
        part = F.when(F.col("head"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
        dealt = dealt.withColumn("part", F.explode(part)).select("component_id", "part", "head", "none", "k", "id", "text")
        dealt = dealt.repartition("component_id", "part").sortWithinPartitions("component_id", "part", F.col("head").desc(), "none", "k", "id")
        settled = stored(dealt.mapInArrow(run, kind), "settled")
        gone = settled.where("near").select("id")
        near = gone if near is None else near.unionByName(gone)
        release(df.sparkSession)
        large = sizes.where(F.col("n") > heads + 1).select("component_id")
        if large.isEmpty():
            break
        before, left = left, stored(left.join(large, "component_id", "left_semi").join(settled.select("id"), "id", "left_anti"), "left")
        drop(before)
        heads = min(2 * heads, MOST_HEADS)
    drop(left)
    near = stored(firsts.join(near, "id").select("digest", F.lit(True).alias("near")), "near")
    first = firsts.select("digest", F.col("none").alias("none_"), F.col("k").alias("k_"), F.col("n").alias("n_"))
    fates = stored(places.join(first, "digest").join(near, "digest", "left"), "fates")
    stays = (F.col("none") == F.col("none_")) & F.col("k").eqNullSafe(F.col("k_")) & F.col("near").isNull()
    named = {c: fresh_name(df, c) for c in ("digest", "k")}
    own = lambda where: fates.where(where).select(F.col("digest").alias(named["digest"]), F.col("k").alias(named["k"]))
    gone, tied = stored(own(~stays), "gone"), stored(own(stays & (F.col("n") > 1)), "tied")
    drop(places, firsts, near, fates)
    release(df.sparkSession)
    same = lambda some: (sha == some[named["digest"]]) & F.col(key).eqNullSafe(some[named["k"]])
    gone = small(gone, F.lit(64))
    out = df.join(gone, same(gone), "left_anti")
    if tied.isEmpty():
        return out
    # Of rows with one text and one key, any one.
    tied = small(tied, F.lit(64))
    repeated = df.join(tied, same(tied), "left_semi").withColumn(named["digest"], sha).dropDuplicates([named["digest"]])
    return out.join(tied, same(tied), "left_anti").unionByName(repeated.select(df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
