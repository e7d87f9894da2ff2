"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most r bits have a common neighbour within r/2 bits of
both. Every distinct fingerprint therefore emits all its variants within half the radius; the
variants are the shuffle keys, and fingerprints that meet on one are verified."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import by_batch, discard, stored, text_slices
from cellweave.llm.components import components
from cellweave.llm.wordhash import MIX_1, MIX_2, mixed, run_hashes, words_of
from cellweave.runtime import counted_broadcast

BITS = 64
SEED = 42
CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, joined by blanks; fewer words make one run."""
    if len(words) < size:
        runs, n = [b" ".join(words)], 1
    else:
        runs, n = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)), len(words) - size + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, n)


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    """The SimHash of a text as an unsigned number; 0 if it has no words.

    Words are cut by ASCII white space after lower-casing A-Z; their shingles are counted bit
    by bit in chunks, so that a very long text needs no long lists of shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    ones, total = np.zeros(BITS, np.int64), 0
    for begin in range(0, max(1, len(words) - size + 1), CHUNK):
        hashes = shingle_hashes(words[begin : begin + CHUNK + size - 1], size, seed)
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """``id_col, fp``: the fingerprint of each row's whole text as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(by_batch(run), f"id {kind}, fp bigint")


def ball(value: Column, radius: int) -> Column:
    """All numbers that differ from ``value`` in at most ``radius`` bits."""
    masks = [
        sum(1 << bit for bit in bits)
        for n in range(radius + 1)
        for bits in combinations(range(BITS), n)
    ]
    signed = [mask - (1 << BITS) if mask >> (BITS - 1) else mask for mask in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda mask: value.bitwiseXOR(mask))


def ball_links(fps: DataFrame, radius: int) -> DataFrame:
    """``fp, other``: verified links between the distinct fingerprints of ``fps`` that connect
    exactly those within ``radius`` bits.

    A variant is the key of at most 1 + 64 + ... fingerprints, a bound that does not grow with
    the data, and distinct fingerprints leave no hot key. For an even radius all that meet on
    a variant are linked to each other, so each is linked to the least of them; for an odd one
    every pair is verified by itself."""
    half = (radius + 1) // 2
    met = fps.select("fp", F.explode(ball(F.col("fp"), half)).alias("variant"))
    if radius % 2 == 0:
        least = F.min("fp").over(Window.partitionBy("variant"))
        pairs = met.select("fp", least.alias("other")).where("fp != other")
    else:
        bucket = met.groupBy("variant").agg(F.sort_array(F.collect_set("fp")).alias("bucket"))
        pairs = bucket.where(F.size("bucket") > 1).select(
            F.posexplode("bucket").alias("at", "other"), "bucket"
        ).select(F.explode(F.slice("bucket", F.col("at") + 2, F.size("bucket"))).alias("fp"), "other")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    return pairs.distinct().where(near)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, size: int = 3
) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the least id reachable over links of
    at most ``radius`` differing bits, the row's own included. Rows with the same fingerprint
    are one class before anything is linked, however many they are. A null or empty text has
    fingerprint zero and is linked like any other; a row with a null id gets a component but
    never names one (null if nothing else is in it); repeated rows come back as often as they
    are there; other columns are not read; an empty table gives an empty result."""
    prints = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(ball_links(classes.select("fp"), radius), "fp", "other")
    joined = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = joined.join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


#: Bands of least hashes that find candidates, and least hashes in each.
BANDS, DEPTH = 25, 5
#: Bits in which the sketches of two sets may differ before they are held to be unlike: one bit for each
#: least hash. Sets of similarity 0.8 differ in 12.5 of the 125, and in more than 31 with
#: probability 10^-6.
SKETCH_BITS = 31
def band_keys(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of each text for each band, and in two rows more its sketch: texts whose sets have
    Jaccard similarity s share a key with probability s ** DEPTH, and a bit of the sketch with
    probability (1 + s) / 2. ``hashes`` are the sets of all texts, ``first`` where each begins
    among them (one entry more than texts); empty sets have zeros."""
    keys = np.zeros((BANDS + 2, len(first) - 1), np.uint64)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return keys
    seeds = mixed(np.arange(1, 2 * BANDS * DEPTH + 1, dtype=np.uint64) * np.uint64(MIX_1))
    masks, factors = seeds.reshape(2, BANDS, DEPTH)
    for band in range(BANDS):
        key = np.full(len(full), band, np.uint64)
        for mask, factor in zip(masks[band], factors[band] | np.uint64(1), strict=True):
            least = np.minimum.reduceat((hashes ^ mask) * factor, first[:-1][full])
            key = mixed(key * np.uint64(MIX_2) + least)
            sketch = BANDS + band % 2
            keys[sketch, full] = (keys[sketch, full] << np.uint64(1)) | (least >> np.uint64(9) & np.uint64(1))
        keys[band, full] = key
    return keys


def shingle_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of shingles of ``size`` words of all texts in one row, and where each begins
    in it; a shorter text is one shingle, a text without words has none."""
    words = words_of([(text or "").encode().lower() for text in texts])
    counts = np.diff(words.text_at)
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(shingles)])
    owner = np.repeat(np.arange(len(texts)), shingles)
    at = np.arange(first[-1]) - first[owner] + words.text_at[owner]
    runs = run_hashes(words.sums, words.down, at, np.minimum(at + size, words.text_at[owner + 1]))
    sets = [np.unique(runs[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def digested(sets: np.ndarray, first: np.ndarray) -> pa.Array:
    """A digest of each set."""
    octets = sets.astype("<u8")
    return pa.array([xxhash.xxh3_128_digest(octets[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())


def set_prints(docs: DataFrame, size: int) -> DataFrame:
    """``id, node, size, k0.., s0, s1, fp``: digest and size of the set of shingles of each of
    ``docs(id, text)``, its keys and its sketch, and the text's SimHash."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sizes, keys = [], [], []
        for _, _, texts in text_slices(batch.column(1), SLICE_BYTES):
            sets, first = shingle_sets(texts, size)
            nodes.append(digested(sets, first))
            sizes.append(np.diff(first))
            keys.append(np.vstack([band_keys(sets, first), np.array([fingerprint(t) for t in texts], np.uint64)]))
        rows = np.concatenate(keys, axis=1).view(np.int64)
        columns = [batch.column(0), pa.concat_arrays(nodes), pa.array(np.concatenate(sizes)), *map(pa.array, rows)]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "node", "size", *(f"k{i}" for i in range(BANDS)), "s0", "s1", "fp"]
    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        by_batch(run), f"id {kind}, node binary, " + ", ".join(f"{name} bigint" for name in names[2:])
    )


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``node, shingles``: digest and set of shingles of each of ``docs(text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, lists = [], []
        for _, _, texts in text_slices(batch.column(0), SLICE_BYTES):
            sets, first = shingle_sets(texts, size)
            nodes.append(digested(sets, first))
            lists.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(sets.view(np.int64))))
        columns = [pa.concat_arrays(nodes), pa.concat_arrays(lists)]
        return pa.RecordBatch.from_arrays(columns, ["node", "shingles"])

    return docs.mapInArrow(by_batch(run), "node binary, shingles array<bigint>")


#: Text whose shingles are in memory at a time; a longer text alone.
SLICE_BYTES = 250_000
#: Buckets of up to so many members are compared pair by pair; larger ones by their hubs.
SMALL = 32
#: What the members of a bucket are compared for: links with each other, or of one kind with the other.
ALL, BESIDE, APART = 0, 1, 2


def open_buckets(members: DataFrame, *picked: Column) -> DataFrame:
    """``key`` of the buckets of ``members(key, node, root, kind)`` that may still hold a link: whose
    members are in several components, and of both kinds if they have kinds."""
    spread = members.groupBy("key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.min("kind").alias("low_kind"), F.max("kind").alias("high_kind"), *picked,
    )
    return spread.where((F.col("low") != F.col("high")) & ((F.col("high_kind") == ALL) | (F.col("low_kind") != F.col("high_kind"))))


def at_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the root of each node, itself if it has no link yet."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    known = roots.select(F.col("node").alias("at"), F.col("root").alias("at_root"))
    joined = members.join(known, F.col("node") == F.col("at"), "left")
    return joined.select(*members.columns, F.coalesce("at_root", "node").alias("root"))


def one_bucket_a_hub(members: DataFrame) -> DataFrame:
    """``members(key, node, size, degree, kind, ...)`` with all large buckets of one hub put together, so
    that a member is compared with that hub, and written as its difference from it, once.

    A hub that lies in another large bucket, as one edited copy among the others does, gives its
    bucket to the greatest hub that it meets there, which joins the bucket. Whatever met still does."""
    rows = [c for c in members.columns if c != "key"]
    whole = F.struct("degree", "node", *[c for c in rows if c not in ("degree", "node")])
    members = stored(members, "members")
    hubs = members.groupBy("key").agg(F.max(whole).alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL)
    hubs = stored(hubs.select("key", "hub"), "hubs")
    large = stored(members.join(hubs, "key"), "large")
    met = large.join(hubs.select(F.col("hub.node").alias("node")).distinct(), "node", "left_semi")
    above = stored(met.groupBy(F.col("node").alias("at")).agg(F.max("hub").alias("above")), "above")
    raised = large.join(above, F.col("hub.node") == F.col("at"))
    one = F.xxhash64(F.lit("hub"), "above.node").alias("key")
    together = raised.select(one, *rows).unionAll(raised.select(one, *[F.col(f"above.{c}") for c in rows]).distinct())
    small = members.join(hubs, "key", "left_anti").select("key", *rows)
    merged = stored(small.unionAll(together.dropDuplicates(["key", "node"])), "members")
    for table in (members, hubs, large, above):
        discard(table)
    return merged


def bucket_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, root`` of the components of all links of ``similarity`` or more inside the buckets of
    ``members(key, node, size)``, for every node that has one.

    Large buckets of one hub are put together first. In each round the members of small buckets are compared with each other, which is at most
    ``SMALL`` comparisons a member. In a large one the hub, the member that meets most others (of
    copies that is mostly the original), is compared with all others and leaves it. If the rest
    is in one component the bucket is done; what is left of the others is dealt out anew by
    ``refined``, in such a way that two members that may be alike meet again. So no two nodes of
    a bucket end apart unless they have been compared or cannot be alike."""
    sketch = [c for c in ("s0", "s1") if c in members.columns]
    met = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degrees = members.join(met, "key").groupBy("node").agg(F.sum("n").alias("degree"))
    members = one_bucket_a_hub(members.join(degrees, "node").select("key", "node", "size", *sketch, "degree", F.lit(ALL).alias("kind")))

    def fits(other: str) -> Column:
        """Whether a member and ``other`` have different roots and may be alike, by the ratio of sizes
        alone (without rounding a similarity that is met exactly) and by their sketches."""
        may = F.least("size", f"{other}.size") >= similarity * F.greatest("size", f"{other}.size") - 1e-9
        for c in sketch[:1]:
            bits = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{other}.{c}"))) for c in sketch)
            may &= bits <= SKETCH_BITS
        return may & (F.col("root") != F.col(f"{other}.root"))

    picked = ["node", "size", "root", *sketch]
    hub = F.max(F.struct("degree", *picked)).alias("hub")
    other = F.struct(*picked, "kind")
    roots = None
    while True:
        placed = stored(at_roots(members, roots), "members")
        hubs = stored(open_buckets(placed, hub, F.count(F.lit(1)).alias("n")).select("key", "hub", "n"), "hubs")
        if hubs.isEmpty():
            break
        rest = stored(placed.join(hubs.where(F.col("n") > SMALL), "key").where(F.col("node") != F.col("hub.node")), "rest")
        small = stored(placed.join(hubs.where(F.col("n") <= SMALL).select("key"), "key", "left_semi"), "small")
        apart = (F.col("node") < F.col("other.node")) & ((F.col("kind") == ALL) | (F.col("kind") != F.col("other.kind")))
        beside = small.select("key", other.alias("other"))
        pairs = rest.where(fits("hub")).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).unionAll(
            small.join(beside, "key").where(apart & fits("other")).select(F.col("node").alias("a"), F.col("other.node").alias("b"))
        )
        pairs = stored(pairs.distinct(), "pairs")
        found = similar_pairs(pairs, sets, similarity)
        stars = found if roots is None else found.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        fresh = stored(components(stars, "a", "b"), "components")
        lists, certain = refined(rest, fresh, sets, similarity)
        if not certain.isEmpty():
            before, stars = fresh, certain.unionAll(fresh.select(F.col("node").alias("a"), F.col("root").alias("b")))
            fresh = stored(components(stars, "a", "b"), "components")
            discard(before)
        for table in (members, placed, hubs, rest, small, pairs, certain, *([] if roots is None else [roots])):
            discard(table)
        members, roots = lists, fresh
    none = members.limit(0).select("node", F.col("node").alias("root"))
    return none if roots is None else roots


def sets_at(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``sets`` that belong to ``nodes``, a table of one column: if they are few, no others are
    shuffled."""
    return sets.join(counted_broadcast(nodes.toDF("node").distinct()), "node", "left_semi")


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a Jaccard similarity of ``similarity`` or more."""
    own = sets_at(sets, pairs.select("a")).select(F.col("node").alias("a"), F.col("shingles").alias("own"))
    other = sets_at(sets, pairs.select("b")).select(F.col("node").alias("b"), F.col("shingles").alias("other"))
    common = F.size(F.array_intersect("own", "other"))
    total = F.size("own") + F.size("other") - common
    return pairs.join(own, "a").join(other, "b").where(common >= similarity * total - 1e-9).select("a", "b")


def refined(rest: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """New buckets for the members ``rest(key, node, hub, ...)`` of buckets without their hub, and links
    ``a, b`` that are certain.

    Every member is written as its difference from the centre, the set of what more than half of the members
    of a hub have: the elements that it adds and those that it lacks. (A hub that is an edited copy itself
    would make all others differ from it in the same elements.) The distance of two members is that of
    their differences: with t = (1 - s) / (1 + s), sets x and y have similarity s or more just if their
    differences are at most t |x| + t |y| apart. With slack = |a| + |l| - t |x|, two are alike for
    certain if slack_x + slack_y is not above zero. Then both are alike to the one of the least slack, a
    member or the hub, so all such links are those with that one. The members of its component need no more links
    with each other; the others are apart. Bounds on what a member that is apart must share with any, and any
    with one that is apart, take the least of its possible partners, and there are two:

    Two members have (slack_x + slack_y) / 2 elements of their differences in common or more, and as no
    partner shares what y has alone, also slack_x + slack_y - (elements of y that others have too).
    Of the elements of x, the rarest first, the first |a| + |l| - that + 1 therefore hold one that it
    shares with any partner.

    What x and y lack differs by | |lx| - |ly| | or more, so with low = |a| - |l| - t |x| they have
    (slack_x + low_y) / 2 added elements in common or more, and likewise slack_x + alone_y. So they
    meet on the first of their added elements alone, of which few others have one, while each element of
    the centre is lacked by many if there are many copies. Only two members of which the bounds allow that they
    add nothing in common, because one lacks more than it adds, may have to meet on what both lack.

    Either way gives new buckets, one list for members that are apart with each other and one for those
    of the component with them; each hub takes the way whose buckets are expected to hold less."""
    t = (1 - similarity) / (1 + similarity)
    sketch = [c for c in ("s0", "s1") if c in rest.columns]
    rest = at_roots(rest.drop("root"), roots)
    still = rest.join(open_buckets(rest).select("key"), "key", "left_semi")
    asked = stored(still.select(F.col("hub.node").alias("hub"), "node", "root", "size", *sketch, "degree").distinct(), "asked")
    own = sets_at(sets, asked.select("node")).select("node", F.col("shingles").alias("own"))
    other = sets_at(sets, asked.select("hub")).select(F.col("node").alias("hub"), F.col("shingles").alias("other"))
    differences = stored(asked.join(own, "node").join(other, "hub").select(
        "hub", "node", "root", "size", *sketch, "degree",
        F.array_except("own", "other").alias("added"), F.array_except("other", "own").alias("lacked"),
        F.size("other").alias("hub_size"),
    ), "differences")

    def elements(table: DataFrame) -> DataFrame:
        both = F.concat(
            F.transform("added", lambda e: F.struct(e.alias("element"), F.lit(True).alias("adds"))),
            F.transform("lacked", lambda e: F.struct(e.alias("element"), F.lit(False).alias("adds"))),
        )
        return table.select("hub", "node", F.explode(both).alias("at")).select("hub", "node", "at.*")

    members = stored(differences.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.max("hub_size").alias("hub_size")), "hubs")
    counts = elements(differences).groupBy("hub", "element").agg(F.count(F.lit(1)).alias("n"), F.max("adds").alias("adds")).where("n > 1")
    counts = stored(counts.join(members.drop("hub_size"), "hub").withColumn("usual", F.col("n") * 2 > F.col("members")), "elements")
    usual = stored(counts.where("usual").groupBy("hub").agg(
        *[F.collect_list(F.when(of, F.col("element"))).alias(name) for of, name in ((F.col("adds"), "all_add"), (~F.col("adds"), "all_lack"))]
    ), "usual")

    def moved(own: str, usual: str, other: str, other_usual: str) -> Column:
        """Differences from the hub as differences from the centre."""
        from_centre = F.concat(F.array_except(own, usual), F.array_except(other_usual, other))
        return F.when(F.col(usual).isNull(), F.col(own)).otherwise(from_centre).alias(own)

    centred = stored(differences.join(usual, "hub", "left").select(
        "hub", "node", "root", "size", *sketch, "degree",
        moved("added", "all_add", "lacked", "all_lack"), moved("lacked", "all_lack", "added", "all_add"),
    ).withColumns({
        "slack": F.size("added") + F.size("lacked") - t * F.col("size"),
        "low": F.size("added") - F.size("lacked") - t * F.col("size"),
    }), "centred")
    aside = F.coalesce(F.size("all_add") + F.size("all_lack"), F.lit(0)) - t * F.col("hub_size")
    hubs = at_roots(members.join(usual, "hub", "left").select("hub", F.col("hub").alias("node"), aside.alias("slack")), roots)
    nearest = stored(centred.select(*hubs.columns).unionAll(hubs).groupBy("hub").agg(F.min(F.struct("slack", "node", "root")).alias("nearest")), "nearest")
    certain = (F.col("slack") + F.col("nearest.slack") <= 1e-9) & (F.col("node") != F.col("nearest.node"))
    beside = F.col("root") == F.col("nearest.root")
    placed = centred.join(nearest, "hub")
    links = stored(placed.where(certain & ~beside).select(F.col("node").alias("a"), F.col("nearest.node").alias("b")), "certain")
    known = counts.select("hub", "element", F.when(F.col("usual"), F.col("members") - F.col("n")).otherwise(F.col("n")).alias("n"))
    place = F.struct("n", "element")
    shared = elements(centred).join(known.where("n > 1"), ["hub", "element"]).groupBy("hub", "node").agg(
        *[F.sort_array(F.collect_list(F.when(of, place))).alias(name) for of, name in ((F.col("adds"), "added"), (~F.col("adds"), "lacked"))]
    ).withColumn("any", F.sort_array(F.concat("added", "lacked")))
    # What a member has alone adds to its distance from any other.
    ready = stored(placed.withColumn("apart", ~(certain | beside)).drop("added", "lacked", "root", "nearest").join(shared, ["hub", "node"]).withColumns({
        "slack_alone": F.col("slack") - F.size("any"),
        "slack_lacked": F.col("slack") - F.size("lacked"),
        "low_alone": F.col("low") - F.size("added"),
    }), "shared")
    bounds = ("slack", "low", "slack_alone", "slack_lacked", "low_alone")
    least = stored(ready.groupBy("hub").agg(
        *[F.min(F.when(F.col("apart") == apart, F.col(c))).alias(f"{c}_{name}") for apart, name in ((True, "apart"), (False, "beside")) for c in bounds]
    ), "least")

    def sums(partners: str, bound: str) -> Column:
        """The slack of a member and the least ``bound`` of its partners, or the other way."""
        return F.greatest(F.col("slack") + F.col(f"{bound}_{partners}"), F.col(f"slack_{partners}") + F.col(bound))

    def first(column: str, half: Column, whole: Column, where: Column, kind: int, lists: int) -> Column:
        """Buckets of the first elements of ``column``, with which so many are in common."""
        common = F.greatest(F.ceil(half / 2 - 1e-9), F.ceil(whole - 1e-9), F.lit(1))
        length = F.when(where, F.greatest(F.size(column) - common + 1, F.lit(0))).otherwise(0).cast("int")
        return F.transform(F.slice(column, F.lit(1), length), lambda e: F.struct(
            F.xxhash64("hub", e["element"], F.lit(lists)).alias("key"), F.lit(kind).alias("kind"), e["n"].alias("n")
        ))

    def by_any(partners: str, kind: int, lists: int) -> Column:
        some = F.col(f"slack_{partners}").isNotNull()
        return first("any", sums(partners, "slack"), sums(partners, "slack_alone"), some, kind, lists)

    def by_added(partners: str, kind: int, lists: int) -> Column:
        some, half, whole = F.col(f"slack_{partners}").isNotNull(), sums(partners, "low"), sums(partners, "low_alone")
        none = some & (half <= 1e-6) & (whole <= 1e-6)
        lacked = first("lacked", sums(partners, "slack"), sums(partners, "slack_lacked"), none, kind, lists)
        return F.concat(first("added", half, whole, some, kind, lists), lacked)

    def dealt(way: Callable[[str, int, int], Column]) -> Column:
        return F.when(F.col("apart"), F.concat(way("apart", ALL, 0), way("beside", APART, 1))).otherwise(way("apart", BESIDE, 1))

    met = ready.join(least, "hub").withColumns({"by_any": dealt(by_any), "by_added": dealt(by_added)})
    cost = [F.sum(F.aggregate(way, F.lit(0).cast("bigint"), lambda total, e: total + e["n"])).alias(f"cost_{way}") for way in ("by_any", "by_added")]
    costs = stored(met.groupBy("hub").agg(*cost), "costs")
    way = F.when(F.col("cost_by_added") < F.col("cost_by_any"), F.col("by_added")).otherwise(F.col("by_any"))
    lists = met.join(costs, "hub").select(F.explode(way).alias("in"), "node", "size", *sketch, "degree")
    buckets = stored(lists.select("in.key", "node", "size", *sketch, "degree", "in.kind"), "lists")
    for table in (asked, differences, members, counts, usual, centred, nearest, ready, least, costs):
        discard(table)
    return buckets, links


def ball_buckets(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``node, key``: one bucket for each component of the links of at most ``radius`` bits between the
    SimHashes of ``prints(node, fp)``, so that all texts which SimHash links meet."""
    owners = stored(prints.select("node", "fp").distinct(), "simhashes")
    roots = components(ball_links(owners.select("fp").distinct(), radius), "fp", "other")
    key = F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key")
    buckets = stored(owners.join(roots, owners.fp == roots.node, "left").select(owners.node, key).distinct(), "balls")
    discard(owners)
    return buckets


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, size: int = 5
) -> DataFrame:
    """``id_col, component_id`` for every row with an id: groups of texts whose sets of shingles of
    ``size`` words (but for case) have a Jaccard similarity of ``similarity`` or more.

    Texts with the same set are one class first. Candidates are the texts that SimHash links, by
    balls as in ``near_duplicates``, which holds few of the pairs at 0.8. For the others
    the least hashes of a set under several permutations are put together to keys; a pair of similarity 0.8 misses all of them with
    probability (1 - 0.8^5)^25, or 0.00005, whatever the length of the texts, and one of 0.85
    with 0.0000008; its sketches pass it over with 0.000001. What meets on a key is compared by the sets themselves, so every link is exact. Texts
    without words are one class; repeated rows get the same group; an empty table gives an
    empty result."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = stored(set_prints(rows, size), "fingerprints")
    bands = [f"k{i}" for i in range(BANDS)]
    classes = stored(
        prints.groupBy("node").agg(F.min("id").alias("rep"), *[F.max(c).alias(c) for c in ["size", "s0", "s1", *bands]]), "classes"
    )
    full = classes.where("size > 0")
    balls = ball_buckets(prints.where("size > 0"))
    keyed = full.select("node", F.explode(F.array(*bands)).alias("key")).unionAll(balls.select("node", "key"))
    shared = stored(keyed.groupBy("key").count().where("count > 1").select("key"), "keys")
    met = stored(keyed.join(shared, "key").select("key", "node"), "met")
    wanted = stored(met.select("node").distinct().join(full.select("node", "rep", "size", "s0", "s1"), "node"), "candidates")
    members = stored(met.join(wanted.drop("rep"), "node"), "members")
    texts = rows.join(counted_broadcast(wanted.select(F.col("rep").alias("id")).distinct()), "id", "left_semi").select("text")
    # Rows that share an id may hold other texts, and a class has one set.
    sets = sets_at(sets_of(texts, size), wanted.select("node")).dropDuplicates(["node"])
    sets = stored(sets, "sets")
    roots = bucket_links(members, sets, similarity)
    for table in (balls, shared, met, members, wanted, sets):
        discard(table)
    named = classes.select("node", "rep").join(roots.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(
        "node", "rep", F.coalesce("root", "node").alias("root")
    )
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "root").select("node", "component_id")
    return prints.select("id", "node").join(labels, "node").select(F.col("id").alias(id_col), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the row of the least id of every group of ``similar_groups``; of rows that share
    that id, one. Rows without an id belong to no group and stay."""
    groups = similar_groups(docs, id_col, text_col, **options)
    least = groups.where(F.col(id_col) == F.col("component_id")).select(id_col).distinct()
    kept = docs.join(least, id_col, "left_semi").dropDuplicates([id_col])
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
