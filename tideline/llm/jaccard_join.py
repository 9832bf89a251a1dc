"""N-gram Jaccard join: a size-aware join with a light and a heavy side, down to components of links.

Documents with equal sets are one class; only classes are joined, so copies cost nothing.  Light (small)
sets meet in shared subsets of just the size that a link needs.  Heavy ones scan the inverted lists of
their rarest elements, with bounds on sizes and positions.  The boundary between both is where the keys of
subsets begin to cost more than measured lists do.  Every link is verified on whole sets.

A list is never paired up.  Its most central member is its pivot, and each class is first compared with the
pivot that most of its lists have.  What links is contracted to components: a list whose members are all in
one has nothing left to find, and elsewhere only members of different components are paired, within the
bounds.  So a group of near copies costs about its length, while no link that could join two components is
left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_long, map_texts, slices
from tideline.llm.graph import components
from tideline.llm.scratch import Scratch
from tideline.llm.shingle_sets import BUCKETS, MOST_LIGHT, PARTS, STEPS, Bound, decimals, rarest, sets_of, short, signature, subset_keys

WIDTH = 3
NUM, DEN = 90, 100
#: Rows to fetch are broadcast up to this many (16 MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000
#: Of a small set every so many-th element, by its bits, tells how long lists are.
PROBE = 64
#: Sizes whose ratio is less share a step when members of a list meet.
SIZE_STEP = 1.05
#: Times that classes in too few lists, and then lists of one class, are taken out.
CORE_ROUNDS = 2
NODE = "decimal(38,0)"


def row_key(doc_id: str, text: str) -> Column:
    """A digest of id and text: rows are fetched by it, so that those without an id are found as well."""
    return F.xxhash64(F.col(doc_id).cast("bigint"), F.col(text))


def signed(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """Per row: doc_id, row (its key), n, node (its set's signature; null if empty), h (64 bits of it) and a probe of small sets.

    Further rows, those with a ``part``, hold how often elements fell into each bucket of that part (up to 255 a task).
    """
    names = ["doc_id", "row", "n", "node", "h", "probe", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.decimal128(38, 0), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, waiting = np.zeros(BUCKETS, np.int32), [], 0

        def add() -> None:
            nonlocal total, waiting
            if held:
                total += np.bincount(np.concatenate(held), minlength=BUCKETS).astype(np.int32)
                held.clear()
                waiting = 0

        for whole in batches:
            for batch in slices(whole):
                n, node, probe = [], [], []
                for s in sets_of(batch.column("text"), width):
                    n.append(len(s))
                    node.append(signature(s) if len(s) else None)
                    probe.append(as_long(s[s % np.uint64(PROBE) == 0]) if len(s) <= MOST_LIGHT else None)
                    held.append((s & np.uint64(BUCKETS - 1)).astype(np.int32))
                    waiting += len(s)
                    if waiting > 1 << 20:
                        add()
                k = batch.num_rows
                cols = [
                    batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int32()), decimals(node), pa.array([None if x is None else short(x) for x in node], pa.int64()),
                    pa.array(probe, types[5]), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)
        add()
        if total.any():
            # above 255 a bucket counts as that often: it is as late in the order as others are
            packed = [zlib.compress(x.tobytes(), 1) for x in np.split(np.minimum(total, 255).astype(np.uint8), PARTS)]
            cols = [pa.nulls(PARTS, t) for t in types[:6]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(range(PARTS), pa.int32()), pa.array(packed, pa.binary())], names)

    schema = f"doc_id bigint, row bigint, n int, node {NODE}, h bigint, probe array<bigint>, part int, counts binary"
    return map_texts(docs, run, schema, doc_id=F.col(doc_id).cast("bigint"), row=row_key(doc_id, text), text=F.col(text))


def rarity(rows: DataFrame) -> np.ndarray:
    """The level of each bucket, from the counts of all tasks; a fixed number of bytes comes to the driver."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(zlib.decompress(packed), np.uint8)
                held[part] = held[part] + x if part in held else x.astype(np.int64)
        out = [np.rint(STEPS * np.log2(1.0 + x)).astype(np.uint16).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array([*held], pa.int32()), pa.array(out, pa.binary())], ["part", "levels"])

    levels = np.zeros((PARTS, BUCKETS // PARTS), np.uint16)
    counts = rows.where(F.col("part").isNotNull()).select("part", "counts").repartition(PARTS, "part")
    for r in counts.mapInArrow(add, "part int, levels binary").collect():
        levels[r["part"]] = np.frombuffer(r["levels"], np.uint16)
    return levels.ravel()


def small_sizes(rows: DataFrame) -> dict[int, tuple[float, float]]:
    """For each small size the sets of that size, and the length of lists at their rare end.

    Lists of probed elements are whole, as the probe goes by elements; the driver gets a row a size.
    """
    small = rows.where(F.col("n").between(1, MOST_LIGHT)).select("n", "h", "probe").dropDuplicates(["h"])
    counts = small.groupBy("n").agg(F.count("*").alias("sets"))
    elements = small.select("n", F.explode("probe").alias("e"))
    lists = elements.groupBy("e").agg(F.count("*").alias("length"))
    lengths = elements.join(lists, "e").groupBy("n").agg(F.percentile_approx("length", 0.15, 1000).alias("length"))
    return {r["n"]: (float(r["sets"]), float(r["length"] or 1)) for r in counts.join(lengths, "n", "left").collect()}


def keyed(docs: DataFrame, levels: np.ndarray, boundary: int, bound: Bound, width: int, text: str) -> DataFrame:
    """Per class (once a task at least): h, node, n, the rarest elements of sets that the heavy side needs, and keys and elements of light ones."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    crossing = -(-bound.num * (boundary + 1) // bound.den)
    longs = pa.list_(pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for s in sets_of(batch.column("text"), width):
                    if not len(s):
                        continue
                    node = signature(s)
                    if node in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.add(node)
                    light = len(s) <= boundary
                    keys, less = subset_keys(s, bound) if light else (None, None)
                    rows.append((
                        short(node), node, len(s), as_long(rarest(s, shared.value, bound.kept(len(s)))) if len(s) >= crossing else None,
                        as_long(keys) if light and len(keys) else None, less if light and len(keys) else None, as_long(s) if light and len(keys) else None,
                    ))
                col = lambda i, t: pa.array([r[i] for r in rows], t)  # noqa: E731, B023
                cols = [col(0, pa.int64()), decimals([r[1] for r in rows]), col(2, pa.int32()), col(3, longs), col(4, longs), col(5, pa.list_(pa.bool_())), col(6, longs)]
                yield pa.RecordBatch.from_arrays(cols, ["h", "node", "n", "rare", "subsets", "lesser", "members"])

    schema = f"h bigint, node {NODE}, n int, rare array<bigint>, subsets array<bigint>, lesser array<boolean>, members array<bigint>"
    return map_texts(docs, run, schema, text=F.col(text))


def light_links(keys: DataFrame, bound: Bound) -> DataFrame:
    """Links (u, v) of light sets: all members of a list link with any that has the lesser size; verified on their elements."""
    light = keys.where(F.col("subsets").isNotNull())
    rows = light.select("h", F.inline(F.arrays_zip(F.col("subsets").alias("key"), F.col("lesser").alias("less"))))
    pivots = rows.groupBy("key").agg(F.min(F.when(F.col("less"), F.col("h"))).alias("pivot"), F.min("h").alias("lo"), F.max("h").alias("hi"))
    pivots = pivots.where((F.col("lo") < F.col("hi")) & F.col("pivot").isNotNull()).select("key", "pivot")
    pairs = rows.join(pivots, "key").where(F.col("h") != F.col("pivot")).select("h", "pivot").distinct()
    sets = light.select("h", "node", "members").dropDuplicates(["node"])
    other = sets.select(F.col("h").alias("pivot"), F.col("node").alias("v"), F.col("members").alias("others"))
    both = F.size(F.array_intersect("members", "others"))
    linked = bound.den * both >= bound.num * (F.size("members") + F.size("others") - both)
    return pairs.join(sets, "h").join(other, "pivot").where(linked).select(F.col("node").alias("u"), "v")


def shared_lists(keys: DataFrame, bound: Bound, scratch: Scratch) -> DataFrame:
    """(e, h, n, at, pivot, pivot_n): members of inverted lists that can have a partner, each with its place in its set's order.

    Lists of one class go.  Partners share several of the elements that they keep, so classes that are in
    too few of the remaining lists go as well, and with them the lists that no longer have two.  The pivot
    of a list is the member that has the fewest rarer elements.
    """
    num, den = bound.num, bound.den
    prefix = lambda n: n - F.ceil(n * num / den) + 1
    # a partner may be smaller and keep fewer
    least = 1 + F.floor(prefix(F.ceil(F.col("n") * num / den)) / 4)
    rows = keys.where(F.col("rare").isNotNull()).select("h", "n", F.posexplode("rare").alias("at", "e"))
    for k in range(CORE_ROUNDS + 1):
        aggs = [F.min("h").alias("lo"), F.max("h").alias("hi")]
        if k == CORE_ROUNDS:
            central = F.shiftleft(F.col("at").cast("bigint"), 40) + F.xxhash64("h").bitwiseAND(F.lit((1 << 40) - 1))
            aggs += [F.min_by("h", central).alias("pivot"), F.min_by("n", central).alias("pivot_n")]
        lists = rows.groupBy("e").agg(*aggs).where(F.col("lo") < F.col("hi")).drop("lo", "hi")
        lists = scratch.table(f"lists-{k}", lists)
        shared = scratch.table(f"shared-{k}", rows.join(lists.hint("merge"), "e"))
        if k:
            scratch.drop(f"rows-{k - 1}")
        if k == CORE_ROUNDS:
            return shared
        # a class that several tasks gave counts more than once, which only keeps it longer
        kept = shared.groupBy("h", "n").agg(F.count("*").alias("lists")).where(F.col("lists") >= least).select("h", "n")
        rows = scratch.table(f"rows-{k}", shared.join(kept.hint("merge"), ["h", "n"]))
        scratch.drop(f"lists-{k}", f"shared-{k}")


def first_pairs(shared: DataFrame, bound: Bound) -> DataFrame:
    """(h, other): each class with the pivot that most of its lists have, among those of a size that it can link with."""
    sizes = (bound.den * F.least("n", "pivot_n") >= bound.num * F.greatest("n", "pivot_n")) & (F.col("h") != F.col("pivot"))
    met = shared.where(sizes).groupBy("h", "pivot").agg(F.count("*").alias("lists"))
    order = F.shiftleft(F.col("lists"), 32) + F.xxhash64("pivot").bitwiseAND(F.lit((1 << 32) - 1))
    return met.groupBy("h").agg(F.max_by("pivot", order).alias("other"))


def further_pairs(shared: DataFrame, roots: DataFrame, done: DataFrame, boundary: int, bound: Bound, scratch: Scratch) -> DataFrame:
    """(h, other): members of one list and of different components that sizes and positions allow to link.

    Of a pair the larger set looks for the smaller one, among the sizes that its position leaves.
    """
    num, den = bound.num, bound.den
    # the rarest element that two partners share is within the prefix of both
    rows = shared.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * num / den)).select("e", "h", "n", "at")
    live = scratch.table("live", rows.join(roots, "h").dropDuplicates(["e", "h", "root"]))
    open_lists = live.groupBy("e").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi")).select("e")
    members = scratch.table("members", live.join(open_lists.hint("merge"), "e"))
    step = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(SIZE_STEP)))
    n, at = F.col("n"), F.col("at")
    least = F.ceil(n * num / den)
    # need(n, m) <= n - at, solved for m
    most = F.least(n.cast("bigint"), F.floor((n - at) * (num + den) / num) - n)
    x = members.where(most >= least).select(
        "e", F.col("h").alias("h1"), F.col("n").alias("n1"), F.col("at").alias("at1"), F.col("root").alias("root1"), F.explode(F.sequence(step(least), step(most))).alias("step")
    )
    y = members.select("e", F.col("h").alias("h2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"), step(n).alias("step"))
    total = F.col("n1") + F.col("n2")
    need = F.ceil(F.lit(num) * total / (num + den))
    larger = (F.col("n2") < F.col("n1")) | ((F.col("n2") == F.col("n1")) & (F.col("h2") < F.col("h1")))
    met = x.hint("merge").join(y, ["e", "step"]).where(
        larger & (F.col("root1") != F.col("root2")) & (F.col("n1") > boundary) & (F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2")) >= need)
    )
    pairs = met.select(F.col("h1").alias("h"), F.col("h2").alias("other")).distinct()
    both = done.unionByName(done.select(F.col("other").alias("h"), F.col("h").alias("other")))
    return pairs.join(both, ["h", "other"], "left_anti")


def small_side(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is small; a written table, so counting it is cheap."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def packed_texts(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(h, node, packed text) of one document of each wanted class; ``wanted`` has h, node and the key of a row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("node"), pa.array(packed, pa.binary())], ["h", "node", "packed"])

    texts = docs.where(F.col(text).isNotNull()).select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    found = texts.join(small_side(wanted), "row").select("h", "node", "text").mapInArrow(run, f"h bigint, node {NODE}, packed binary")
    # rows that agree in id and text come more than once
    return found.dropDuplicates(["node"])


def compared(pairs: DataFrame, texts: DataFrame, bound: Bound, width: int) -> DataFrame:
    """The links (u, v), as signatures, among pairs (h, other): whole sets are compared."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        held = 0

        def load(packed: Iterable[bytes]) -> None:
            nonlocal held
            new = [p for p in {*packed} if p not in sets]
            column = pa.array([zlib.decompress(p) for p in new], pa.binary()).cast(pa.string())
            for p, s in zip(new, sets_of(column, width)):
                sets[p] = (signature(s), s)
                held += len(p) + s.nbytes

        for whole in batches:
            for batch in slices(whole, "packed", 1 << 18):
                if held > 24 << 20:
                    sets.clear()
                    held = 0
                cols = [batch.column(c).to_pylist() for c in ("node", "other_node", "packed", "other_packed")]
                load(cols[2] + cols[3])
                u, v = [], []
                for node, other, p, q in zip(*cols):
                    (x, a), (y, b) = sets[p], sets[q]
                    # a text that only has the key of the wanted one is of another class
                    if x == int(node) and y == int(other):
                        inter = len(np.intersect1d(a, b, assume_unique=True))
                        if bound.den * inter >= bound.num * (len(a) + len(b) - inter):
                            u.append(x)
                            v.append(y)
                yield pa.RecordBatch.from_arrays([decimals(u), decimals(v)], ["u", "v"])

    side = lambda name: texts.join(small_side(pairs.select(F.col(name).alias("h")).distinct()), "h", "left_semi")
    others = side("other").select(F.col("h").alias("other"), F.col("node").alias("other_node"), F.col("packed").alias("other_packed"))
    rows = pairs.join(side("h").hint("merge"), "h").join(others.hint("merge"), "other").select("node", "other_node", "packed", "other_packed")
    return rows.mapInArrow(run, f"u {NODE}, v {NODE}")


def similarity_classes(
    docs: DataFrame,
    width: int = WIDTH,
    num: int = NUM,
    den: int = DEN,
    doc_id: str = "doc_id",
    text: str = "text",
    boundary: int | None = None,
) -> DataFrame:
    """The component of links that each document belongs to.

    Two documents link when den * |intersection| >= num * |union| of their sets of distinct ``width``-word
    shingles (A-Z lowered; a text with fewer words is one shingle).  One row per input row: doc_id,
    n_shingles, component_id, the smallest doc_id reachable by links, component (a name of it, null for an
    empty set) and row, a key of id and text.  Null, empty and blank texts have an empty set and are linked
    with nothing; a null doc_id is never a component's id unless all of it is null.  Shingles are told
    apart by 64 bits, classes by 126.  Sets up to ``boundary`` are light; by default costs decide.
    """
    bound = Bound(num, den)
    scratch = Scratch(docs.sparkSession, "jaccard")
    written = scratch.table("rows", signed(docs, width, doc_id, text))
    rows = written.where(F.col("part").isNull()).select("doc_id", "row", "n", "node", "h", "probe")
    levels = rarity(written)
    if boundary is None:
        boundary = bound.boundary(small_sizes(rows))
    keys = scratch.table("keys", keyed(docs, levels, boundary, bound, width, text))
    light = scratch.table("light", light_links(keys, bound))
    shared = shared_lists(keys, bound, scratch)
    scratch.drop("keys")
    members = shared.select("h").distinct()
    # copies are combined before they meet by class
    fetched = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("h").alias("h"), F.min("row").alias("row"))
    wanted = scratch.table("wanted", fetched.join(members, "h"))
    texts = scratch.table("texts", packed_texts(docs, wanted, doc_id, text))
    pairs = scratch.table("pairs", first_pairs(shared, bound))
    near = scratch.table("near", compared(pairs, texts, bound, width))
    known = scratch.table("known", components(light.unionByName(near), scratch))
    roots = wanted.join(known, "node", "left").select("h", F.coalesce("root", "node").alias("root"))
    more_pairs = scratch.table("more_pairs", further_pairs(shared, roots, pairs, boundary, bound, scratch))
    scratch.drop(f"lists-{CORE_ROUNDS}", f"shared-{CORE_ROUNDS}", "live", "members")
    more = scratch.table("more", compared(more_pairs, texts, bound, width))
    scratch.drop("texts", "wanted", "pairs", "more_pairs")
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"))
    named = classes.join(known, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    if not more.isEmpty():
        to_root = lambda side: more.join(known, F.col(side) == F.col("node"), "left").select("u", "v", F.coalesce("root", side).alias(side + "_root"))
        edges = to_root("u").join(to_root("v"), ["u", "v"]).select(F.col("u_root").alias("u"), F.col("v_root").alias("v"))
        joined = components(edges, scratch, "joins").select(F.col("node").alias("near_root"), F.col("root").alias("far_root"))
        named = named.withColumnRenamed("root", "near_root").join(joined, "near_root", "left").select("node", "first", F.coalesce("far_root", "near_root").alias("root"))
    named = scratch.table("named", named)
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(ids, "root").select("node", F.col("root").alias("component"), "component_id")
    out = rows.select("doc_id", "row", F.col("n").cast("bigint").alias("n_shingles"), "node").join(names, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component", "row")
