"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Method: every document becomes the set of its distinct k-word shingles. A fast similarity sketch
(rounds of hashed bin placement: in round r each element falls into one bin, an empty bin keeps its
smallest value, and from round ``size`` on each element goes to a fixed bin, so all coordinates fill)
gives ``size`` coordinates, each equal for two sets with the probability of their Jaccard similarity.
Bands of ``rows`` coordinates propose buckets; links are confirmed on full sets.

No bucket is expanded into all its pairs:

1. identical sets are one node;
2. in every bucket each node is compared with one hub, the node that shares most band values with
   others; confirmed links give components;
3. a bucket that now lies in one component needs nothing more. In the others only nodes of
   different components are compared: in small buckets directly, and for the nodes of large buckets
   by an exact prefix-filter join over their rarest shingles, with size classes, which loses no pair.

Before sets are shipped, pairs whose one-bit sketches agree less than six standard deviations below
the threshold's expectation are put aside (loss about 1e-9 a pair).

Defined results: null or empty text, or text without words, has ``n_shingles`` 0 and is linked with
nothing; fewer than ``k`` words make one shingle. A null id takes part; its ``component_id`` is the
smallest non-null id reachable, or null. Repeated rows give repeated result rows. Other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.common import WordCodes, ascii_lower, ascii_space, byte_slices, discard, mix64, perhaps_in, seed, spare_names, text_buffer, written

SMALL_BUCKET = 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, codes: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle code) of every distinct shingle, by row and code."""
    _, _, row, code = codes.words(ascii_lower(data), offsets)
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    firsts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    length = np.diff(np.r_[firsts, n])
    left = np.repeat(firsts + length, length) - np.arange(n)  # words from here to the row's end
    whole = np.repeat(length, length)
    heads = np.flatnonzero((left >= k) | ((whole < k) & (left == whole)))
    total = np.zeros(len(heads), np.uint64)
    for j in range(k):
        at = np.minimum(heads + j, n - 1)
        total += np.where(j < left[heads], mix64(code[at] + seed(j, 0xA0761D6478BD642F)), np.uint64(0))
    shingle, row = mix64(total), row[heads]
    order = np.lexsort((shingle, row))
    shingle, row = shingle[order], row[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])]
    return row[new], shingle[new]


def similarity_sketch(row: np.ndarray, element: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """[n_rows, size] uint64: the round and value kept by each coordinate. Rows without elements stay full of ones."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(n_rows * size, full, np.uint64)
    mask = np.uint64((1 << 52) - 1)
    for r in range(2 * size):
        if not len(row):
            break
        h = mix64(element + seed(r, 0x8CB92BA72F3D8DD7))
        if r < size:
            place = ((h >> np.uint64(40)) * np.uint64(size) >> np.uint64(24)).astype(np.int64)
        else:
            place = r - size
        h = mix64(h)
        np.minimum.at(sketch, row * size + place, (np.uint64(r) << np.uint64(52)) | (h & mask))
        open_rows = (sketch.reshape(n_rows, size) == full).any(axis=1)
        keep = open_rows[row]
        if not keep.all():
            row, element = row[keep], element[keep]
    return sketch.reshape(n_rows, size)


def _set_keys(row: np.ndarray, shingle: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit key of each row's set."""
    size = np.bincount(row, minlength=n_rows).astype(np.int64)
    key = np.zeros(n_rows, np.uint64)
    np.add.at(key, row, mix64(shingle ^ np.uint64(0x2545F4914F6CDD1D)))
    return size, mix64(key + size.astype(np.uint64)).view(np.int64)


def _signatures(docs: DataFrame, k: int, size: int, rows: int) -> DataFrame:
    bands = size // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(ascii_space())
        for batch in byte_slices(batches, "t"):
            n = batch.num_rows
            row, shingle = shingle_sets(*text_buffer(batch.column(1)), k, codes)
            count, node = _set_keys(row, shingle, n)
            full = np.flatnonzero(count)
            place = np.full(n, -1)
            place[full] = np.arange(len(full))
            sketch = similarity_sketch(place[row], shingle, len(full), size)
            band = np.zeros((len(full), bands), np.uint64)
            for b in range(bands):
                band[:, b] = b + 1
                for j in range(b * rows, (b + 1) * rows):
                    band[:, b] = mix64(band[:, b] * np.uint64(0x9E3779B97F4A7C15) + sketch[:, j])
            bits = np.zeros((len(full), 256), np.uint8)
            bits[:, :size] = (mix64(sketch) & np.uint64(1)).astype(np.uint8)
            bits = np.packbits(bits, axis=1).view(np.int64).reshape(len(full), 4)
            lists = np.zeros(n + 1, np.int32)
            np.cumsum(np.where(count > 0, bands, 0), out=lists[1:])
            words = np.zeros((n, 4), np.int64)
            words[full] = bits
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count), pa.array(node), pa.ListArray.from_arrays(pa.array(lists), pa.array(band.reshape(-1).view(np.int64)))]
                + [pa.array(np.ascontiguousarray(words[:, i])) for i in range(4)],
                ["id", "n", "node", "bands", "s0", "s1", "s2", "s3"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, n bigint, node bigint, bands array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, n, items) for each node of ``wanted`` (node, min_id), from another scan of the texts.

    Only rows whose hashed id may be wanted are cut into shingles; a join on nodes makes it exact.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(ascii_space())
        for batch in byte_slices(batches, "t"):
            row, shingle = shingle_sets(*text_buffer(batch.column(0)), k, codes)
            count, node = _set_keys(row, shingle, batch.num_rows)
            ends = np.zeros(batch.num_rows + 1, np.int32)
            np.cumsum(count, out=ends[1:])
            items = pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(count), items], ["node", "n", "items"])

    ids = wanted.select(F.xxhash64("min_id").alias("key"))
    rows = perhaps_in(docs, F.xxhash64("id"), ids, "wanted").where("wanted").select("t")
    found = rows.mapInArrow(run, "node bigint, n bigint, items array<bigint>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _plausible(pairs: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) whose one-bit sketches and set sizes allow the threshold."""
    p = (1 + least) / 2
    most_unlike = size - math.floor(size * p - 6 * math.sqrt(size * p * (1 - p)))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), *(F.col(f"s{i}").alias(f"s{i}{x}") for i in range(4)))
    unlike = sum((F.bit_count(F.col(f"s{i}a").bitwiseXOR(F.col(f"s{i}b"))) for i in range(1, 4)), F.bit_count(F.col("s0a").bitwiseXOR(F.col("s0b"))))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where((unlike <= most_unlike) & (F.least("na", "nb") >= F.greatest("na", "nb") * (least - 1e-9))).select("a", "b")


def _confirmed(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on full sets, as a written table."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "min_id"), "node"), "wanted")
    sets = written(_sets_of(docs, wanted, k), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"items_{x}"))
    both = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", both.alias("both"))
    links = written(joined.where(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), "links")
    discard(wanted, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b), as a written table; root is the component's smallest node.

    Smallest labels spread along edges and by pointer jumping, so the number of rounds grows with the
    logarithm of a component's diameter. Only minima per node are aggregated: a hub with many links
    is summed up before the shuffle.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.col("node").alias("old"), F.least("node", "m").alias("root"))
    labels = written(first, "labels")
    while True:
        told = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("told"))
        near = labels.select("node", "root").join(told, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "told").alias("root"))
        up = labels.select(F.col("node").alias("up"), F.col("root").alias("above"))
        new = written(near.join(up, near.root == up.up, "left").select("node", "old", F.least("root", "above").alias("root")), "labels")
        discard(labels)
        labels = new
        if new.where("old <> root").isEmpty():
            discard(both)
            return labels


def _bucket_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs of different components in small buckets (key, node, root)."""
    left, right = (buckets.select("key", F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    return left.join(right, "key").where("ra < rb").select("a", "b")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of ``members`` (node, root) of different roots that can reach the threshold: an exact prefix filter.

    With shingles ordered by frequency among the members, two sets of sizes s <= n with enough in
    common have their first common shingle early in both: at position i of n only if
    s <= (n - i) * (1 + t) / t - n. The larger set asks for the size classes this allows (a class is
    a ratio of 1 / t, so two at most), the smaller one answers for its own. The result is a written table.

    The last join reads two tables that end in nothing but its own exchange, so a shingle that many
    members share is split over tasks by the engine's skew handling.
    """
    t = percent / 100
    items = sets.join(members, "node").select("node", "root", "n", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("f"))
    ranked = items.join(often, "item").groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("s"))
    least = F.col("n") - F.ceil(F.col("n") * t - 1e-6) + 1
    spread = ranked.select("node", "root", "n", F.posexplode(F.slice("s", F.lit(1), least.cast("int"))).alias("i", "s")).where("s.f > 1")
    limit = (F.col("n") - F.col("i")) * ((1 + t) / t) - F.col("n") + 1e-6
    spread = written(spread.select("node", "root", F.col("n").cast("double").alias("n"), F.col("s.item").alias("item"), limit.alias("top")), "spread")
    klass = lambda c: F.floor(F.log(F.greatest(c, F.lit(1.0))) / -math.log(t))
    answers = spread.where("top >= n").select("item", klass(F.col("n")).alias("class"), F.col("node").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"))
    asks = spread.select("item", F.explode(F.sequence(klass(F.col("n") * t - 1e-6), klass(F.least("n", "top")))).alias("class"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), "top")
    everyone = answers.select("item", "class", F.col("ra").alias("r")).union(asks.select("item", "class", F.col("rb").alias("r")))
    mixed = written(everyone.groupBy("item", "class").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo < hi").select("item", "class"), "mixed")
    answers = written(answers.join(mixed, ["item", "class"], "left_semi"), "answers")
    found = answers.join(asks, ["item", "class"]).where(f"ra <> rb and na <= nb and na <= top and na >= {t} * nb - 1e-6")
    pairs = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    discard(spread, mixed, answers)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, k: int = 5, size: int = 252, rows: int | None = None) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept: one row per document; links need a Jaccard similarity of ``percent`` in 100.

    Each step's table is removed when its last reader is done; the two that the result reads stay.
    """
    rows = rows or (7 if percent >= 85 else 6)
    if size > 256 or size % rows:
        raise ValueError("size is a multiple of rows and 256 at most")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    signed = written(_signatures(docs, k, size, rows), "signatures")
    # A set's copies have the same bands: one node stands for them.
    nodes = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("min_id"), *(F.min(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3", "bands")))
    banded = written(nodes, "nodes")
    nodes = banded.drop("bands")
    spread = banded.select("node", F.explode("bands").alias("key"))
    crowd = spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    placed = written(spread.join(crowd, "key"), "buckets")

    score = placed.groupBy("node").agg(F.sum(F.col("c") - 1).alias("score"))
    hubs = placed.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    star = placed.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    star = written(_plausible(star, nodes, size, percent / 100), "star")
    links = _confirmed(docs, star, nodes, k, percent)
    roots = components(links)

    rooted = placed.join(roots, "node", "left").select("key", "node", "c", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "rooted")
    discard(placed)
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    unsettled = written(rooted.join(open_keys, "key", "left_semi"), "open")
    discard(rooted)
    pairs = _bucket_pairs(unsettled.where(F.col("c") <= SMALL_BUCKET)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    crowded = written(unsettled.where(F.col("c") > SMALL_BUCKET).select("node", "root").distinct(), "crowded")
    used = [crowded, unsettled]
    if not crowded.isEmpty():
        wanted = written(crowded.join(nodes.select("node", "min_id"), "node").select("node", "min_id"), "wanted")
        sets = written(_sets_of(docs, wanted, k), "sets")
        prefixed = _prefix_pairs(crowded, sets, percent)
        discard(wanted, sets)
        used.append(prefixed)
        pairs = pairs.union(prefixed).distinct()
    pairs = written(_plausible(pairs, nodes, size, percent / 100).join(star, ["a", "b"], "left_anti"), "pairs")
    discard(star, *used)
    if not pairs.isEmpty():
        more = _confirmed(docs, pairs, nodes, k, percent)
        if not more.isEmpty():
            discard(roots)
            roots = components(links.union(more))
        discard(more)
    discard(links, pairs)

    homes = nodes.select("node", "min_id").join(roots, "node", "left").select("node", "min_id", F.coalesce("root", "node").alias("root"))
    smallest = homes.groupBy("root").agg(F.min("min_id").alias("component_id"))
    homes = written(homes.join(smallest, "root").select("node", "component_id"), "homes")
    discard(roots, banded)
    out = signed.select("id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(homes, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))


def deduplicated(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the smallest id.

    Of rows of a group that share this id, one stays; rows that share an id in different groups are
    judged apart. A group of which no row has an id keeps a row for each text. Rows without words
    are never duplicates: all stay. A row is named by a 64-bit hash of its id and text.
    """
    key = F.xxhash64(F.col(id_col).isNull(), F.col(id_col), F.col(text_col))
    # Ids come before none; the key makes the smallest one a single row of its group, or copies of it.
    named = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key.alias("key")).alias("row"), F.col(text_col).alias("text"))
    judged = near_duplicates(named, "row", "text", percent).where("n_shingles > 0")
    stays = F.coalesce(F.col("kept"), F.lit(False)) | F.col("component_id.none")
    verdicts = judged.select(F.col("row.key").alias("__key"), stays.alias("stays")).groupBy("__key").agg(F.max("stays").alias("__stays"), F.count("*").alias("__copies"))
    touched = written(verdicts.where("not __stays or __copies > 1"), "verdicts")
    # Texts are shuffled only where a row may go; all others pass in the scan.
    places = spare_names(docs.columns, 5)
    rows = perhaps_in(docs.withColumn(places[0], key), F.col(places[0]), touched.select("__key"), places[1])
    rest = rows.where(places[1]).join(touched.select(F.col("__key").alias(places[0]), F.col("__stays").alias(places[2]), F.lit(True).alias(places[3])), places[0], "left")
    nth = F.row_number().over(Window.partitionBy(places[0]).orderBy(places[0]))
    rest = rest.withColumn(places[4], nth).where(F.col(places[3]).isNull() | (F.col(places[2]) & (F.col(places[4]) == 1)))
    return rows.where(~F.col(places[1])).select(docs.columns).union(rest.select(docs.columns))
