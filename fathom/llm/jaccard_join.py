"""N-gram Jaccard join by parity sketches.

A text's set of word shingles is XOR-hashed into a bit sketch: each shingle flips one bit, so two sketches differ in
at most as many bits as the sets differ in shingles. Sets of sizes a and b with a Jaccard similarity of t or more
differ in at most d = (a + b)(1 - t) / (1 + t) shingles. Sizes are cut into bands; in each band, and around each
border of two bands, sketches are cut into d + 1 + s parts, of which two linked sketches share s + 1 at least
(pigeonholes). A text leaves out its s emptiest parts, by an order that depends on the parts alone: of the shared
parts the last in that order is one that both keep, so no link is lost. Texts that share a part are candidates;
those whose folded sketches differ too much go, the others are verified on their sets.

Equal sets are one class from the start. A part that many classes share is not expanded into all pairs: its members
are held against one hub, and if some of these fail, against each other in blocks of fixed size inside a task that
orders possible partners by sketch; those not of one component yet are verified in rounds, the nearest first, until
none is left. So the result is exact, with no cap on buckets or partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window

from . import scratch
from .components import components_table
from .shingles import mix, shingle_set

#: Ratio of neighbouring band borders. A text emits about 0.37 parts a shingle at t = 0.85.
BAND_RATIO = 1.5
#: Members of a shared part up to which all its pairs are candidates; members of a block beyond it; pairs of one task's hub.
PAIRS_UP_TO, BLOCK, HUB_ROWS = 6, 256, 128
#: Nearest possible partners that are verified first; each further round takes eight times as many.
FIRST_RANKS = 8
#: Rows whose features leave a worker together, and part keys after which fewer do.
FEATURE_ROWS, FEATURE_KEYS = 256, 1 << 20
#: Part of the texts whose part keys are looked at for hot ones, and how many of the sample's at least must have one.
HOT_SAMPLE, HOT_LEAST = 1 / 64, 8
#: Bits of the folded sketch that screens candidates.
FOLD_BITS = 1024
#: Tables of ids are broadcast up to so many bytes on disk, pairs to verify up to so many; beyond, what they meet is shuffled too.
BROADCAST_BYTES, PAIR_BYTES = 24 << 20, 8 << 20


def most_apart(total: int, percent: int) -> int:
    """Shingles in which two linked sets of `total` shingles together can differ."""
    return (total * (100 - percent)) // (100 + percent)


@lru_cache(maxsize=None)
def borders(up_to: int) -> tuple[int, ...]:
    """Border sizes: a band holds the sizes from one border to the next, less one."""
    out = [1, 4]
    while out[-1] <= up_to:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return tuple(out)


def plan(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(level, parts, parts left out) for a set of this size: its band, and the borders that a partner can lie beyond."""
    edges = borders(max(4, size * 2))
    k = int(np.searchsorted(edges, size, "right")) - 1
    low, high = edges[k], edges[k + 1]
    found = []
    for level, apart, least in (
        (2 * k, most_apart(2 * (high - 1), percent), low),
        (2 * k + 1, most_apart(high - 1 + (high - 1) * 100 // percent, percent) if size * 100 >= percent * high else 0, high * percent // 100),
        (2 * k - 1, most_apart(low - 1 + (low - 1) * 100 // percent, percent) if size * percent <= (low - 1) * 100 else 0, low * percent // 100),
    ):
        if apart > 0:
            spare = spare_parts(apart + 1, max(1, least))
            found.append((level, apart + 1 + spare, spare))
    return found


@lru_cache(maxsize=None)
def spare_parts(parts: int, least: int) -> int:
    """How many parts may be left out: those expected with one shingle or none in the band's least sets, and some more."""
    rate = least / parts
    mean = parts * math.exp(-rate) * (1 + rate)
    return min(parts // 4 + 1, math.ceil(mean + 2 * math.sqrt(mean)))


def part_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts that a set emits."""
    keys = []
    own = mix(shingles)
    for level, parts, spare in plan(len(shingles), percent):
        part = (shingles % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        starts = np.flatnonzero(np.diff(part[order], prepend=-1))
        count, sketch = np.zeros(parts, np.int64), np.zeros(parts, np.uint64)
        where = part[order][starts]
        sketch[where] = np.bitwise_xor.reduceat(own[order], starts)
        count[where] = np.diff(starts, append=len(order))
        kept = np.lexsort((np.arange(parts), sketch, count))[spare:]
        with np.errstate(over="ignore"):
            keys.append(mix(sketch[kept] + mix((np.uint64(level) << np.uint64(40)) + kept.astype(np.uint64))))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def folded(shingles: np.ndarray, bits: int = FOLD_BITS) -> bytes:
    """The parity sketch of all shingles in so many bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _features(width: int, percent: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("fold", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, held = 0, 0
            n, s1, s2, folds, keys = [], [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                own = shingle_set(text.as_py(), width)
                n.append(len(own))
                with np.errstate(over="ignore"):
                    s1.append(int(own.sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                    s2.append(int(mix(own + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0)
                folds.append(folded(own))
                keys.append(part_keys(own, percent).view(np.int64))
                held += len(keys[-1])
                # what has come together leaves the worker: after some rows, or fewer with many parts
                if row + 1 == batch.num_rows or row + 1 - begin == FEATURE_ROWS or held >= FEATURE_KEYS:
                    flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
                    numbers = [pa.array(x, pa.int64()) for x in (n, s1, s2)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, row + 1 - begin), *numbers, pa.array(folds, pa.binary()), flat], schema=schema)
                    begin, held = row + 1, 0
                    n, s1, s2, folds, keys = [], [], [], [], []

    return run


def _apart(width: int, percent: int):
    """Candidates whose folded sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            fa, fb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            bits = np.bitwise_count(fa ^ fb).sum(axis=1, dtype=np.int64)
            near = (bits <= (na + nb) * (100 - percent) // (100 + percent)) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], ["a", "b"])

    return run


def _against_hub(width: int, percent: int):
    """Rows (hub, salt, other, text), the hub's own (other is null) first: the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            a, b = [], []
            hubs, salts, others = (batch.column(i).to_pylist() for i in range(3))
            for hub, salt, other, text in zip(hubs, salts, others, batch.column(3).cast(pa.binary())):
                if other is None:
                    now, own = (hub, salt), shingle_set(text.as_py(), width)
                elif now == (hub, salt) and linked(own, shingle_set(text.as_py(), width), percent):
                    a.append(hub)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _blocks(percent: int, low: int, high: int):
    """Rows (key, i, j, side, id, label, n, fold) sorted by these: pairs of members with different labels to verify.

    Each member's possible partners are ordered by the distance of the folded sketches; pairs of ranks low to high - 1
    come out, and a row without b if a pair of a higher rank is left.
    """

    def pairs(rows: list[tuple], crossing: bool) -> tuple[list[tuple], bool]:
        sides, ids, labels, sizes = (np.array([r[k] for r in rows]) for k in range(4))
        left, right = (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)) if crossing else (np.arange(len(rows)),) * 2
        if not len(left) or not len(right):
            return [], False
        bits = np.unpackbits(np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        apart = ones[left][:, None] + ones[right] - 2 * (bits[left] @ bits[right].T)
        a, b = sizes[left][:, None], sizes[right]
        near = (apart <= (a + b) * (100 - percent) // (100 + percent) + 0.5) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
        if not crossing:
            near &= right > left[:, None]
        found, more = [], False
        for i in np.flatnonzero((near & (labels[left][:, None] != labels[right])).any(axis=1)):
            some = np.flatnonzero(near[i])
            some = some[np.argsort(apart[i][some], kind="stable")]
            other = labels[right[some]] != labels[left[i]]
            found += [(int(ids[left[i]]), int(ids[right[j]])) for j in some[low:high][other[low:high]]]
            more |= bool(other[high:].any())
        return found, more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush():
            found, more = pairs(rows, now[1] != now[2]) if len(rows) > 1 else ([], False)
            found += [(0, None)] * more
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                if (key, i, j) != now:
                    if rows:
                        yield flush()
                    now, rows = (key, i, j), []
                rows.append(row)
        if rows:
            yield flush()

    return run


def _verified(pairs: DataFrame, at: str, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of a scratch table that link. A hub's pairs are dealt out HUB_ROWS to a task's group, each with the hub's text."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("parts"))
    others = salted.join(degree, "a").select("a", F.pmod("salt", "parts").cast("int").alias("salt"), F.col("b").alias("other"), F.col("b").alias("id"))
    own = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("other"), F.col("a").alias("id"))
    asked = own.unionAll(others)
    if scratch.table_bytes(pairs.sparkSession, at) <= PAIR_BYTES:
        asked = F.broadcast(asked)
    dealt = texts.join(asked, "id").select("a", "salt", "other", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("other").asc_nulls_first())
    return dealt.mapInArrow(_against_hub(width, percent), "a long, b long")


def _shared_keys(keyed: DataFrame) -> tuple[DataFrame, str]:
    """(id, key, size): the rows (id, key) of keys that several have, and how many; and the scratch table that they are read from.

    Rows are counted in windows by key; those of the keys that a sample of the ids shows to be the hottest, at most
    HOT_PART of them, are dealt to several windows each, and their sizes are summed up. Which way a key goes changes no
    count.
    """
    spark = keyed.sparkSession
    sample = keyed.where(F.pmod(F.xxhash64("id"), F.lit(round(1 / HOT_SAMPLE))) == 0).groupBy("key").count()
    found = sample.where(F.col("count") >= HOT_LEAST).orderBy(F.desc("count")).limit(scratch.HOT_PART)
    hot = spark.createDataFrame([(r.key, True) for r in found.select("key").collect()], "key long, hot boolean")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(scratch.SALTS))).otherwise(F.lit(0))
    marked = keyed.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    counted = marked.withColumn("size", F.count("*").over(Window.partitionBy("key", salt))).where("hot OR size > 1")
    table, at = scratch.keep(counted.select("id", "key", "size", "hot"))
    sizes = table.where("hot").groupBy("key").agg(F.count("*").alias("whole"))
    whole = table.join(F.broadcast(sizes), "key", "left").select("id", "key", F.coalesce("whole", "size").alias("size"))
    return whole.where("size > 1"), at


def _by_size(rows: DataFrame, table: DataFrame, total: int) -> DataFrame:
    """Rows (key, size, ..) joined to a written table (key, size, ..) with one row a key; hot keys by broadcast, as there are at most HOT_PART."""
    large = F.col("size") * scratch.HOT_PART > total
    hot, cold = table.where(large).drop("size"), table.where(~large).drop("size")
    return rows.where(large).join(F.broadcast(hot), "key").unionByName(rows.where(~large).join(cold, "key"))


def links_and_classes(df: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """classes (id, n, rep): each row's set size and the least id with the same set; edges (a, b) of classes that link; the scratch tables that both are read from.

    The edges connect all that links connect; between members of one component not every link need be listed.
    """
    if not 50 <= percent <= 99:
        raise ValueError("percent must be from 50 to 99")
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise ValueError(f"'{id_col}' must be a column of integers")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    features, features_at = scratch.keep(docs.mapInArrow(_features(width, percent), "id long, n long, s1 long, s2 long, fold binary, keys array<long>"))
    full = features.where("n > 0 AND id IS NOT NULL")
    # sets that several rows have
    sets, sets_at = scratch.keep(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"))
    own = full.select("id", "n", "s1", "s2")
    if scratch.table_bytes(spark, sets_at) <= BROADCAST_BYTES:
        grouped = own.join(F.broadcast(sets), ["s1", "s2", "n"], "left")
    else:
        grouped = scratch.join_split(own, sets, ["s1", "s2", "n"], "rows", full.count(), "id", "left")
    classes, classes_at = scratch.keep(grouped.select("id", "n", F.coalesce("rep", "id").alias("rep")))
    scratch.drop(spark, sets_at)
    gone, gone_at = scratch.keep(classes.where("id <> rep").select("id").distinct())
    reps = full.join(scratch.small(gone, gone_at, BROADCAST_BYTES), "id", "left_anti")
    shared, shared_at = _shared_keys(reps.select("id", F.explode("keys").alias("key")))

    small = shared.where(f"size <= {PAIRS_UP_TO}")
    one, other = small.select("key", F.col("id").alias("a")), small.select("key", F.col("id").alias("b"))
    few = one.join(other, "key").where("a < b").select("a", "b")
    large = shared.where(f"size > {PAIRS_UP_TO}")
    weight = large.groupBy("id").agg(F.count("*").alias("weight"))
    total = large.count()
    heads, heads_at = scratch.keep(large.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("hub"), F.max("size").alias("size")))
    stars = _by_size(large, heads, total).where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    screen = features.select("id", "n", "fold").where("n > 0").dropDuplicates(["id"])
    pairs = few.unionAll(stars).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(screen.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("fold").alias(f"f{end}")), end)
    pairs = pairs.select("a", "b", "na", "nb", "fa", "fb").mapInArrow(_apart(width, percent), "a long, b long")
    pairs, pairs_at = scratch.keep(pairs)
    needed, needed_at = scratch.keep(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).unionAll(large.select("id")).distinct())
    held, held_at = scratch.keep(docs.join(scratch.small(needed, needed_at, BROADCAST_BYTES), "id").groupBy("id").agg(F.first("text").alias("text")))
    edges, edges_at = scratch.keep(_verified(pairs, pairs_at, held, width, percent))

    # parts whose members are not of one component yet go on in blocks, nearest partners first
    sizes, sizes_at = scratch.keep(large.join(screen, "id"))
    low, high, spent, kept_at = 0, FIRST_RANKS, [], [features_at, classes_at, edges_at]
    while True:
        roots, roots_at = components_table(edges)
        placed = scratch.small(roots.withColumnRenamed("node", "id"), roots_at, BROADCAST_BYTES)
        labelled = sizes.join(placed, "id", "left").withColumn("label", F.coalesce("root", "id"))
        mixed = labelled.groupBy("key").agg(F.max("size").alias("size"), F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2")
        mixed, mixed_at = scratch.keep(mixed.select("key", "size"))
        if scratch.table_bytes(spark, mixed_at) <= BROADCAST_BYTES:
            rest = labelled.join(F.broadcast(mixed.drop("size")), "key")
        else:
            rest = _by_size(labelled, mixed, total)
        rest = rest.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        rest = rest.withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
        dealt = dealt.select("key", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"), F.when(F.col("at") > F.col("o"), 1).otherwise(0).alias("side"), "id", "label", "n", "fold")
        dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "id")
        found, found_at = scratch.keep(dealt.mapInArrow(_blocks(percent, low, high), "a long, b long"))
        asked, asked_at = scratch.keep(found.where("b IS NOT NULL").distinct())
        new, new_at = scratch.keep(_verified(asked, asked_at, held, width, percent))
        edges = edges.unionAll(new)
        spent += [found_at, asked_at, mixed_at, roots_at]
        kept_at.append(new_at)
        if found.where("b IS NULL").isEmpty():
            break
        low, high = high, high * 8
    scratch.drop(spark, sizes_at, *spent)
    scratch.drop(spark, shared_at, heads_at, pairs_at, needed_at, held_at, gone_at)
    return features.select("id", "n").join(classes.select("id", "rep").distinct(), "id", "left"), edges, kept_at


def jaccard_components(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, n_shingles (set size), component_id (least id reachable by links).

    Words are runs without ASCII white space, A-Z in lower case; a text shorter than `width` words is one shingle. A
    text without words (null, empty) has an empty set and links with nothing. Links need
    100 * intersection >= percent * union. Rows that repeat an id are the same node and should repeat its text; ids
    must be integers (others are an error), a null id stays alone (component_id null). An empty table gives an empty
    result. Other columns are ignored, so their names cannot clash.
    """
    return _components(df, width, percent, id_col, text_col)[0]


def _components(df: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """jaccard_components() and the scratch table that it is read from."""
    spark = df.sparkSession
    classes, edges, used = links_and_classes(df, width, percent, id_col, text_col)
    roots, roots_at = components_table(edges)
    placed = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    out, at = scratch.keep(placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "rep", "id").alias("component_id")))
    scratch.drop(spark, *used, roots_at)
    return out, at


def others(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(doc_id, component_id), each once, of the ids that are not the least of their component; broadcast if small; and the scratch table that they are read from."""
    found, at = _components(df, width, percent, id_col, text_col)
    out, out_at = scratch.keep(found.where("component_id <> doc_id").select("doc_id", "component_id").distinct())
    scratch.drop(df.sparkSession, at)
    return scratch.small(out, out_at, BROADCAST_BYTES), out_at


def one_of_each(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is the least of its component, with all their columns; rows without id or words stay, rows that repeat a kept id too."""
    key = scratch.fresh(df, "_gone")
    gone = others(df, width, percent, id_col, text_col)[0].select(F.col("doc_id").alias(key))
    return df.join(gone, df[id_col] == F.col(key), "left_anti")
