"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

An item leaks if a local alignment of its words with a text's scores at least a part of the item's length. Such an
alignment has so many words side by side in both (`needed`) that, by a pigeonhole argument, the item's commonest
two-word seeds can be left out, a third of that number, and the other two thirds are still found close to one diagonal. So
the rare seeds lose no alignment, however the edits lie.

The corpus is read once to count the texts that hold each n-gram of an item; the rarer ones are seeds. A second reading
finds the seeds' places; these are joined to items by key, and places near one diagonal are counted. Where enough meet,
the text comes back and its part there is aligned with the item. Workers only get a bit table of n-grams of a fixed
largest size, which says what cannot be in an item; the rest goes through joins, so neither the corpus nor the
benchmark must fit anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T, Window

from . import scratch
from .shingles import ngram_hashes, word_hashes

#: Words of a seed (one-word items have the word), part of an item's length that an alignment must score, and its least score (or the whole item).
NGRAM, CUT, LEAST_SCORE = 2, 0.4, 6
#: Points of a match, a mismatch and a gap, doubled.
MATCH, MISMATCH, GAP = 2, -1, -2
#: Bits of the table for each n-gram of the items, and the most bits that it has (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Seeds and candidates are broadcast up to so many bytes on disk; beyond, both sides are shuffled, a seed's texts in so many parts.
BROADCAST_BYTES, SALTS = 16 << 20, 16

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> np.ndarray:
    """Hashes of the words: lower case, ASCII punctuation as white space."""
    return word_hashes((text or "").lower().encode().translate(_PLAIN))


def least_score(length: int, cut: float = CUT) -> float:
    """What an alignment with an item of so many words must score."""
    return max(cut * length, min(length, LEAST_SCORE))


def needed(length: int, cut: float = CUT) -> int:
    """Pairs of neighbouring words that such an alignment shares at least.

    With M matches and X mismatches, the score S is at most M - X / 2, less one for each gap, and gaps and mismatches
    are all that can end a run of matches: M - 1 - X pairs are left if there are no gaps, and each gap that ends a run
    costs a match more. M + X is at most the length, so X is at most (length - S) / 1.5.
    """
    score = least_score(length, cut)
    return max(1, math.ceil(score - (length - score) / 3 - 1 - 1e-9))


def align(item: np.ndarray, window: np.ndarray) -> float:
    """Smith-Waterman score of the best local alignment."""
    steps = np.arange(1, len(window) + 1) * -GAP
    above, best = np.zeros(len(window) + 1, np.int64), 0
    for word in item:
        here = np.maximum(above[:-1] + np.where(window == word, MATCH, MISMATCH), above[1:] + GAP)
        here = np.maximum(here, 0)
        here = np.maximum.accumulate(here + steps) - steps
        best = max(best, int(here.max(initial=0)))
        above[1:] = here
    return best / MATCH


def _item_grams(items: DataFrame, cut: float) -> DataFrame:
    """(item, id, words, grams): an item's key, id, words and n-grams, with the most that a diagonal of its hits spreads, the hits needed and the n-grams to leave out."""
    kind = items.schema["_id"].dataType
    schema = T.StructType([
        T.StructField("item", T.LongType()), T.StructField("id", kind), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType())),
        T.StructField("spread", T.LongType()), T.StructField("hits", T.LongType()), T.StructField("common", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words(x.as_py()) for x in batch.column(2)]
            grams = [ngram_hashes(w, NGRAM) for w in own]
            must = [needed(len(w), cut) if len(w) > NGRAM else 1 for w in own]
            common = [n // 3 for n in must]
            # places are counted by the bits of a word, so of a long item several can count as one
            hits = [-(-(n - c) // max(1, -(-len(g) // 64))) for n, c, g in zip(must, common, grams)]
            spread = [math.ceil(len(w) - least_score(len(w), cut)) if len(w) else 0 for w in own]
            lists = [pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64())) for part in (own, grams)]
            numbers = [pa.array(x, pa.int64()) for x in (spread, hits, common)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, *numbers], schema.names)

    return items.mapInArrow(run, schema).where("size(words) > 0")


def _bit_table(spark, grams: DataFrame):
    """Broadcast (bits, lengths in use): a bit for each n-gram; of a size that is bounded whatever the items are."""
    n = grams.agg(F.count_distinct("gram")).first()[0]
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (BITS_EACH * n).bit_length()))
    at = F.col("gram").bitwiseAND(F.lit(bits - 1))
    cells = grams.select(F.shiftright(at, 6).alias("cell"), F.expr("shiftleft(1L, CAST(gram & 63L AS INT))").alias("bit"))
    found = cells.groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[found["cell"].to_numpy()] = found["bit"].to_numpy()
    lengths = [r[0] for r in grams.select("n").distinct().collect()]
    return spark.sparkContext.broadcast((table.view(np.uint64), sorted(lengths)))


def _hits(text: np.ndarray, table: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of the text whose bit is set, and their places."""
    grams, places = [], []
    last = np.uint64(len(table) * 64 - 1)
    for n in lengths:
        if len(text) >= n:
            own = ngram_hashes(text, n)
            at = own & last
            found = np.flatnonzero((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            grams.append(own[found])
            places.append(found)
    return (np.concatenate(grams), np.concatenate(places)) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _counts(texts: DataFrame, shared) -> DataFrame:
    """(gram, texts): how many texts hold each n-gram whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(_hits(words(x.as_py()), *shared.value)[0]) for x in batch.column(0)]
            grams, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "texts"])

    return texts.mapInArrow(run, "gram long, texts long").groupBy("gram").agg(F.sum("texts").alias("texts"))


def _places(docs: DataFrame, shared) -> DataFrame:
    """(a, b, gram, place) of docs (a, b, text): every place of an n-gram whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                grams, places = _hits(words(text.as_py()), *shared.value)
                if len(grams):
                    keys = [pa.array(np.full(len(grams), k, np.int64)) for k in (a, b)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(grams.view(np.int64)), pa.array(places)], ["a", "b", "gram", "place"])

    return docs.mapInArrow(run, "a long, b long, gram long, place long")


def _aligned(schema: T.StructType, cut: float):
    """Rows of one text after another: the text itself (no item), then the items' parts of diagonals in order."""

    def best(text: np.ndarray, item: np.ndarray, bins: list[int], spread: int) -> float:
        wide, n, top = spread + 1, len(item), 0.0
        at = 0
        while at < len(bins):
            # parts that follow each other are one window
            end = at
            while end + 1 < len(bins) and bins[end + 1] <= bins[end] + 1:
                end += 1
            window = text[max(0, bins[at] * wide - spread) : max(0, (bins[end] + 2) * wide + n + spread)]
            top = max(top, align(item, window))
            at = end + 1
        return top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text = None, None
        for batch in batches:
            rows = {k: [] for k in schema.names}
            cols = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for row, (a, b, doc, body, item, name, item_words, spread, bins) in enumerate(zip(*cols)):
                if item is None:
                    now, text, doc_id = (a, b), words(body), doc
                elif now == (a, b):
                    own = np.array(item_words, np.int64).view(np.uint64)
                    score = best(text, own, bins, spread)
                    if score >= least_score(len(own), cut) - 1e-9:
                        for k, v in zip(schema.names, (a, b, doc_id, name, score / len(own))):
                            rows[k].append(v)
            types = [pa.int64(), pa.int64(), batch.schema.field(2).type, batch.schema.field(5).type, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(rows[k], t) for k, t in zip(schema.names, types)], schema.names)

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b, id, text): two hashes that stand for a row's id and text."""
    own = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(F.xxhash64(docs[id_col], own).alias("a"), F.xxhash64(F.lit("text"), own, docs[id_col]).alias("b"), docs[id_col].alias("id"), own.alias("text"))


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id: str, item_text: str, cut: float) -> DataFrame:
    """(a, b, doc_id, item_id, score) of the texts that hold an item."""
    spark = docs.sparkSession
    if cut < CUT:
        raise ValueError(f"below {CUT} two-word seeds do not find all alignments")
    text = F.coalesce(items[item_text], F.lit(""))
    own = items.select(F.xxhash64(items[item_id], text).alias("item"), items[item_id].alias("_id"), text.alias("_text")).dropDuplicates(["item"])
    tables = []

    def keep(df: DataFrame) -> DataFrame:
        kept, at = scratch.keep(df)
        tables.append(at)
        return kept

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if scratch.table_bytes(spark, tables[-1]) <= BROADCAST_BYTES else df

    own = keep(_item_grams(own, cut))
    grams = keep(own.select("item", "hits", "common", "spread", F.least(F.size("words"), F.lit(NGRAM)).alias("n"), F.posexplode("grams").alias("at", "gram")))
    keyed = _keyed(docs, id_col, text_col)
    counts = keep(_counts(keyed.select("text"), _bit_table(spark, grams)))
    rarity = Window.partitionBy("item").orderBy(F.desc(F.coalesce("texts", F.lit(0))), "at")
    ranked = grams.join(small(counts), "gram", "left").withColumn("rank", F.row_number().over(rarity))
    seeds = keep(ranked.where("rank > common").select("item", "gram", "n", F.col("at").cast("long"), "hits", "spread"))
    places = _places(keyed.select("a", "b", "text"), _bit_table(spark, seeds))
    if scratch.table_bytes(spark, tables[-1]) <= BROADCAST_BYTES:
        met = places.join(F.broadcast(seeds), "gram")
    else:
        # a seed of many texts is dealt out
        dealt = seeds.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = places.withColumn("salt", F.pmod("a", F.lit(SALTS)).cast("int")).join(dealt, ["gram", "salt"])
    # hits whose diagonals spread by no more than a part's width lie in one pair of parts
    part = F.floor((F.col("place") - F.col("at")) / (F.col("spread") + 1))
    near = met.select("a", "b", "item", "hits", F.expr("shiftleft(1L, CAST(at % 64 AS INT))").alias("bit"), F.explode(F.array(part - 1, part)).alias("bin"))
    near = near.groupBy("a", "b", "item", "hits", "bin").agg(F.bit_count(F.bit_or("bit")).alias("met")).where("met >= hits")
    found = keep(near.groupBy("a", "b", "item").agg(F.array_sort(F.collect_set("bin")).alias("bins")))
    held = keep(found.select("a", "b").distinct())
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_id].dataType
    none = lambda t: F.lit(None).cast(t)
    texts = keyed.join(small(held), ["a", "b"]).dropDuplicates(["a", "b"])
    texts = texts.select("a", "b", F.col("id").alias("doc"), "text", none("long").alias("item"), none(item_kind).alias("name"), none("array<long>").alias("words"), none("long").alias("spread"), none("array<long>").alias("bins"))
    asked = found.join(own.select("item", F.col("id").alias("name"), "words", "spread"), "item")
    asked = asked.select("a", "b", none(kind).alias("doc"), none("string").alias("text"), "item", "name", "words", "spread", "bins")
    dealt = texts.unionAll(asked).repartition("a", "b").sortWithinPartitions("a", "b", F.col("item").asc_nulls_first())
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("doc_id", kind), T.StructField("item_id", item_kind), T.StructField("score", T.DoubleType())])
    out, _ = scratch.keep(dealt.mapInArrow(_aligned(schema, cut), schema))
    scratch.drop(spark, *tables)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cut: float = CUT) -> DataFrame:
    """(doc_id, item_id, score): every item that a row of docs holds, score as a part of the item's length.

    Whole texts are read. Null and empty texts and items hold nothing, nor does an empty table; a null id is an id like
    others, and ids can be of any type. Rows that repeat both id and text count once, items too. Of an item's windows the best score
    counts. Only the named columns are read, so the others' names cannot clash.
    """
    return _leaks(docs, items, id_col, text_col, item_id, item_text, cut).select("doc_id", "item_id", "score")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; what is a leak is as in find_leaks."""
    gone = _leaks(docs, items, id_col, text_col, item_id, item_text, cut)
    a, b = scratch.fresh(docs, "_a"), scratch.fresh(docs, "_b")
    gone = gone.select(F.col("a").alias(a), F.col("b").alias(b)).distinct()
    own = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(gone, (F.xxhash64(docs[id_col], own) == F.col(a)) & (F.xxhash64(F.lit("text"), own, docs[id_col]) == F.col(b)), "left_anti")
