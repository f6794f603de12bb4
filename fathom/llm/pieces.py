"""SentencePiece encoding and decoding with seeded merge-dropout.

A text's characters are symbols; candidate merges of neighbours wait in an agenda, best score first, leftmost first
among equals. Each candidate is skipped if a hash of the seed, the document's key, the word's number in the document, its
place and its two symbols falls below the dropout rate, so every occurrence of a word is drawn on its own, and the same
on every run; with a rate of 0 the result is the library's. A word's undropped segmentation is remembered with the
merges that it does, and serves the occurrences that skip none of these (a candidate that another merge makes void
before its turn is never asked); the others are segmented one by one. Words (with the spaces before them) cannot merge
with each other, so agendas are processed word by word: many words at once in numpy, very long ones by a heap.
Characters without a piece become bytes, so every segmentation decodes to the exact text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import scratch
from .shingles import mix

SPACE = "▁"
#: Dropout rate and seed.
RATE, SEED = 0.1, 1
#: Symbols from which a word is processed by a heap, and words in one numpy batch.
LONG_WORD, BATCH_WORDS = 192, 40_000
#: Words whose undropped segmentation a worker keeps.
KEPT_WORDS = 200_000
#: Rows of an Arrow batch that are encoded at once.
SLICE_ROWS = 128
_CHUNK = re.compile(" *[^ ]+| +")
_NONE = np.int64(1) << np.int64(62)
#: Bits of a candidate's order that hold its place.
_PLACE = (1 << 24) - 1


def _code(left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A candidate's part of its draw."""
    with np.errstate(over="ignore"):
        return mix((left << 32 | right).astype(np.uint64) + (place.astype(np.uint64) << np.uint64(52))) + place.astype(np.uint64)


def _skipped(key: np.ndarray, code: np.ndarray, rate: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(key + code) >> np.uint64(11)).astype(np.float64) / (1 << 53) < rate


class Kept:
    """Undropped segmentations of words: their ids, and the codes of the merges in them."""

    def __init__(self) -> None:
        # word 0 stands for words that are not kept
        self.number: dict[str, int] = {"": 0}
        self.used = self.code_used = 0
        self.flat, self.codes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.uint64)
        self.starts, self.counts, self.code_starts, self.code_counts = (np.zeros(1, np.int64) for _ in range(4))

    def add(self, ids: np.ndarray, n: np.ndarray, codes: np.ndarray, number: np.ndarray) -> None:
        self.starts, self.counts = np.append(self.starts, self.used + np.cumsum(n) - n), np.append(self.counts, n)
        self.code_starts, self.code_counts = np.append(self.code_starts, self.code_used + np.cumsum(number) - number), np.append(self.code_counts, number)
        self.flat, self.used = _appended(self.flat, self.used, ids)
        self.codes, self.code_used = _appended(self.codes, self.code_used, codes)


def _appended(into: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """into with more after its first `used` items, and how many are used now; it grows by doubling."""
    while len(into) < used + len(more):
        into = np.concatenate([into, np.zeros(len(into), into.dtype)])
    into[used : used + len(more)] = more
    return into, used + len(more)


class Pieces:
    """Merge tables of a BPE model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.strings = [model.id_to_piece(i) for i in range(self.size)]
        special = {i for i in range(self.size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.bytes = {i: int(s[3:5], 16) for i, s in enumerate(self.strings) if model.is_byte(i)}
        self.byte_id = np.zeros(256, np.int64)
        for i, value in self.bytes.items():
            self.byte_id[value] = i
        plain = {s: i for i, s in enumerate(self.strings) if i not in special and i not in self.bytes}
        if any(SPACE in s.lstrip(SPACE) for s in plain):
            raise ValueError("this model has pieces that reach over a word's start")
        # symbols: pieces by id, then characters without one, by code point
        self.symbol = np.arange(0x110000, dtype=np.int64) + self.size
        for s, i in plain.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.symbol[ord(" ")] = self.symbol[ord(SPACE)]
        self.symbol[ord(SPACE)] = ord(SPACE) + self.size
        merges = {}
        code = lambda s: plain[s] if s in plain else ord(s) + self.size if len(s) == 1 else -1
        for s, i in plain.items():
            for k in range(1, len(s)):
                a, b = code(s[:k]), code(s[k:])
                if a >= 0 and b >= 0:
                    merges[a << 32 | b] = i
        self.merges = merges
        rank = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-model.get_score(i), i)))}
        self.rank = np.zeros(self.size, np.int64)
        for i, r in rank.items():
            self.rank[i] = r
        keys = np.array(sorted(merges), np.int64)
        self._build(keys, np.array([merges[int(k)] for k in keys], np.int64))
        self._take_apart(plain)
        letters = set("".join(plain))
        self.mark = next(c for c in map(chr, range(1, 32)) if c not in letters)
        self.mark_id = int(self.byte_id[ord(self.mark)])
        self.kept = Kept()

    def _take_apart(self, plain: dict[str, int]) -> None:
        """Each piece's characters, and the merges that make it: wherever it comes out, these were done."""
        self.chars = np.zeros(self.size, np.int64)
        self.chars[list(plain.values())] = [len(s) for s in plain]
        # the first byte of a character counts for it
        self.chars[[i for i, value in self.bytes.items() if not 0x80 <= value < 0xC0]] = 1
        merged: list = []
        self.segment_many([s.replace(SPACE, " ") for s in plain], np.zeros(len(plain), np.uint64), 0, merged)
        word, *own = (np.concatenate(x) for x in zip(*merged))
        piece = np.array(list(plain.values()), np.int64)[word]
        order = np.argsort(piece, kind="stable")
        self.own = [x[order] for x in own]
        self.own_n = np.bincount(piece, minlength=self.size)
        self.own_start = np.cumsum(self.own_n) - self.own_n

    def _build(self, keys: np.ndarray, made: np.ndarray) -> None:
        """An open hash table of the merges; how many probes it needs."""
        self.slots = 1 << (4 * len(keys) - 1).bit_length()
        self.table, self.made = np.full(self.slots, -1, np.int64), np.full(self.slots, -1, np.int64)
        at, self.probes = self._slot(keys), 0
        while len(keys):
            free = self.table[at] < 0
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.table[at[put]], self.made[at[put]] = keys[put], made[put]
            keys, made, at = keys[~put], made[~put], (at[~put] + 1) % self.slots
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or -1."""
        keys = left << 32 | right
        at = self._slot(keys)
        seen = self.table[at]
        out = np.where(seen == keys, self.made[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % self.slots
            seen = self.table[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out

    def best(self, left: np.ndarray, right: np.ndarray, key: np.ndarray, place: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """The merged piece of each candidate and its order in the agenda; _NONE if there is none or it is skipped."""
        made = self.find(left, right)
        order = np.where(made >= 0, (self.rank[made] << 24) + place, _NONE)
        if rate > 0:
            order[_skipped(key, _code(left, right, place), rate)] = _NONE
        return made, order

    def segment_many(self, words: list[str], keys: np.ndarray, rate: float, merged: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after another, and how many each has. merged gets (word, left, right, place) of every merge done.

        Each round does the first merge of every word's agenda. A candidate's order holds its place in the word, so
        the least order of a word says where its symbol is; only the orders are scanned, the rest is linked.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        n = len(sym)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(n) - first[word]
        # n stands for no symbol
        sym, alive = np.append(sym, 0), np.ones(n + 1, bool)
        nxt, prev = np.arange(1, n + 2), np.arange(-1, n)
        ends, some = first + sizes, sizes > 0
        nxt[ends[some] - 1], prev[first[some]] = n, n
        made, order = np.full(n + 1, -1), np.full(n, _NONE)
        at = np.flatnonzero(nxt[:n] < n)
        made[at], order[at] = self.best(sym[at], sym[at + 1], keys[word[at]], place[at], rate)
        going = np.flatnonzero(sizes > 1)
        begin, held = first[going], len(going)
        while len(going):
            least = np.minimum.reduceat(order, begin)
            open_ = least < _NONE
            if not open_.all():
                # the orders of a word that is done are no candidates, so they can stay between those of others
                going, begin, least = going[open_], begin[open_], least[open_]
                if not len(going):
                    break
            left = first[going] + (least & _PLACE)
            right = nxt[left]
            if merged is not None:
                merged.append((going, sym[left], sym[right], place[left]))
            sym[left], alive[right] = made[left], False
            after, before = nxt[right], prev[left]
            nxt[left], prev[after] = after, left
            order[begin + place[left]] = _NONE
            order[begin + place[right]] = _NONE
            a, b = np.flatnonzero(after < n), np.flatnonzero(before < n)
            one = np.concatenate([left[a], before[b]])
            owner, base = np.concatenate([going[a], going[b]]), np.concatenate([begin[a], begin[b]])
            made[one], order[base + place[one]] = self.best(sym[one], sym[nxt[one]], keys[owner], place[one], rate)
            if 2 * len(going) < held:
                lengths = sizes[going]
                moved = np.cumsum(lengths) - lengths
                order = order[np.repeat(begin - moved, lengths) + np.arange(lengths.sum())]
                begin, held = moved, len(going)
        return sym[:n][alive[:n]], np.bincount(word[alive[:n]], minlength=len(words))

    def segment_long(self, word: str, key: np.uint64, rate: float) -> np.ndarray:
        """The same for one word, by a heap of candidates over linked symbols."""
        sym = self.symbol[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        keys = np.full(n, key)
        made, order = self.best(np.array(sym[:-1], np.int64), np.array(sym[1:], np.int64), keys[: n - 1], np.arange(n - 1), rate)
        heap = [(int(o), i, sym[i], sym[i + 1], int(m)) for i, (o, m) in enumerate(zip(order, made)) if o < _NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = nxt[i] if i < n and sym[i] == a else n
            if j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = piece, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n:
                    m, o = self.best(np.array([sym[k]]), np.array([sym[nxt[k]]]), keys[:1], np.array([k]), rate)
                    if o[0] < _NONE:
                        heapq.heappush(heap, (int(o[0]), k, sym[k], sym[nxt[k]], int(m[0])))
        return np.array([s for s in sym if s >= 0], np.int64)

    def with_bytes(self, sym: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece as the bytes of their UTF-8."""
        odd = np.flatnonzero(sym >= self.size)
        if not len(odd):
            return sym, counts
        coded = [chr(int(c) - self.size).encode() for c in sym[odd]]
        widths = np.ones(len(sym), np.int64)
        widths[odd] = [len(c) for c in coded]
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.repeat(sym, widths)
        ends = np.cumsum(widths)
        for k, c in zip(odd, coded):
            out[ends[k] - len(c) : ends[k]] = self.byte_id[list(c)]
        return out, np.bincount(owner, weights=widths, minlength=len(counts)).astype(np.int64)

    def segment(self, words: list[str], keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in some order, where each word's start in them, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        parts, starts, counts = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        short, at = np.flatnonzero(lengths < LONG_WORD), 0
        for k in range(0, len(short), BATCH_WORDS):
            some = short[k : k + BATCH_WORDS]
            sym, n = self.with_bytes(*self.segment_many([words[i] for i in some], keys[some], rate))
            parts.append(sym)
            starts[some], counts[some] = at + np.cumsum(n) - n, n
            at += len(sym)
        for i in np.flatnonzero(lengths >= LONG_WORD):
            sym = self.segment_long(words[i], keys[i], rate)
            sym, n = self.with_bytes(sym, np.array([len(sym)]))
            parts.append(sym)
            starts[i], counts[i] = at, n[0]
            at += len(sym)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), starts, counts

    def remember(self, words: list[str]) -> None:
        """Keep the undropped segmentations of words that are not kept yet, with the codes of all merges in them."""
        # the library does not tell U+2581 from a space
        plain = np.array([SPACE not in w and self.mark not in w for w in words], bool)
        n, ids = np.zeros(len(words), np.int64), []
        if plain.any():
            # one text, each word after a character that merges with nothing
            coded = np.asarray(self.library.encode(self.mark + self.mark.join([w for w, x in zip(words, plain) if x]), return_type="numpy"), np.int64)
            marks = np.flatnonzero(coded == self.mark_id)
            n[plain] = np.diff(marks, append=len(coded)) - 1
            ids.append(np.delete(coded, marks)[marks[0] :])
        start = np.zeros(len(words), np.int64)
        start[plain] = np.cumsum(n[plain]) - n[plain]
        odd = np.flatnonzero(~plain)
        if len(odd):
            flat, at, n[odd] = self.segment([words[i] for i in odd], np.zeros(len(odd), np.uint64), 0)
            start[odd] = at + (len(ids[0]) if ids else 0)
            ids.append(flat)
        ids = np.concatenate(ids)
        if len(odd):
            ids = ids[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
        ends = np.cumsum(self.chars[ids])
        offset = ends - self.chars[ids]
        offset -= np.repeat(np.concatenate([[0], ends])[np.cumsum(n) - n], n)
        many = self.own_n[ids]
        row = np.repeat(self.own_start[ids] - np.cumsum(many) + many, many) + np.arange(many.sum())
        codes = _code(self.own[0][row], self.own[1][row], self.own[2][row] + np.repeat(offset, many))
        number = np.bincount(np.repeat(np.arange(len(words)), n), weights=many, minlength=len(words)).astype(np.int64)
        self.kept.add(ids, n, codes, number)

    def encode_batch(self, texts: list[str], keys: list[int], rate: float = RATE, seed: int = SEED) -> list[np.ndarray]:
        """Ids of each text. keys: what makes the texts' segmentations vary, such as hashes of their ids."""
        if len(self.kept.number) > KEPT_WORDS:
            self.kept = Kept()
        kept, words, sizes, draws = self.kept, [], [], []
        for text, key in zip(texts, keys):
            own = _CHUNK.findall(" " + text) if text else []
            words += own
            sizes.append(len(own))
            with np.errstate(over="ignore"):
                draws.append(mix(np.arange(len(own), dtype=np.uint64) + mix(np.full(1, (key ^ seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1, np.uint64))))
        draw = np.concatenate(draws) if draws else np.zeros(0, np.uint64)
        found = list(map(kept.number.get, words))
        gaps = [i for i, x in enumerate(found) if x is None] if None in found else []
        if gaps:
            fresh = list(dict.fromkeys(words[i] for i in gaps if len(words[i]) < LONG_WORD))
            kept.number.update(zip(fresh, range(len(kept.counts), len(kept.counts) + len(fresh))))
            if fresh:
                self.remember(fresh)
            for i in gaps:
                found[i] = kept.number.get(words[i], 0)
        which = np.array(found, np.int64)
        starts, counts = kept.starts[which], kept.counts[which]
        # long words hardly ever pass whole
        varied = np.flatnonzero(which == 0)
        if rate > 0:
            varied = np.union1d(varied, self._varied(which, draw, kept, rate))
        flat = kept.flat[: kept.used]
        if len(varied):
            more, at, n = self.segment([words[i] for i in varied.tolist()], draw[varied], rate)
            starts[varied], counts[varied] = len(flat) + at, n
            flat = np.concatenate([flat, more])
        out, at = [], 0
        for size in sizes:
            n, first = counts[at : at + size], starts[at : at + size]
            ends = np.cumsum(n)
            out.append(flat[np.repeat(first - ends + n, n) + np.arange(ends[-1] if size else 0)])
            at += size
        return out

    @staticmethod
    def _varied(which: np.ndarray, draw: np.ndarray, kept: Kept, rate: float) -> np.ndarray:
        """The occurrences of which a merge is skipped that the kept segmentation does. which: each occurrence's word."""
        skip = np.zeros(len(which), bool)
        for k in range(0, len(which), BATCH_WORDS):
            some = which[k : k + BATCH_WORDS]
            n = kept.code_counts[some]
            owner = np.repeat(np.arange(len(some)), n)
            at = np.repeat(kept.code_starts[some] - np.cumsum(n) + n, n) + np.arange(len(owner))
            skip[k + owner[_skipped(draw[k : k + BATCH_WORDS][owner], kept.codes[at], rate)]] = True
        return np.flatnonzero(skip)

    def decode(self, ids) -> str:
        """The text that any segmentation came from."""
        out = bytearray()
        for i in ids:
            out += bytes((self.bytes[i],)) if i in self.bytes else self.strings[i].replace(SPACE, " ").encode()
        return out.decode()[1:]


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(df: DataFrame, path: str, rate: float = RATE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "piece_ids", count_col: str = "n_pieces") -> DataFrame:
    """The rows of df without text_col, with the text's piece ids and their number.

    path is the model file, which every worker can open. Null and empty texts have no pieces. Texts of any length are
    encoded whole. Rows that repeat id and text get the same pieces. Columns of df named like a new one are replaced.
    """

    kept = [c for c in df.columns if c.lower() not in {text_col.lower(), ids_col.lower(), count_col.lower()}]
    own = df.select(*[df[c] for c in kept], df[id_col].cast("string").alias(scratch.fresh(df, "_key")), F.coalesce(df[text_col], F.lit("")).alias(scratch.fresh(df, "_piece_text")))
    schema = T.StructType([*own.schema[: len(kept)], T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(count_col, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            # a slice's pieces leave the worker before the next slice is encoded
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                keys = [int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest(), "big") for i in part.column(len(kept)).to_pylist()]
                coded = own.encode_batch(part.column(len(kept) + 1).to_pylist(), keys, rate, seed)
                counts = np.array([len(x) for x in coded], np.int32)
                flat = pa.array(np.concatenate(coded).astype(np.int32))
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], ids, pa.array(counts)], [*kept, ids_col, count_col])
        # a worker lives on after its task, and what it keeps would stay beside what comes next
        own.kept = Kept()

    return own.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "piece_ids", text_col: str = "text") -> DataFrame:
    """df with the text that its piece ids came from; null for null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            k = batch.schema.get_field_index(ids_col)
            texts = [None if x.as_py() is None else own.decode(x.as_py()) for x in batch.column(k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    kept = df.drop(text_col)
    return kept.mapInArrow(run, T.StructType([*kept.schema, T.StructField(text_col, T.StringType())]))
