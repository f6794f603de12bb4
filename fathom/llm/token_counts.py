"""Token counts by overlap resynchronisation.

A huge text is encoded by the library in overlapping chunks, with offsets. Two neighbouring chunks are spliced at a
boundary that both have in their overlap and that is proven to be one of the whole text:

* a word start of both. Words are found by scanning from left to right without looking back, so chunks that once
  start a word at the same place agree on all that follows; what the earlier chunk says is right up to a margin before
  its end, where it cannot see what comes.
* white space that has no tokens, all over the overlap.
* inside a word that spans the whole overlap, a token that both have. Merges happen by rank and then from the left, so
  any run of neighbouring tokens is the encoding of its own characters, and two such runs that share a token make one.

If there is neither, the overlap is widened, first back to the chunk's start, then by encoding chunk and successor as
one. Chunks begin where normalisation cannot reach back. All this is checked against the tokenizer's file: with parts
that are not known to be local, texts are encoded in one piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Characters from which a text is huge, which are also a chunk's, and of the overlap of neighbouring chunks.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Words whose counts a worker keeps, and the longest word that it keeps.
KEPT_WORDS, KEPT_CHARS = 1_000_000, 64
#: Characters of short texts that the library gets at once.
BATCH_CHARS = 1 << 20
#: White space that str.split, the normaliser and the pre-tokenizer all take as a boundary.
STABLE = re.compile("[ \t\n\r\x0b\x0c]+")
#: Characters that str.split takes as white space and the pre-tokenizer does not.
UNSTABLE = re.compile("[\x1c-\x1f]")
#: Least characters before a chunk's end in which no boundary of it is trusted.
MARGIN = 8

# Parts of tokenizer files whose work on a character depends on few neighbours only. The split pattern
# drops white space and takes runs of letters, single digits and runs of the rest; it looks ahead by three characters.
LOCAL_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
WHITE_RUNS = {"Regex": "\\s+"}
WORDS_ONLY = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


@dataclass(frozen=True)
class Chunk:
    """Tokens of a part of a text: their places in the whole text, ids, and whether they start a word."""

    start: int
    begins: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    first: np.ndarray

    def words(self, low: int, stop: int) -> np.ndarray:
        """Tokens that start a word after low and up to stop, and share no character with the word before."""
        apart = np.concatenate([[True], self.ends[:-1] <= self.begins[1:]])[: len(self.ids)]
        return np.flatnonzero(self.first & apart & (self.begins > low) & (self.begins <= stop))

    def clean(self, low: int, stop: int) -> np.ndarray:
        """Inner tokens after low and up to stop that begin where a character does; what they hold is known by their id."""
        own = np.zeros(len(self.ids), bool)
        own[1:-1] = (self.begins[1:-1] > low) & (self.ends[1:-1] <= stop) & (self.begins[1:-1] < self.ends[1:-1])
        own[1:-1] &= (self.ends[:-2] <= self.begins[1:-1]) & (self.ids[1:-1] >= 0)
        return np.flatnonzero(own)


def _all_local(part: dict | None, known) -> bool:
    if part is None:
        return True
    if part["type"] == "Sequence":
        return all(known(x) for x in part.get("normalizers") or part.get("pretokenizers"))
    return known(part)


class JsonCodec:
    """A tokenizer of the library for .json files, without added special tokens, truncation or padding."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = spec.get("added_tokens") or []
        merging = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("continuing_subword_prefix")
        alone = not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        plain = _all_local(spec["normalizer"], lambda x: x["type"] in LOCAL_NORMALIZERS or (x["type"] == "Replace" and x["pattern"] == WHITE_RUNS and x["content"] == " "))
        split = spec["pre_tokenizer"]
        parts = split["pretokenizers"] if split and split["type"] == "Sequence" else [split] if split else []
        last = bool(parts) and parts[-1]["type"] == "ByteLevel" and not parts[-1]["add_prefix_space"]
        dropping = last and len(parts) == 2 and parts[0]["type"] == "Split" and parts[0]["pattern"] == WORDS_ONLY and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["use_regex"]
        keeping = last and len(parts) == 1 and parts[0]["use_regex"]
        self.local = merging and alone and plain and (dropping or keeping)
        #: No token is of two words with white space between them, so that a word's count is its own.
        self.by_word = self.local and dropping and not any(re.search(r"\s", t["content"]) for t in added)
        self.lower = self.by_word and any(x["type"] == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", [spec["normalizer"] or {"type": ""}]))
        self.specials = [t["content"] for t in added]
        self.margin = max([MARGIN, *(len(t) + 2 for t in self.specials)])
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        if self.by_word:
            return [self._by_word(t) for t in texts]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0])

    def chunk(self, text: str, start: int, end: int) -> Chunk:
        own = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        places = np.array(own.offsets, np.int64).reshape(-1, 2) + start
        words = np.array([-1 if w is None else w for w in own.word_ids], np.int64)
        return Chunk(start, places[:, 0], places[:, 1], np.array(own.ids, np.int64), (np.diff(words, prepend=-2) != 0) | (words < 0))

    def inside(self, a: Chunk, b: Chunk, low: int, stop: int) -> bool:
        """Whether one word covers the overlap; it is then one run of a kind, which both see alike."""
        return not any(((x.first & (x.begins > low) & (x.begins <= stop)).any()) for x in (a, b)) and bool(len(b.begins)) and b.begins[0] == low

    def _by_word(self, text: str) -> int:
        words, known = self._words(text), self.known
        new = list({w for w in words if w not in known})
        if not new:
            return sum(map(known.__getitem__, words))
        counts = dict(zip(new, (len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        total = sum(counts[w] if w in counts else known[w] for w in words)
        if len(known) + len(new) > KEPT_WORDS:
            known.clear()
        known.update((w, n) for w, n in counts.items() if len(w) <= KEPT_CHARS)
        return total

    def _words(self, text: str) -> list[str]:
        """Runs without ASCII white space; in lower case where the tokenizer makes it so and no special token can be inside."""
        if UNSTABLE.search(text):
            return STABLE.split(text)
        return (text.lower() if self.lower and text.isascii() and not any(s in text for s in self.specials) else text).split()


class PieceCodec:
    """A BPE model of the library for .model files."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        norm = spec.normalizer_spec
        self.local = spec.trainer_spec.model_type == proto.TrainerSpec.BPE and norm.name == "identity" and not norm.remove_extra_whitespaces
        kind = proto.ModelProto.SentencePiece.Type
        self.margin = max([MARGIN, *(len(p.piece) + 2 for p in spec.pieces if p.type == kind.USER_DEFINED)])
        self.odd = np.array([p.type != kind.NORMAL for p in spec.pieces])

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def chunk(self, text: str, start: int, end: int) -> Chunk:
        part = text[start:end]
        own = self.model.encode(part, return_type="proto").pieces
        # offsets are of bytes
        points = np.frombuffer(part.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        begins, ends = (np.searchsorted(at, np.array([getattr(p, x) for p in own], np.int64)) + start for x in ("begin", "end"))
        ids = np.array([p.id for p in own], np.int64)
        return Chunk(start, begins, ends, np.where(self.odd[ids], -1, ids), np.zeros(len(ids), bool))

    def inside(self, a: Chunk, b: Chunk, low: int, stop: int) -> bool:
        return True


_codecs: dict[str, JsonCodec | PieceCodec] = {}


def codec(path: str) -> JsonCodec | PieceCodec:
    """The tokenizer of a file, by its ending."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path) if path.endswith(".model") else JsonCodec(path)
    return _codecs[path]


def _joins_back(char: str) -> bool:
    """Whether normalisation can join a character to the one before it: marks, and vowels and finals of Hangul."""
    return unicodedata.category(char)[0] == "M" or "ᅠ" <= char <= "ᇿ" or "ힰ" <= char <= "퟿"


def splice(own: JsonCodec | PieceCodec, a: Chunk, b: Chunk, a_end: int) -> tuple[int, int] | None:
    """(i, j): the whole text's tokens are a's before i and b's from j on; None if that cannot be proven anywhere."""
    low, stop = b.start, a_end - own.margin
    i, j = (x.words(low, stop) for x in (a, b))
    both, x, y = np.intersect1d(a.begins[i], b.begins[j], return_indices=True)
    if len(both):
        return int(i[x[-1]]), int(j[y[-1]])
    if low < stop and not ((a.ends > low) & (a.begins <= stop)).any() and not (b.begins <= stop).any():
        # white space that has no tokens
        return int((a.ends <= low).sum()), 0
    if not own.inside(a, b, low, stop):
        return None
    i, j = a.clean(low, stop), b.clean(low, stop)
    # a place has one clean token at most, so places can be matched and the rest compared
    both, x, y = np.intersect1d(a.begins[i], b.begins[j], return_indices=True)
    i, j = i[x], j[y]
    same = np.flatnonzero((a.ids[i] == b.ids[j]) & (a.ends[i] == b.ends[j]))
    return (int(i[same[-1]]), int(j[same[-1]])) if len(same) else None


def count_text(own: JsonCodec | PieceCodec, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, seen: list | None = None) -> int:
    """Tokens of the whole text; equal to encoding it in one piece. seen, if given, gets (start, end) of every chunk encoded."""

    def encode(start: int, end: int) -> Chunk:
        if seen is not None:
            seen.append((start, end))
        return own.chunk(text, start, end)

    n = len(text)
    if n <= chunk:
        return own.counts([text])[0]
    if not own.local:
        return own.whole(text)
    total, end, size = 0, min(n, chunk), chunk
    now, begin = encode(0, end), 0
    while end < n:
        back, found = overlap, None
        while found is None and back < 2 * (end - now.start):
            low = max(end - back, now.start + 1)
            while low > now.start + 1 and _joins_back(text[low]):
                low -= 1
            if _joins_back(text[low]):
                break
            new_end = min(n, end + size)
            after = encode(low, new_end)
            found = splice(own, now, after, end)
            back *= 2
        if found is not None:
            total += found[0] - begin
            now, begin, end, size = after, found[1], new_end, chunk
            continue
        # nothing in the whole chunk: it goes on to where its successor would end, if it still has the token it was spliced at
        size *= 2
        end = min(n, end + size)
        longer = encode(now.start, end)
        if begin:
            key = lambda c, k: (c.begins[k], c.ends[k], c.ids[k], c.first[k])
            again = [k for k in np.flatnonzero(longer.begins == now.begins[begin]) if key(longer, k) == key(now, begin)] if begin < len(now.begins) else []
            if not again:
                return own.whole(text)
            begin = int(again[0])
        now = longer
    return total + len(now.ids) - begin


def token_counts(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of df: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path is a tokenizer's .json or .model file, which every worker can open. Null and empty texts have 0 bytes and
    tokens; a text of any length is read whole, chunk by chunk. An empty table gives an empty one; rows that repeat an
    id or a text are counted each, in no order; other columns are ignored, so their names cannot clash.
    """
    own = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            counts = np.zeros(batch.num_rows, np.int64)
            group: list[tuple[int, str]] = []
            held = 0
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                if len(text) > chunk:
                    counts[k] = count_text(tokenizer, text, chunk, overlap)
                    continue
                group.append((k, text))
                held += len(text)
                if held >= BATCH_CHARS:
                    counts[[i for i, _ in group]] = tokenizer.counts([t for _, t in group])
                    group, held = [], 0
            if group:
                counts[[i for i, _ in group]] = tokenizer.counts([t for _, t in group])
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
