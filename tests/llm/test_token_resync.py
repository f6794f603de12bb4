"""Counts of chunked texts against the libraries on whole ones, for each kind of tokenizer file."""

import json
import random

import pytest
from hypothesis import given, settings, strategies as st

from fathom.llm import token_counts as T
from fathom.llm.queries import tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]
ALPHABET = st.sampled_from(
    list("abcABC'st 12.!\n\t") + ["th", "ing", "'ve", "é", "é", "̣", "Σ", "İ", "ß", "中", "文字", "😀", "ᄀ", "ᅡ", "ᆨ", "\x1c", "\x85", "\xa0", "▁", "<|endoftext|>", "<|", "endoftext", "|>", "don't", "  ", "   \n"]
)


def library(name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(own.encode(text))
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: len(own.encode(text, add_special_tokens=False))


LIBRARIES = {name: library(name) for name in FILES}


@settings(deadline=None, max_examples=400)
@given(st.lists(ALPHABET, max_size=160).map("".join), st.integers(8, 70), st.integers(1, 40), st.sampled_from(FILES))
def test_any_text(text, chunk, overlap, name):
    codec = T.codec(tokenizer_path(name))
    assert codec.local
    expected = LIBRARIES[name](text)
    assert T.count_text(codec, text) == expected
    assert T.count_text(codec, text, chunk, overlap) == expected


@pytest.mark.parametrize("name", FILES)
def test_texts_without_white_space(name):
    rng = random.Random(5)
    codec = T.codec(tokenizer_path(name))
    for kind in ("thequickbrown", "y", "中文字符", "ab1", "-=", " "):
        text = "".join(rng.choice(kind) for _ in range(6000))
        seen = []
        assert T.count_text(codec, text, 900, 64, seen) == LIBRARIES[name](text)
        # chunks stay small though no word ends in them; runs of spaces are cut into pieces from where a chunk begins
        assert len(seen) > 5 and (max(b - a for a, b in seen) < 6000 or (kind == " " and name.startswith("piece"))), kind


def test_chunks_overlap_and_widen():
    codec = T.codec(tokenizer_path("word_bpe_49k.json"))
    text = "ab cd " * 200
    seen = []
    assert T.count_text(codec, text, 300, 30, seen) == LIBRARIES["word_bpe_49k.json"](text)
    assert seen[0] == (0, 300) and all(c[0] < p[1] for p, c in zip(seen, seen[1:])) and seen[-1][1] == len(text)
    # words as long as the overlap leave nothing in common at first
    text = ("x1" * 3 + "internationalisation" * 4 + " ") * 40
    seen = []
    assert T.count_text(codec, text, 300, 12, seen) == LIBRARIES["word_bpe_49k.json"](text)
    tried = {}
    for start, end in seen:
        tried.setdefault(end, []).append(start)
    assert any(len(set(s)) > 1 for s in tried.values()), "no overlap was widened"


def test_unknown_parts_are_not_taken_for_local(tmp_path):
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    changes = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "Strip", "strip_left": True, "strip_right": True}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "(?<=a) "}, "behavior": "Isolated", "invert": False}]},
        "added_tokens": [spec["added_tokens"][0] | {"lstrip": True}],
    }
    for k, (part, change) in enumerate(changes.items()):
        path = f"{tmp_path}/{k}.json"
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec | {part: change}, f)
        codec = T.codec(path)
        assert not codec.local and not codec.by_word
        text = " a <|startoftext|> b c" * 30
        assert T.count_text(codec, text, 50, 8) == len(codec.tokenizer.encode(text, add_special_tokens=False))


def test_other_kinds_of_files(spark, odd):
    rows = {r.doc_id: r.text or "" for r in odd.collect()}
    for name in FILES[1:]:
        for r in T.token_counts(odd, tokenizer_path(name), chunk=5000, overlap=100).collect():
            assert r.n_tokens == LIBRARIES[name](rows[r.doc_id])
