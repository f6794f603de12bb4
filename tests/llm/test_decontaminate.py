"""Decontamination against the alignment of every text with every item."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from fathom.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"
RARE, COMMON = [f"w{i}" for i in range(4000)], [f"c{i}" for i in range(12)]


def plain_align(a, b):
    h = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if x == y else -0.5), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(deadline=None, max_examples=100)
@given(st.text("abcd", min_size=1, max_size=25), st.text("abcd", max_size=40))
def test_align(a, b):
    assert D.align(D.words(" ".join(a)), D.words(" ".join(b))) == plain_align(a, b)


def edited(words, kind, rate, rng):
    out = []
    for i, w in enumerate(words):
        if kind == "third" and i % 3 == 2:
            out.append(rng.choice(RARE))
        elif kind != "third" and rng.random() < rate:
            how = rng.choice("sid") if kind == "mixed" else "s"
            out += [rng.choice(RARE)] if how == "s" else [w, rng.choice(RARE)] if how == "i" else []
        else:
            out.append(w)
    return out


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: [rng.choice(RARE) if rng.random() < 0.5 else rng.choice(COMMON) for _ in range(n)]
    items = [(k, " ".join(rng.choice(RARE) if rng.random() < 0.7 else rng.choice(COMMON) for _ in range(rng.choice([2, 5, 8, 14, 20, 48, 60, 150])))) for k in range(50)]
    # the leak's only seeds are its common words
    items.append((999, " ".join(COMMON) + " " + " ".join(rng.choice(RARE) for _ in range(36))))
    docs = []
    for _, text in items:
        for kind, rate in (("s", 0), ("third", 0), ("s", 0.2), ("s", 0.3), ("mixed", 0.2), ("mixed", 0.3)):
            docs.append((len(docs), " ".join([*noise(60), *edited(text.split(), kind, rate, rng), *noise(40)])))
    probe = items[-1][1].split()
    docs.append((len(docs), " ".join(w if k < 12 or k % 3 else rng.choice(RARE) for k, w in enumerate(probe))))
    docs += [(len(docs) + k, " ".join(rng.choice(COMMON) for _ in range(150))) for k in range(60)]
    return docs, items


@pytest.mark.parametrize("joined", [False, True])
def test_no_alignment_is_lost(spark, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(D, "BROADCAST_BYTES", 0)
    docs, items = corpus(3)
    expected = {}
    own = {k: D.words(t) for k, t in items}
    for d, t in docs:
        for k, w in own.items():
            score = D.align(w, D.words(t))
            if score >= D.least_score(len(w)) - 1e-9:
                expected[d, k] = score / len(w)
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id): r.score for r in found.collect()} == expected and len(expected) > 200


def test_bound_by_brute_force():
    """The pairs of neighbours that every alignment of enough score shares: none has fewer than needed()."""
    rng = random.Random(1)
    for _ in range(4000):
        n = rng.randrange(3, 60)
        ops = [rng.choices("MXDI", [6, 2, 1, 1])[0] for _ in range(n * 2)]
        used, score, pairs, before, kept = 0, 0.0, 0, "", []
        for op in ops:
            if op != "I" and used == n:
                break
            used += op != "I"
            score += {"M": 1, "X": -0.5}.get(op, -1)
            pairs += op == before == "M"
            before = op
            kept.append((score, pairs))
        for s, p in kept:
            if s >= D.least_score(n):
                assert p >= D.needed(n), (n, s, p)


def test_tables(spark, odd):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    expected = set()
    for item in items.collect():
        a = plain(item.text)
        for d, t in texts.items():
            b = plain(t)
            # alignments of enough score hold runs of the item's words: only texts with several are aligned
            if len({w for w in b} & set(a)) >= 0.3 * len(set(a)) and D.align(D.words(item.text), D.words(t)) >= D.least_score(len(a)):
                expected.add((d, item.item_id))
    assert found == expected and found
    clean = D.clean(docs, items)
    assert {r.doc_id for r in clean.collect()} == texts.keys() - {d for d, _ in found} and clean.columns == docs.columns
    assert D.clean(odd, items).count() == odd.count() and D.clean(odd, items.limit(0)).count() == odd.count()
    assert D.find_leaks(docs.limit(0), items).collect() == []


def test_ids_repeats_and_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    changed = item.replace("delta", "DELTA!").replace("kappa", "changed words").replace("rho ", "")
    long = "filler words " * 150_000 + item + " more" * 50_000
    rows = [("a", "some text before " + changed + " and after"), ("a", "some text before " + changed + " and after"), ("b", "alpha beta is not the item"), (None, "well Hi there friend"), ("c", None), ("d", ""), ("e", long)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id string, text string, a int, item int, score int")
    items = spark.createDataFrame([("x", item), ("x", item), ("y", "hi there"), ("z", None), ("e", ""), (None, "friend")], "item_id string, text string").selectExpr("*", "1 AS item", "2 AS b")
    found = sorted(((r.doc_id or "", r.item_id or "") for r in D.find_leaks(docs, items).collect()))
    assert found == [("", ""), ("", "y"), ("a", "x"), ("e", "x")]
    clean = D.clean(docs, items)
    assert sorted(r.doc_id for r in clean.collect()) == ["b", "c", "d"] and clean.columns == docs.columns
    with pytest.raises(ValueError):
        D.find_leaks(docs, items, cut=0.2)
