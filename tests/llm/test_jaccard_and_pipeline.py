import itertools
import random
import re

import numpy as np
import pytest

from fathom.llm import jaccard_join as J
from fathom.llm.components import components

SCHEMA = "doc_id long, text string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return sorted((i, len(s), top(i)) for i, s in sets)


def near_copies(seed, families, most):
    """Families of edited copies whose similarities lie around the threshold, and texts that share a passage only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 20, 80, 150, 400]))]
        for _ in range(rng.randrange(1, most)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 20))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append(" ".join(own))
    rows += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 100))) for _ in range(40)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width, percent, seed, most", [(4, 85, 1, 40), (5, 80, 2, 12), (3, 60, 3, 12)])
def test_components_equal_brute_force(spark, width, percent, seed, most):
    rows = near_copies(seed, 8, most)
    got = sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, SCHEMA), width, percent).collect())
    assert got == brute(rows, width, percent)


def test_small_blocks_and_ranks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    monkeypatch.setattr(J, "FIRST_RANKS", 1)
    monkeypatch.setattr(J, "PAIRS_UP_TO", 2)
    monkeypatch.setattr(J, "HUB_ROWS", 3)
    rows = near_copies(7, 3, 50)
    got = sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect())
    assert got == brute(rows, 4, 85)


def test_odd_rows(spark, odd):
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in J.jaccard_components(odd, 4, 85).collect()))
    assert got == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (8, 8)]
    kept = J.one_of_each(odd, 4, 85)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7, 8] and kept.columns == odd.columns
    assert J.jaccard_components(odd.limit(0)).collect() == []


def test_linked_sets_share_a_part():
    """The guarantee itself: any two linked sets emit a common key."""
    rng = np.random.default_rng(1)
    for _ in range(400):
        percent = int(rng.choice([60, 80, 85, 95]))
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 400)), dtype=np.uint64))
        apart = J.most_apart(2 * len(a), percent)
        drop = int(rng.integers(0, apart + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop // 2 :], rng.integers(0, 1 << 63, drop - drop // 2, dtype=np.uint64)]))
        if len(b) and J.linked(a, b, percent) and not np.array_equal(a, b):
            assert np.intersect1d(J.part_keys(a, percent), J.part_keys(b, percent)).size
            bits = np.unpackbits(np.frombuffer(J.folded(a), np.uint8) ^ np.frombuffer(J.folded(b), np.uint8)).sum()
            assert bits <= J.most_apart(len(a) + len(b), percent)


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(5, 5), (400, 401), (401, 400)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == top(x) for x in root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def without_lines(texts, hosts):
    """Texts without the lines that more than 1% of a host's pages hold, five at least; near copies are one page."""
    page = {i: c if n else ("empty", i and texts[i]) for i, n, c in brute(sorted(texts.items()), 5, 80)}
    bare = lambda line: line.strip(" \t\r")
    pages, holding = {}, {}
    for i, text in texts.items():
        pages.setdefault(hosts[i], set()).add(page[i])
        for line in {bare(x) for x in text.split("\n")} - {""}:
            holding.setdefault((hosts[i], line), set()).add(page[i])
    gone = {k for k, v in holding.items() if len(v) >= 5 and len(v) > 0.01 * len(pages[k[0]])}
    return {i: "\n".join(x for x in t.split("\n") if not bare(x) or (hosts[i], bare(x)) not in gone) for i, t in texts.items()}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from fathom.llm import decontaminate, pieces, quality
    from fathom.llm.queries import tokenizer_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert after.keys() <= before.keys()
        if k == 0:
            kept = [labels[i] for i in after if i in labels]
            assert sum(kept) / len(kept) > 0.95
            model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
            assert after == {i: t for i, t in before.items() if model.score(t) >= 0.3}
            hosts = {r.doc_id: (r.source, r.lang) for r in docs.collect()}
        if k == 1:
            assert after == without_lines(before, hosts)
        if k == 2:
            groups = brute(sorted(before.items()), 5, 80)
            assert after.keys() == {c for _, _, c in groups}
        if k == 3:
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            leaks = {r.doc_id for r in decontaminate.find_leaks(spark.read.parquet(f"{tmp_path}/2"), items).collect()}
            assert leaks and after.keys() == before.keys() - leaks
    back = {r.doc_id: r.text for r in pieces.decode(docs, tokenizer_path(P.PIECE_MODEL)).collect()}
    assert back == before and P.run(spark, sf).count() == len(back)


def test_hot_keys_and_split_joins_change_nothing(spark, monkeypatch):
    from fathom.llm import scratch

    monkeypatch.setattr(J, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(J, "HOT_LEAST", 4)
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(J, "FEATURE_KEYS", 50)
    rows = near_copies(9, 4, 40)
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    got = sorted(tuple(r) for r in J.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect())
    assert got == brute(rows, 4, 85)
    left = spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(120)], "k int, v int")
    table, _ = scratch.keep(left.groupBy("k").count())
    joined = scratch.join_split(left, table, ["k"], "count", 120, "v", "left")
    assert joined.columns == ["k", "v", "count"] and sorted(map(tuple, joined.collect())) == sorted((k, v, 30 if v < 90 else 1) for k, v in map(tuple, left.collect()))


def test_ids_must_be_integers(spark):
    with pytest.raises(ValueError):
        J.jaccard_components(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_copies_go_without_a_shuffle_of_texts(spark, monkeypatch):
    import corpus_pipeline as P

    rows = near_copies(11, 4, 20)
    groups = brute(rows, 5, 80)
    df = spark.createDataFrame([(i, f"line {i % 9}\n{t}", "h", "en", 0) for i, t in rows], "doc_id long, text string, source string, lang string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for small in (True, False):
            if not small:
                monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
                monkeypatch.setattr(J, "PAIR_BYTES", 0)
            kept = J.one_of_each(spark.createDataFrame(rows, SCHEMA), 5, 80)
            lines = P.without_boilerplate(spark, df, "")
            assert {r.doc_id for r in kept.collect()} == {c for _, _, c in groups}
            assert {r.doc_id: r.text for r in lines.collect()} == without_lines({r.doc_id: r.text for r in df.collect()}, {i: "h" for i, _ in rows})
            plans = [x._jdf.queryExecution().executedPlan().toString() for x in (kept, lines)]
            assert ["SortMergeJoin" in x for x in plans] == [not small, False]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
