import hashlib
import html
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fathom.llm import html_text, line_dedup, pieces, quality, secret_scan, token_counts
from fathom.llm.queries import QUERIES, tokenizer_path

DATA = "/root/testdata/sf0.001"


# --- secrets


def brute_base(text):
    found = []
    for kind, pattern, group, least, flags in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0, 18, 0),
        ("hex", r"[0-9a-f]+", 0, 16, 0),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    order = ["assign", "access", "hex"]
    return [(k, a, b) for a, k, b in sorted(found, key=lambda x: (x[0], order.index(x[1])))]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["password", "API_KEY", "token", "secret ", ": ", "=", '"', "'", " ", "AKIA", "ABCDEFGH12", "deadbeef", "0123456789abcdef", "é", "\n", "x", "ſ"]), max_size=25).map("".join))
def test_base_spans(text):
    assert secret_scan.base_spans(text) is not None
    assert secret_scan.scan(text)[0] == brute_base(text)


def test_redaction():
    assert "Zx81" not in secret_scan.redact("password = 'Zx81kaPq99LmW0t3'")


def test_secret_query(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op5_secret_scan"](spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" for r in rows)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in QUERIES["op5_secret_scan"](spark, DATA).collect():
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert all(f"{k}:{a}:{b}" in r.spans.split(",") for k, a, b in base)


# --- token counts


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_token_query(spark, odd, tokenizer):
    rows = token_counts.token_counts(odd, tokenizer_path("word_bpe_49k.json")).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect()]
    expected = [(i, len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False)), n > 2048) for i, t in texts]
    assert sorted(map(tuple, rows), key=repr) == sorted(expected, key=repr)
    assert token_counts.token_counts(odd.limit(0), tokenizer_path("word_bpe_49k.json")).collect() == []


# --- pages


def test_pages_against_their_articles(spark):
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert html_text.main_text(p.html) == "\n\n".join(b for b in blocks if b)


def test_chrome_goes_and_short_blocks_stay():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, accept all of them</div><nav><a>x</a></nav>
    <main><article class="post"><header><h1>Title &eacute;</h1></header><p>One  two<br>three <b>bold</b>.</p><ul><li>item a<li>item b</ul><aside>Related</aside><form><label>Mail</label><input></form>
    <div class="ad">Buy</div><p>Last.</p><script>var t="</p>";</script><section class="comments"><article><p>A reader comment that is longer than all else on the page, so that its weight would win alone</p></article></section></article></main>
    <div class="sidebar"><p>side</p></div><footer>foot</footer></body></html>"""
    assert html_text.main_text(page) == "Title é\n\nOne two three bold.\n\nitem a\n\nitem b\n\nLast."
    assert html_text.main_text("<div class='menu'>x</div><div><p>Some text of the page.</p><p>ok</p></div><div class=footer>f</div>") == "Some text of the page.\n\nok"
    assert [html_text.main_text(x) for x in (None, "", "<nav>a</nav>", "plain", "<p>a &lt;b", "<p hidden>x</p>")] == ["", "", "", "plain", "a <b", ""]


def test_classes_of_layout_and_of_comments():
    page = "<body class='has-sidebar'><div class='page with-sidebar'><div class='banner-layout'><article><div class='entry-header'><h1>T</h1></div><p>Text one.</p><div class='comments'><article><p>no</p></article></div></article></div></div></body>"
    assert html_text.main_text(page) == "T\n\nText one."
    assert html_text.main_text("<div id=top-menu>m</div><div class='cookieNotice'>c</div><section class='post-body'><p>One.</p></section><div class='comment-list'><p>c1</p></div>") == "One."


def test_pages_query(spark, tmp_path):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (2, None, "", 1), (None, "v", "<p>é" + " x" * 100_000, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text int").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.n_chars) for r in QUERIES["op3_html_text"](spark, str(tmp_path)).collect()))
    assert got == [(0, 200_001), (1, 0), (1, 0), (2, 0)]


# --- quality


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = QUERIES["op1_quality"](spark, d).collect()
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and len(judged) > 40 and sum(a == b for a, b in judged) / len(judged) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, none)
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(abs(r.score - 0.5) < 0.5 for r in rows)
    assert quality.keep_good(odd, model).columns == odd.columns and quality.score(odd.limit(0), model).collect() == []
    repeated = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.fit(odd, repeated).bias > 0


def plain_features(text):
    """Every n-gram of bytes inside a word and its borders, every word, every repetition, one by one."""
    data = [0x20 if b in b" \t\n\r\x0b\x0c" else b for b in b" " + text + b" "]
    found = []
    for n in quality.NGRAMS:
        for i in range(len(data) - n + 1):
            gram = data[i : i + n]
            if 0x20 in gram[1:-1] or (n == 2 and gram == [0x20, 0x20]):
                continue
            h = 0
            for b in gram:
                h = (h * 0x100000001B3 + b + 1) % 2**64
            found.append((h * 0x9E3779B97F4A7C15) % 2**64 >> (65 - quality.BUCKETS.bit_length()))
    words = [w.lower() for w in re.findall(rb"[^ \t-\r]+", text)]
    found += [int(quality._bucket(quality.word_hashes(w))[0]) for w in words]
    return found + [quality.REPEATED] * (quality.REPEAT_WEIGHT * sum(a == b for a, b in zip(words, words[1:])))


def test_quality_scores_equal_plain_ones(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").limit(25).collect()] + [(-1, ""), (-2, "a a  a\n\nB b")]
    scores = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        found = plain_features(text.encode())
        logit = model.bias + sum(float(model.gain[k]) for k in found) / (len(found) + quality.PRIOR)
        assert math.isclose(scores[i], 1 / (1 + math.exp(-logit)), rel_tol=1e-6), i


def test_quality_pieces():
    """Pieces change no feature, in words without a space neither."""
    from collections import Counter

    for text in (b"ab cd ab ab " * 50, b"x" * 300, b"", "é ñandú, ".encode() * 40, b"a  b\t\n c c c"):
        counts = [Counter(np.concatenate(list(quality.features(text, piece))).tolist()) for piece in (1, 7, 40, 1 << 20)]
        assert all(c == counts[0] for c in counts)


# --- lines


def brute_lines(rows, ratio, least):
    hosts = {}
    for _, t, h in rows:
        hosts.setdefault(h, set()).add(t or "")
    common = {}
    for h, texts in hosts.items():
        count = {}
        for t in texts:
            for line in {x.strip(" \t\r") for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        common[h] = {line for line, n in count.items() if n >= least and n > ratio * len(texts)}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" \t\r") or x.strip(" \t\r") not in common[h]), h) for i, t, h in rows]


def test_line_dedup(spark, odd):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["menu", " menu ", "own %d" % rng.randrange(60), "", "about us"]) for _ in range(5)), rng.choice(["h1", "h2", None])) for i in range(120)]
    rows += rows[:10] + [(500, None, "h1"), (501, "", "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in line_dedup.drop_boilerplate(df, ratio=0.3, least_pages=3).collect()]
    assert sorted(got, key=repr) == sorted(brute_lines(rows, 0.3, 3), key=repr)
    out = line_dedup.drop_boilerplate(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and line_dedup.drop_boilerplate(odd.limit(0)).collect() == []


def test_line_dedup_by_language(spark):
    import corpus_pipeline

    # 2% of the French pages hold the line, 1% of all
    rows = [(i, f"own {i}\n" + ("tous droits" if i % 100 == 1 else f"more {i}"), "h", "fr" if i % 2 else "en", 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert len(out) == 1000 and all(out[i].text == (f"own {i}" if i % 100 == 1 else t) for i, t, *_ in rows)
    assert all(r.n_chars == len(r.text) for r in out.values())
    gone = line_dedup.drop_boilerplate(df.withColumn("lang", F.lit(None).cast("string")).unionAll(df), ratio=0.015, lang_col="lang")
    assert gone.where("text LIKE '%tous droits'").count() == 10 and gone.count() == 2000


def test_line_dedup_counts_near_copies_once(spark):
    import corpus_pipeline

    body = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(12))
    rows = [(i, f"{body}\nedited by {i}", "h", "en", 0) for i in range(8)] + [(100 + i, f"own{i} text{i} of{i} this{i} page{i}\nall rights reserved", "h", "en", 0) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    out = corpus_pipeline.without_boilerplate(spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id: r.text for r in out.collect()} == {i: t if i < 100 else t.split("\n")[0] for i, t, *_ in rows}


# --- pieces


@pytest.fixture(scope="module")
def model():
    return pieces.model(tokenizer_path("piece_bpe_32k.model"))


@settings(deadline=None, max_examples=200)
@given(st.lists(st.sampled_from(list("abcdeth  \n\t.") + ["the", "ing", "é", "中", "😀", "▁", "\x00"]), max_size=80).map("".join), st.sampled_from([0.0, 0.1, 0.5, 1.0]), st.integers(0, 9))
def test_pieces_round_trip(model, text, rate, key):
    ids = model.encode_batch([text], [key], rate)[0].tolist()
    assert model.decode(ids) == text and ids == model.encode_batch(["other", text], [1, key], rate)[1].tolist()


def test_pieces_equal_the_library_without_dropout(model, spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()] + ["", " ", "  a  b ", "x" * 400, "0123456789abcdef" * 40, "é中😀"]
    for text, ids in zip(texts, model.encode_batch(texts, [0] * len(texts), 0.0)):
        assert ids.tolist() == own.encode(text)


def test_heap_and_batches_agree(model):
    import numpy as np

    rng = random.Random(2)
    for _ in range(30):
        word = "".join(rng.choice("theingraston") for _ in range(rng.randrange(1, 150)))
        for rate in (0.0, 0.3):
            key = np.array([rng.getrandbits(63)], np.uint64)
            assert model.segment_many([word], key, rate)[0].tolist() == model.segment_long(word, key[0], rate).tolist()


def test_pieces_vary_and_decode(spark, odd):
    path = tokenizer_path("piece_bpe_32k.model")
    out = pieces.encode(odd, path)
    back = pieces.decode(out, path)
    expected = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.text) for r in back.select("doc_id", "text").collect()), key=repr) == expected
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, other = (pieces.encode(docs, path, seed=s).select("doc_id", "piece_ids").orderBy("doc_id").collect() for s in (1, 2))
    assert sum(a != b for a, b in zip(one, other)) > 0.9 * len(one)
    assert pieces.encode(odd.limit(0), path).collect() == []


def test_dropout_is_drawn_for_every_occurrence(model):
    assert [len(x) for x in model.encode_batch(["a"], [0], rate=0)] == [1]
    many = [len(x) - 1 for x in model.encode_batch(["a"] * 5000, list(range(5000)))]
    assert set(many) == {0, 1} and abs(sum(many) / 5000 - pieces.RATE) < 0.02
    assert abs(len(model.encode_batch([" ".join("a" * 5000)], [7])[0]) / 5000 - 1 - pieces.RATE) < 0.02
    one, other = ({tuple(x) for x in model.encode_batch(["internationally"] * 3000, list(range(3000)), seed=s)} for s in (1, 2))
    assert len(one) > 20 and one != other


def test_remembered_words_equal_single_ones(model):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["international", "the", "of", "Ünï▁", "x" * 250, "", "understanding"]) for _ in range(60)) for _ in range(8)]
    batch = model.encode_batch(texts, list(range(8)), rate=0.2)
    assert all(list(model.encode_batch([t], [k], rate=0.2)[0]) == list(b) for k, (t, b) in enumerate(zip(texts, batch)))
    drawn = pieces.Pieces._varied
    try:
        pieces.Pieces._varied = staticmethod(lambda which, *_: np.arange(len(which)))  # nothing is remembered
        single = model.encode_batch(texts, list(range(8)), rate=0.2)
    finally:
        pieces.Pieces._varied = staticmethod(drawn)
    assert all(list(a) == list(b) for a, b in zip(single, batch))
