"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import share_code
from . import decontaminate, exact_dedup, html_text, jaccard_join, line_dedup, pieces, quality, secret_scan, sharding, token_counts

#: Folder of the public tokenizer files' module; a parameter, they are never copied.
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that its source repeats among its documents of one language."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), ratio=line_dedup.LANGUAGE_RATIO, lang_col="lang").select("doc_id", "text", "n_chars")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_scan(table(spark, sf_dir, "documents"))

    def text(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's piece ids under seeded merge-dropout."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL)).select("doc_id", "n_pieces", "piece_ids")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of document and benchmark item that it holds, with the alignment's part of the item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_html_text": op3_html_text,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_sharding": op6_sharding,
    "op7_pieces": op7_pieces,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_exact_dedup": op10_exact_dedup,
}


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a text's UTF-8, four bits at a time."""
    table = []
    for nibble in range(16):
        for _ in range(4):
            nibble = nibble >> 1 ^ (0xEDB88320 if nibble & 1 else 0)
        table.append(nibble)
    step = lambda a: f"xor(({a}) >> 4, {table}[(({a}) & 15) + 1])"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda a, b: {step(step('xor(a, b)'))}), 4294967295)"


def _rendezvous(shards: int) -> str:
    """SQL for the shard of a document among so many of equal weight."""
    return f"(SELECT CAST(arg_min(k, -ln((('0x' || substr(md5(k || ':' || doc_id), 1, 13))::BIGINT + 0.5) / {1 << 52})) AS INTEGER) FROM range({shards}) t(k))"


#: The other operators are beyond SQL.
ORACLE_SQL = {
    "op2_line_dedup": f"""
        WITH lines AS (SELECT doc_id, source, lang, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
        pages AS (SELECT source, lang, count(DISTINCT text) AS total FROM documents GROUP BY 1, 2),
        common AS (
            SELECT l.source, l.lang, trim(l.line, ' ' || chr(9) || chr(13)) AS line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source AND l.lang IS NOT DISTINCT FROM p.lang
            WHERE trim(l.line, ' ' || chr(9) || chr(13)) <> '' GROUP BY 1, 2, 3, p.total
            HAVING count(DISTINCT l.text) >= {line_dedup.LEAST_PAGES} AND count(DISTINCT l.text) > {line_dedup.LANGUAGE_RATIO} * p.total
        ),
        kept AS (
            SELECT doc_id, string_agg(l.line, chr(10) ORDER BY place) AS text FROM lines l
            LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND l.lang IS NOT DISTINCT FROM c.lang AND trim(l.line, ' ' || chr(9) || chr(13)) = c.line WHERE c.line IS NULL GROUP BY 1
        )
        SELECT d.doc_id, coalesce(k.text, '') AS text, length(coalesce(k.text, '')) AS n_chars FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
    "op3_html_text": r"""
        WITH parts AS (SELECT page_id, regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</?(?:p|h1)>') AS part FROM pages),
        blocks AS (SELECT page_id, unnest(part) AS block, generate_subscripts(part, 1) AS place FROM parts),
        plain AS (
            SELECT page_id, place, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]+>', ' ', 'g'),
                   '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM blocks
        ),
        joined AS (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY place) AS text FROM plain WHERE block <> '' GROUP BY 1)
        SELECT p.page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages p LEFT JOIN joined j ON p.page_id = j.page_id
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
            WHERE x.n * 100 >= y.n * 85 AND y.n * 100 >= x.n * 85 GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
        ),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN least ON a = d.doc_id
    """,
    "op6_sharding": f"""
        WITH sized AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
        dealt AS (SELECT *, {_rendezvous(8)} AS shard, {_rendezvous(9)} AS grown_shard, substr(md5('slot:' || doc_id || ':' || text_crc32), 1, {sharding.DIGITS}) AS part FROM sized)
        SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM dealt
    """,
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
}
