"""The registered queries of this subpackage: each applies one operator to its whole table.

The operators keep their own results (texts, ids, spans, files); the queries derive the compared columns from them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import codes, collocations, exact, idfiles, language, licences, near, neighbours, packing, pieces, private, substrings, warc
from tidemark.llm.common import table
from tidemark.runtime import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 2048 ids over all documents."""
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op9_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads the files back."""
    path = scratch_path(spark, "ids")
    idfiles.write_ids(table(spark, sf_dir, "documents"), path)
    return idfiles.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact.groups(table(spark, sf_dir, "documents"))


ORACLES["op8_exact_dedup"] = r"""
WITH hashed AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    found = private.find(table(spark, sf_dir, "documents"))
    counts = [F.size(private.of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in private.BASE]
    return found.select("doc_id", *counts, F.sha2(private.joined(*private.BASE), 256).alias("base_sha256"), private.joined(*private.KINDS).alias("spans"))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.prototypes(docs, ~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all documents, by shingles of four words."""
    return near.links(table(spark, sf_dir, "documents"), words=4)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents under the piece model, and the text that decoding them gives."""
    return pieces.encode_and_decode(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases in all documents."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return licences.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"))


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


@query
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all embeddings."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to three words per language, over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = r"""
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (VALUES (1), (2), (3)) AS sizes(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 10),
cuts AS (
    SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS front, array_to_string(w[cut + 1:k], ' ') AS rest
    FROM candidates, (VALUES (1), (2)) AS places(cut) WHERE cut < k),
scored AS (
    SELECT c.lang, c.k, c.phrase, c.a, cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.k = c.cut AND x.phrase = c.front JOIN f y ON y.lang = c.lang AND y.k = c.k - c.cut AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_pairs AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE k = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (
    SELECT b.* FROM best b LEFT JOIN inner_pairs p ON b.k = 2 AND p.lang = b.lang AND p.phrase = b.phrase
    WHERE p.longer IS NULL OR 100 * p.longer < 50 * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS place FROM kept)
SELECT lang, place::INTEGER AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE place <= 2000
"""


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages as WARC records and reads the archives back."""
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


ORACLES["op12_warc"] = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM grouped
"""


@query
def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings under codebooks of four rounds."""
    return codes.encode(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    def assigned(books: str) -> str:
        return (f"SELECT row_no, p, min((list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c))::BIGINT * 256 + e) AS best "
                f"FROM parts JOIN {books} USING (p) GROUP BY row_no, p")

    steps = ""
    for r in range(rounds):
        steps += f"""
a{r} AS MATERIALIZED ({assigned(f'b{r}')}),
m{r} AS (
    SELECT p, e, list(c ORDER BY j) AS c FROM (
        SELECT p, best % 256 AS e, j, floor(sum(x[j]) / count(*)) AS c FROM a{r} JOIN parts USING (row_no, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS j) GROUP BY ALL)
    GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e),"""
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS row_no, vec_id, label, list_transform(embedding, lambda x: floor(1024.0::DOUBLE * x::DOUBLE)) AS v
    FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row_no, p, v[p * (len(v) // 4) + 1:(p + 1) * (len(v) // 4)] AS x FROM kept, (VALUES (0), (1), (2), (3)) AS four(p)),
b0 AS (SELECT p, row_no - 1 AS e, x AS c FROM parts WHERE row_no <= 256),{steps}
final AS MATERIALIZED ({assigned(f'b{rounds}')}),
coded AS (SELECT row_no, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM final GROUP BY row_no),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row_no), digest
"""


ORACLES["op13_codes"] = _codes_sql()
