"""The registered queries of this subpackage: thin uses of the operators with their production settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from reachlens.llm import decontaminate, language, licenses, packing, pii, prefix_forest, prefix_trie, secret_scan, sharding, simhash, substrings, warc, whitening

_ROOT = str(Path(__file__).resolve().parents[2])

_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this repository, and bound what they get at once, unless the session says otherwise.

    A cluster ships the repository with --py-files or installs it. Batches for Python are limited by rows only, which
    long texts would turn into any size, so their bytes are limited as well.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registered(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return query(spark, folder)

    QUERIES[query.__name__] = run
    return run


@registered
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold 80 % or more of the distinct five-word shingles of a benchmark item."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op1_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-`{-\x7f]+') AS w FROM documents WHERE text IS NOT NULL
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(text), '[^\x00-/:-`{-\x7f]+') AS w FROM benchmark WHERE text IS NOT NULL
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc_words WHERE len(w) > 0)
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_contained, count(*) / n::DOUBLE AS containment
FROM doc_shingles JOIN item_shingles USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) >= 0.8 * n
"""


@registered
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to dictionary-compressed WARC archives and read back."""
    found = warc.round_trip(table(spark, folder, "pages"), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), parts AS (
  SELECT *, list_transform(range(0, 4), lambda k: ('0x' || substr(h, 1 + 10 * k, 10))::BIGINT) AS fives FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[1 + i // 8] >> (35 - 5 * (i % 8))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY h) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id > min(page_id) OVER (PARTITION BY h) THEN min(page_id) OVER (PARTITION BY h) END AS refers_to
FROM parts
"""


@registered
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each document that repeat 20 or more words from earlier in the corpus are cut."""
    return substrings.remove_repeats(table(spark, folder, "documents"), with_text=False).drop("spans")


ORACLES["op3_substring_dedup"] = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM docs)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS place FROM later
), kept AS (
  SELECT doc_id, place, w[place] AS word
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM docs) ANTI JOIN removed USING (doc_id, place)
), left_over AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS text FROM kept GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(left_over.text, '')) AS kept_sha256
FROM docs LEFT JOIN left_over USING (doc_id)
"""


@registered
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of known formats and random-looking tokens in every document."""
    return secret_scan.scan(table(spark, folder, "documents")).drop("found")


def tokenizer_file() -> str:
    """The production setting of the tokenizer's path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@registered
def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"), packing.Packing(str(tokenizer_file())))


@registered
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Four-word SimHash fingerprints, linked at four or fewer differing bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@registered
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, by code lengths under context trees of the labelled ones."""
    found = language.identify(table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_symbol")


@registered
def op8_prefix_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one."""
    return prefix_forest.search(table(spark, folder, "embeddings"))


@registered
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards by a Feistel permutation of the row numbers."""
    return sharding.shard(table(spark, folder, "documents")).drop("number")


@registered
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    return pii.scan(table(spark, folder, "documents")).drop("found")


@registered
def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """The trie of the prefixes of all rebuilt conversations."""
    return prefix_trie.trie(table(spark, folder, "conversations"))


ORACLES["op11_prefix_trie"] = """
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS w
  FROM turns GROUP BY c
), checked AS (
  SELECT c, w, c - c % 5 AS b, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, step: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)
  ), 4294967295) % 9 AS h FROM own
), rebuilt AS (
  SELECT a.c, list_concat(list_slice(coalesce(base.w, []), 1, a.h), list_slice(a.w, a.h + 1, len(a.w))) AS w
  FROM checked a LEFT JOIN own base ON a.b = base.c
), prefixes AS (
  SELECT c, d, len(w) AS n, sha256(w[1 : d]::VARCHAR) AS k, CASE WHEN d > 0 THEN sha256(w[1 : d - 1]::VARCHAR) END AS p,
    CASE WHEN d > 0 THEN octet_length(encode(w[d].text)) ELSE 0 END AS size
  FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, k, min(p) AS p, min(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, k
), counted AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children
  FROM nodes LEFT JOIN (SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL) USING (d, k)
), subtrees AS (
  SELECT above.d, above.k, sum((below.n_convs - 1) * below.size) AS saved, count(*) FILTER (below.n_children = 0) AS leaves
  FROM counted below JOIN prefixes above ON above.c = below.conv_id AND above.d <= below.d GROUP BY ALL
)
SELECT a.conv_id, a.d AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, leaves::BIGINT AS n_leaves,
  saved::BIGINT AS saved_tokens, a.ends_sha256
FROM counted a JOIN subtrees USING (d, k) LEFT JOIN nodes b ON b.d = a.d - 1 AND b.k = a.p
"""


@registered
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """The first 32 whitened components of every usable vector."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@registered
def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License phrases of every document, and notices that a block of its text contains."""
    return licenses.scan(table(spark, folder, "documents")).drop("blocks")


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TEMPLATES = ", ".join(f"({i}, {_quoted(label)}, {_quoted(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"({_quoted(phrase)}, {_quoted(label)})" for phrase, label in licenses.PHRASES)
_SPLIT = r"regexp_extract_all(translate({}, '" + _UPPER + "', '" + _LOWER + r"'), '[^\x00-/:-`{{-\x7f]+')"
ORACLES["op13_license_scan"] = f"""
WITH templates(template, label, text) AS (VALUES {_TEMPLATES}),
phrases(phrase, label) AS (SELECT string_split(p, ' '), l FROM (VALUES {_PHRASES}) AS v(p, l)),
template_words AS (SELECT template, label, {_SPLIT.format("text")} AS w FROM templates),
tokens AS (
  SELECT DISTINCT template, label, len(w) AS m, w[i : i + 4] AS s
  FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM template_words)
),
sizes AS (SELECT template, label, m, count(*) AS size FROM tokens GROUP BY ALL),
docs AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
bases AS (
  SELECT doc_id, place, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS place FROM docs), phrases
  WHERE w[place : place + len(phrase) - 1] = phrase
),
by_base AS (
  SELECT doc_id, count(*) AS n_base, min(place) - 1 AS first_word, max(place) - 1 AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM bases GROUP BY doc_id
),
hits AS (
  SELECT doc_id, template, label, m, s, place
  FROM (SELECT doc_id, place, w[place + 1 : place + 5] AS s FROM (SELECT doc_id, w, unnest(range(0, len(w) - 4)) AS place FROM docs))
  JOIN tokens USING (s)
),
blocks AS (
  SELECT doc_id, template, block, count(DISTINCT s) AS contained
  FROM (SELECT *, unnest([place // m - 1, place // m]) AS block FROM hits)
  WHERE block >= 0 AND place + 5 <= (block + 2) * m GROUP BY ALL
),
matches AS (
  SELECT doc_id, label, contained / size::DOUBLE AS containment
  FROM blocks JOIN sizes USING (template) WHERE contained >= ceil(0.8 * size - 1e-9)
),
all_labels AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM bases UNION ALL SELECT doc_id, label FROM matches) GROUP BY doc_id
),
scores AS (SELECT doc_id, max(containment) AS best FROM matches GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM docs LEFT JOIN by_base USING (doc_id) LEFT JOIN all_labels USING (doc_id) LEFT JOIN scores USING (doc_id)
"""
