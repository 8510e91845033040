"""The registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axisframe.llm.chat_format import format_conversations, read_back
from axisframe.llm.decontaminate import decontaminate
from axisframe.llm.exact_dedup import exact_dedup
from axisframe.llm.hard_negatives import hard_negatives
from axisframe.llm.jaccard_join import jaccard_components
from axisframe.llm.lexical_search import ranked_search
from axisframe.llm.line_dedup import line_report
from axisframe.llm.sharding import shard_documents
from axisframe.llm.substring_dedup import repeated_passages
from axisframe.llm.token_output import read_tokens, write_tokens
from axisframe.llm.toxicity import toxicity_scores
from axisframe.llm.unigram import encode_pieces
from axisframe.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; vocabularies are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents, the lines that repeat another line within two edits."""
    return line_report(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels that aren't held out."""
    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under shared 5-word shingles at 0.8."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, then read back through the index."""
    index = write_warc(_table(spark, sf_dir, "pages"))
    return read_warc(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns over all documents and benchmark items."""
    out = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that an earlier document has, too."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold the template's control strings, formatted and read back."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(extra)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: those with an even crc32 of the id are the snapshot, the others the incoming batch."""
    out = exact_dedup(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to compressed shards, then read back."""
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, decoded again."""
    out = encode_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "lossless")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose ids are divisible by 100; labels of every seventh id are one further."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return shard_documents(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup, "op2_toxicity": op2_toxicity, "op3_jaccard_join": op3_jaccard_join, "op4_warc": op4_warc, "op5_decontaminate": op5_decontaminate, "op6_substring_dedup": op6_substring_dedup, "op7_chat_format": op7_chat_format,
    "op8_exact_dedup": op8_exact_dedup, "op9_token_output": op9_token_output, "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives, "op12_sharding": op12_sharding, "op13_lexical_search": op13_lexical_search,
}

ORACLE_SQL = {
    "op3_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT x.doc_id AS p, y.doc_id AS q, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) t JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x, min(page_id) OVER (PARTITION BY b) AS first FROM p),
d AS (SELECT *, translate(array_to_string([lpad(to_base(CAST('0x' || x[10 * i + 1:10 * i + 10] AS BIGINT), 32), 8, '0') FOR i IN range(4)], ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d""",
    "op5_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS span
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS span
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, span)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op11_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum([a.e[i] * b.e[i] FOR i IN range(1, len(a.e) + 1)]) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM c WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN c USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10""",
    # state of the search: bounds of the capacity, the greedy pass's shard and place; then the latest starts and the cuts
    "op12_sharding": r"""
WITH RECURSIVE d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS t, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS key FROM documents),
g AS MATERIALIZED (SELECT key, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY key),
o AS MATERIALIZED (SELECT key, bytes, CAST(sum(bytes) OVER (ORDER BY big DESC, CASE WHEN big THEN -bytes ELSE 0 END, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, total FROM (SELECT *, 4096 * bytes >= total AS big FROM (SELECT *, CAST(sum(bytes) OVER () AS BIGINT) AS total FROM g))),
edge AS MATERIALIZED (SELECT e FROM o UNION ALL SELECT 0),
s AS (SELECT CAST(ceil(max(total) / 16.0) AS BIGINT) AS low, max(total) AS high, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS p, max(total) AS total FROM o
      UNION ALL
      SELECT CASE WHEN j = 16 AND p < total THEN (low + high) // 2 + 1 ELSE low END, CASE WHEN j = 16 AND p >= total THEN (low + high) // 2 ELSE high END, CASE WHEN j = 16 THEN 0 ELSE j + 1 END,
             CASE WHEN j = 16 THEN 0 ELSE (SELECT max(e) FROM edge WHERE e <= s.p + (s.low + s.high) // 2) END, total FROM s WHERE low < high),
cap AS (SELECT min(high) AS c, max(total) AS total FROM s),
l AS (SELECT CAST(16 AS BIGINT) AS j, total AS q, c FROM cap UNION ALL SELECT j - 1, (SELECT min(e) FROM edge WHERE e >= l.q - l.c), c FROM l WHERE j > 1),
cuts AS (SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS p, c, total FROM cap
         UNION ALL
         SELECT j + 1, CASE WHEN p = total THEN p ELSE (SELECT arg_min(e, abs((e - cuts.p) * (16 - cuts.j) - (cuts.total - cuts.p)) * 4 + CASE WHEN e > cuts.p + (cuts.total - cuts.p) // (16 - cuts.j) THEN 1 ELSE 0 END)
           FROM edge WHERE e > cuts.p AND e <= cuts.p + cuts.c AND e >= (SELECT max(q) FROM l WHERE l.j = cuts.j + 1)) END, c, total FROM cuts WHERE j < 15),
k AS (SELECT key, CAST((SELECT count(*) FROM cuts WHERE j > 0 AND p <= o.e - o.bytes) AS INTEGER) AS shard FROM o),
-- reflected CRC-32, a byte at a time
z AS (SELECT DISTINCT key, t FROM d),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
crc AS (SELECT key, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(t) + 1), lambda i: CAST('0x' || substr(hex(encode(t)), 2 * i - 1, 2) AS BIGINT))), lambda x, y: xor(tab[(xor(x, y) & 255) + 1], x >> 8)), 4294967295) AS text_crc32 FROM z, tab)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, key) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN k USING (key) JOIN crc USING (key)""",
    "op13_lexical_search": r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM f GROUP BY doc_id),
a AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY term), a),
q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (doc_id), a GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER r AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW r AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER r <= 20""",
}
