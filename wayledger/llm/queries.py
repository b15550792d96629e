"""Registered queries of the operators over the given tables, and their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayledger.llm import bitpack, chat, jaccard, langid, lm, maxscore, mixing, packing, phrases, pivots, quality, sharding, spelling
from wayledger.llm.tables import shared_folder

SHARDS = 24
MIX_EXPONENT, MIX_SEED = 0.5, 29
TOP_PHRASES, SPOIL = 2000, 97


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int) -> Column:
    """crc32 of doc_id as text modulo ``of``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of, F.lit(0))


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 24 shards whose row counts are at most one apart."""
    out = sharding.shuffle_to_shards(table(spark, sf_dir, "documents"), SHARDS)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return out.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document: five-word shingles, similarity 0.8 or more."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every 50th vector with all others."""
    vectors = maxscore.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return maxscore.top_k(vectors, F.col("id") % 50 == 0, 5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of two folds of three."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels))
    score = F.col("quality_score")
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation that is no prefix of a longer one, rendered."""
    return chat.render(table(spark, sf_dir, "conversations"))


def op7_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and representative of every vector at a cosine of 0.9."""
    return pivots.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = langid.fit(docs.where(fold(5) != 0))
    found = langid.predict(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of all documents such that sources weigh as the square root of their size, in shuffled order."""
    docs = table(spark, sf_dir, "documents")
    weights = mixing.tempered_weights(mixing.source_sizes(docs), MIX_EXPONENT)
    return mixing.mix(docs, weights, seed=MIX_SEED).select("doc_id", "source", "text", "replica", "n_copies", "shuffle_key")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under the bigrams of all documents, its own too, so that nothing backs off; to four places."""
    return lm.stupid_backoff(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


def op10_lm_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document under the trigrams of all other documents, to four places."""
    return lm.held_out_backoff(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 4))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of each language."""
    found = phrases.top_phrases(phrases.collocations(table(spark, sf_dir, "documents")), TOP_PHRASES)
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from files of packed ids."""
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    bitpack.write_ids(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), folder)
    read = bitpack.read_ids(spark, folder)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return read.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, one occurrence of 97 (by hash) misspelt beforehand."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), spoil=SPOIL)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_sharding, op3_jaccard_join, op4_maxscore, op5_quality, op6_chat, op7_pivots, op8_langid, op9_mixing, op10_lm,
        op10_lm_held_out, op11_phrases, op12_bitpack, op13_spelling,
    )
}

WORDS = r"[^\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7f]+"

SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"  # lower case of A to Z only

ORACLE: dict[str, str] = {
    "op3_jaccard_join": rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents),
grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
    FROM words WHERE len(w) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n * 1000 >= 800 * (x.n + y.n - s.n)),
equal AS MATERIALIZED (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE s.n = x.n AND s.n = y.n),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS class_id,
    least(d.doc_id, (SELECT min(b) FROM equal e WHERE e.a = d.doc_id)) AS copy_id,
    (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links
FROM documents d""",
    "op4_maxscore": """
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scores QUALIFY rank <= 5""",
    "op6_chat": f"""
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
prefixes AS (
    SELECT *, md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS h FROM placed),
whole AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM prefixes WHERE pos = n GROUP BY h),
kept AS (SELECT * FROM whole WHERE h NOT IN (SELECT h FROM prefixes WHERE pos < n))
SELECT p.conv_id, (p.pos - 1) // {chat.BLOCK_TURNS} AS part, k.n_turns, k.n_copies,
    string_agg('{chat.OPEN}' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '{chat.CLOSE}' || chr(10), '' ORDER BY pos) AS text
FROM placed p JOIN kept k ON p.conv_id = k.conv_id GROUP BY ALL""",
    "op7_pivots": """
WITH RECURSIVE v AS MATERIALIZED (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n_links, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN roots r ON r.a = e.vec_id LEFT JOIN counts c ON c.a = e.vec_id""",
    "op9_mixing": f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')) + 1) AS size FROM documents GROUP BY source),
rates AS (
    SELECT source, (SELECT sum(size) FROM sizes)::DOUBLE * (pow(size::DOUBLE, {MIX_EXPONENT}) / (SELECT sum(pow(size::DOUBLE, {MIX_EXPONENT})) FROM sizes)) / size AS rate
    FROM sizes),
cells AS (
    SELECT source, rate, unnest(range(greatest(0, floor(rate - 10 * sqrt(rate) - 30))::BIGINT, ceil(rate + 10 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM rates),
steps AS (SELECT *, CASE WHEN k = min(k) OVER (PARTITION BY source) THEN 0 ELSE ln(rate / k) END AS step FROM cells),
logs AS (SELECT *, sum(step) OVER (PARTITION BY source ORDER BY k) AS l FROM steps),
weights AS (SELECT *, exp(l - max(l) OVER (PARTITION BY source)) AS p FROM logs),
cdf AS MATERIALIZED (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) / sum(p) OVER (PARTITION BY source) AS c FROM weights),
named AS (SELECT *, coalesce(doc_id::VARCHAR, text, '') AS name FROM documents),
drawn AS (SELECT *, ('0x' || substr(md5('{MIX_SEED}:' || name), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS u FROM named),
counted AS (
    SELECT d.doc_id, d.source, d.text, d.name, min(c.k) AS n_copies
    FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c > d.u GROUP BY ALL),
copies AS (SELECT *, unnest(range(n_copies)) AS replica FROM counted)
SELECT doc_id, source, text, replica, n_copies, md5('{MIX_SEED + 1}:' || name || ':' || replica) AS shuffle_key FROM copies""",
    "op10_lm": rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORDS}') AS w FROM documents),
pairs AS MATERIALIZED (
    SELECT doc_id, unnest(list_prepend('<s>', w[:len(w) - 1])) AS v, unnest(w) AS w FROM words WHERE len(w) > 0),
firsts AS (SELECT v, count(*) AS n FROM (SELECT w AS v FROM pairs UNION ALL SELECT v FROM pairs WHERE v = '<s>') GROUP BY v),
bigrams AS (SELECT v, w, count(*) AS n FROM pairs GROUP BY v, w),
sums AS (
    SELECT doc_id, count(*) AS n_tokens, round(sum(ln(b.n) - ln(f.n)), 4) AS score
    FROM pairs p JOIN bigrams b ON p.v = b.v AND p.w = b.w JOIN firsts f ON p.v = f.v GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(score, 0.0) AS score FROM documents d LEFT JOIN sums s ON d.doc_id = s.doc_id""",
    "op11_phrases": rf"""
WITH parts AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({SMALL.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM parts),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (
    SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
    FROM pieces, (VALUES (1), (2), (3)) t(k)),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
candidates AS MATERIALIZED (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, len(w))) AS cut FROM candidates),
scored AS (
    SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[:cut], ' ')
    JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
    QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
covered AS (
    SELECT i.lang, i.phrase FROM candidates i JOIN (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE len(w) = 3) o
    ON o.lang = i.lang AND o.phrase = i.phrase WHERE 100 * o.a >= 50 * i.a)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase)::INTEGER AS rank, s.phrase, a, l, r, n, score
FROM scored s JOIN sizes z ON z.lang = s.lang
WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = s.lang AND c.phrase = s.phrase)
QUALIFY rank <= {TOP_PHRASES}""",
    "op13_spelling": rf"""
WITH RECURSIVE runs AS (
    SELECT doc_id, {SMALL.format("run")} AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
divisor AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
octets AS (
    SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c:
        CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))::BIGINT[] AS b
    FROM runs),
hashed AS (
    SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1]), 4294967295::BIGINT), 4294967295) AS h FROM octets, divisor),
spelt AS (SELECT CASE WHEN h % {SPOIL} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS MATERIALIZED (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS MATERIALIZED (SELECT DISTINCT g.word AS a, w.word AS b, g.n AS an, w.n AS bn FROM gaps g JOIN words w ON g.rest = w.word),
near AS MATERIALIZED (
    SELECT x.word AS a, y.word AS b, y.n AS bn FROM gaps x JOIN gaps y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION ALL SELECT a, b, bn FROM shorter UNION ALL SELECT b, a, an FROM shorter),
best AS (SELECT a, b, bn, count(*) OVER (PARTITION BY a) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) = 1),
forms AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * w.n THEN b END AS form, CASE WHEN bn >= 2 * w.n THEN bn END AS form_n
    FROM words w LEFT JOIN best ON a = w.word),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk k ON k.word = f.word JOIN forms e ON e.word = k.root AND e.form IS NULL""",
}
