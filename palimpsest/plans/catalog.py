"""The queries of the search engine over the test tables, and their DuckDB counterparts.

``documents`` are the corpus (author: source, title: lang and doc_id), sentences of ``benchmark`` the needles, and
``embeddings`` the word vectors: the r-th most frequent word has the r-th vector.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vectors as V
from palimpsest.operators import corpus, embeddings, evaluate, regions, similarity
from palimpsest.plans import contextual, evaluation
from palimpsest.plans import search as S
from palimpsest.sources import readers
from palimpsest.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def six(c) -> F.Column:
    return F.round(c, 6)


# Parts that several counterparts begin with.
SENTENCES = r"""
WITH pieces AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?…;:\n]+'), lambda s: regexp_matches(s, '[\p{L}\p{N}_]+')) AS ss FROM documents),
s AS (SELECT doc_id, (unnest(range(len(ss))))::INT AS sentence_id, unnest(ss) AS sentence FROM pieces),
st AS (SELECT doc_id, sentence_id, sentence, regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+') AS tokens FROM s),
sn AS (SELECT *, len(tokens)::INT AS n_tokens, max(len(tokens)) OVER (PARTITION BY doc_id)::INT AS max_len_s FROM st)"""
TOKENS = r"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ps FROM documents),
parts AS (SELECT doc_id, unnest(range(len(ps))) AS n, unnest(ps) AS part FROM raw),
placed AS (SELECT *, strlen(part) AS len, coalesce(sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM parts),
tok AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INT AS token_no, idx::BIGINT AS idx, len::INT AS len, lower(part) AS token
        FROM placed WHERE regexp_matches(part, '^[\p{L}\p{N}_]'))"""
DETERMINERS = "(" + ", ".join(f"'{w}'" for w in T.DETERMINERS) + ")"
POS = f"CASE WHEN token IN {DETERMINERS} THEN 'DET' WHEN regexp_full_match(token, '\\p{{N}}+') THEN 'NUM' ELSE 'NOUN' END"
VOCAB = (
    SENTENCES
    + """,
w AS (SELECT unnest(tokens) AS token FROM sn),
vocab AS (SELECT token, count(*)::BIGINT AS n FROM w GROUP BY token),
total AS (SELECT sum(n) AS total FROM vocab),
ranked AS (SELECT token, n, -ln(n / total) AS idf, row_number() OVER (ORDER BY n DESC, token) - 1 AS r FROM vocab, total),
vecs AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings),
emb AS (SELECT token, idf, vec_id, list_transform(e, lambda x: greatest(x, 0.0)) AS c FROM ranked JOIN vecs USING (r)),
ev AS (SELECT token, idf, vec_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS vec FROM emb)"""
)
VECTORS = """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS len, list_transform(e, lambda x: greatest(x, 0.0)) AS c FROM v),
nv AS (SELECT vec_id, label, e, list_transform(e, lambda x: x / len) AS u, c, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS vec FROM l)"""


@query(SENTENCES + " SELECT doc_id, sentence_id, sentence, n_tokens, max_len_s FROM sn")
def sentence_split(spark, d):
    return corpus.sentences(docs(spark, d)).select("doc_id", "sentence_id", "sentence", "n_tokens", "max_len_s")


@query(TOKENS + f" SELECT *, {POS} AS pos, CASE {POS} WHEN 'DET' THEN 'DT' WHEN 'NUM' THEN 'CD' ELSE 'NN' END AS tag FROM tok")
def token_offsets(spark, d):
    return corpus.tokens(docs(spark, d))


@query(TOKENS + f" SELECT doc_id, count(*) AS n FROM tok WHERE {POS} <> 'DET' GROUP BY doc_id")
def determiner_filter(spark, d):
    return corpus.determiner_filter(corpus.tokens(docs(spark, d))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(SENTENCES + " SELECT doc_id, sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_sentences, max(n_tokens) AS max_len_s FROM sn GROUP BY doc_id")
def token_stats(spark, d):
    return corpus.document_stats(docs(spark, d))


@query(SENTENCES + " SELECT sum(n_tokens)::BIGINT AS n_tokens, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs FROM sn")
def corpus_stats(spark, d):
    stats = corpus.document_stats(docs(spark, d))
    return stats.agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_sentences").alias("n_sentences"), F.count(F.lit(1)).alias("n_docs"))


@query(SENTENCES + """ SELECT doc_id, sentence_id, n_tokens,
  coalesce(sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS token_at FROM sn""")
def sentence_prefix(spark, d):
    return corpus.sentence_table(corpus.sentences(docs(spark, d)))


@query(TOKENS + r""", pieces AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?…;:\n]+'), lambda s: regexp_matches(s, '[\p{L}\p{N}_]+')) AS ss FROM documents),
s AS (SELECT doc_id, unnest(range(len(ss)))::INT AS sentence_id, unnest(ss) AS sentence FROM pieces),
sn AS (SELECT doc_id, sentence_id, coalesce(sum(len(regexp_extract_all(sentence, '[\p{L}\p{N}_]+'))) OVER (PARTITION BY doc_id ORDER BY sentence_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS token_no FROM s),
ends AS (SELECT doc_id, sentence_id, idx, lead(idx) OVER (PARTITION BY doc_id ORDER BY sentence_id) AS nxt FROM sn JOIN tok USING (doc_id, token_no))
SELECT doc_id, sentence_id, decode(array_slice(encode(text), idx + 1, coalesce(nxt, strlen(text)))) AS sentence_text FROM ends JOIN documents USING (doc_id)""")
def sentence_text(spark, d):
    return corpus.sentence_texts(docs(spark, d))


@query(VOCAB + " SELECT token, n, round(-idf, 6) AS prob, round(idf, 6) AS idf FROM ranked")
def vocabulary_idf(spark, d):
    return corpus.vocabulary(docs(spark, d)).select("token", "n", six("prob").alias("prob"), six("idf").alias("idf"))


@query(VOCAB + " SELECT token, vec_id FROM ev")
def embedded_vocabulary(spark, d):
    return corpus.embedded_vocabulary(docs(spark, d), table(spark, d, "embeddings")).select("token", "vec_id")


SIGNED = r"""
, sh AS (SELECT doc_id, sha1(concat_ws(':', source, concat_ws(' ', lang, doc_id), coalesce(text, ''))) AS h, upper(source) AS a, upper(lang) AS l, doc_id::VARCHAR AS i FROM documents)"""


@query("""WITH sh AS (SELECT doc_id, sha1(concat_ws(':', source, concat_ws(' ', lang, doc_id), coalesce(text, ''))) AS h, upper(source) AS a, upper(lang) AS l FROM documents)
SELECT doc_id, substr(a, 1, 4) || '-' || rpad(substr(l, 1, 4), 4, 'X') || '-' ||
  upper(array_to_string(list_transform(range(10), lambda k: substr(h, (4 * k + 1)::BIGINT, 1)), '')) AS doc_signature FROM sh""")
def document_signature(spark, d):
    title = F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", T.document_signature(F.col("source"), title, F.coalesce("text", F.lit(""))).alias("doc_signature"))


@query(SENTENCES + """ SELECT doc_id, sentence_id, printf('%06d', sentence_id + 1) AS number,
  upper(array_to_string(list_transform(range(6), lambda k: substr(sha1(trim(sentence)), (4 * k + 1)::BIGINT, 1)), '')) AS digits FROM sn""")
def sentence_signature(spark, d):
    parts = F.split("signature", "-")
    return corpus.signatures(docs(spark, d)).select("doc_id", "sentence_id", F.element_at(parts, -2).alias("number"), F.element_at(parts, -1).alias("digits"))


@query("""WITH sh AS (SELECT doc_id, sha1(concat_ws(':', source, coalesce(text, ''))) AS h FROM documents)
SELECT substr(h, 1, 10) AS doc_signature, count(DISTINCT doc_id) AS n FROM sh GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def duplicate_signatures(spark, d):
    signed = docs(spark, d).select("doc_id", F.substring(F.sha1(F.concat_ws(":", "source", F.coalesce("text", F.lit("")))), 1, 10).alias("doc_signature"))
    return corpus.duplicate_signatures(signed)


NEEDLES = r"""
, nd AS (SELECT item_id, unnest(range(len(ss)))::INT AS sentence_no, unnest(ss) AS sentence FROM (
  SELECT item_id, list_filter(regexp_split_to_array(text, '[.!?…;:\n]+'), lambda s: regexp_matches(s, '[\p{L}\p{N}_]+')) AS ss FROM benchmark))
, nl AS (SELECT item_id * 1000 + sentence_no AS query_id, sentence, regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+') AS words FROM nd)"""
NORMAL = r"trim(lower(regexp_replace({}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g')))"


def needles(spark, d) -> DataFrame:
    """(query_id, query): every sentence of the benchmark items."""
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(T.sentence_array(F.col("text"))).alias("no", "query"))
    return rows.select((F.col("item_id") * 1000 + F.col("no")).alias("query_id"), "query")


@query(SENTENCES + NEEDLES + f""", q AS (SELECT query_id, {NORMAL.format('sentence')} AS q FROM nl),
t AS (SELECT doc_id, sentence_id, {NORMAL.format('sentence')} AS t FROM sn)
SELECT query_id AS quote_id, doc_id, sentence_id FROM q JOIN t ON contains(' ' || t || ' ', ' ' || q || ' ')""")
def quote_resolver(spark, d):
    """Quotes of any length."""
    quotes = needles(spark, d).select(F.col("query_id").alias("quote_id"), F.col("query").alias("quote"))
    return corpus.resolve_quotes(quotes, corpus.sentences(docs(spark, d)))


@query(VECTORS + " SELECT vec_id, round(list_sum(u), 5) AS s, round(u[1], 5) AS first FROM nv")
def l2_normalise(spark, d):
    rows = embeddings.normalised(table(spark, d, "embeddings"))
    return rows.select("vec_id", F.round(V.total(F.col("vec")), 5).alias("s"), F.round(F.col("vec")[0], 5).alias("first"))


@query(VECTORS + " SELECT vec_id, round(list_sum(vec), 5) AS s, round(vec[1], 5) AS first FROM nv")
def clamp_renormalise(spark, d):
    rows = embeddings.loaded(table(spark, d, "embeddings"))
    return rows.select("vec_id", F.round(V.total(F.col("vec")), 5).alias("s"), F.round(F.col("vec")[0], 5).alias("first"))


def pairs(spark, d, vector: str = "vec") -> DataFrame:
    """Every vector against those whose id 100 divides: (vec_id, q, a, b)."""
    rows = embeddings.loaded(table(spark, d, "embeddings")).withColumn("u", F.col("embedding").cast("array<double>"))
    left = rows.select("vec_id", F.col(vector).alias("a"))
    right = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col(vector).alias("b"))
    return embeddings.against(left, right, "vec_id", "q")


PAIRS = VECTORS + ", p AS (SELECT x.vec_id, y.vec_id AS q, x.vec AS a, y.vec AS b, x.c AS ca, y.c AS cb FROM nv x JOIN nv y ON y.vec_id % 100 = 0 AND x.vec_id <> y.vec_id)"


@query(PAIRS + """, r AS (SELECT q, vec_id, round(list_dot_product(a, b), 6) AS similarity FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, vec_id)::INT AS rank FROM r) WHERE rank <= 10""")
def cosine_topk(spark, d):
    rows = pairs(spark, d).select("q", "vec_id", six(V.cosine(F.col("a"), F.col("b"))).alias("similarity"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("similarity"), "vec_id"))).where("rank <= 10")


@query(PAIRS + " SELECT q, vec_id, round(list_dot_product(ca, cb), 6) AS similarity FROM p")
def raw_dot(spark, d):
    return pairs(spark, d, "raw0").select("q", "vec_id", six(V.dot(F.col("a"), F.col("b"))).alias("similarity"))


@query(PAIRS + """ SELECT q, vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: sqrt(z[1] * z[2]))) / (list_sum(a) * list_sum(b)), 6) AS similarity FROM p""")
def sqrt_cosine(spark, d):
    return pairs(spark, d).select("q", "vec_id", six(V.measure("sqrt-cosine")).alias("similarity"))


PNORM = "greatest(0.0, 1 - sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 0.5)"


@query(PAIRS + f" SELECT q, vec_id, round({PNORM}, 6) AS similarity FROM p")
def p_norm(spark, d):
    return pairs(spark, d).select("q", "vec_id", six(V.measure("p-norm")).alias("similarity"))


@query(PAIRS + f" SELECT q, vec_id, round(greatest(list_dot_product(a, b), {PNORM}), 6) AS similarity FROM p")
def maximum_measure(spark, d):
    return pairs(spark, d).select("q", "vec_id", six(V.measure("maximum")).alias("similarity"))


KNN = (
    VECTORS
    + """,
d AS (SELECT x.vec_id, y.vec_id AS other, sqrt(list_sum(list_transform(list_zip(x.u, y.u), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM nv x JOIN nv y ON x.vec_id <> y.vec_id),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) - 1 AS j FROM d),
km AS (SELECT vec_id, j, sum(d) OVER (PARTITION BY vec_id ORDER BY d, other ROWS UNBOUNDED PRECEDING) / greatest(j, 1) AS mean FROM o WHERE j < 100)"""
)


@query(KNN + " SELECT vec_id, j::INT AS j, round(mean, 5) AS mean FROM km WHERE j IN (0, 1, 9, 99)")
def knn_means(spark, d):
    rows = embeddings.neighbour_means(embeddings.normalised(table(spark, d, "embeddings")))
    return rows.where(F.col("j").isin(0, 1, 9, 99)).select("vec_id", "j", F.round("mean", 5).alias("mean"))


@query(KNN + """, m AS (SELECT vec_id, mean FROM km WHERE j = 99),
p AS (SELECT x.vec_id, y.vec_id AS q, x.vec AS a, y.vec AS b, m.mean AS ma, k.mean AS mb FROM nv x JOIN nv y ON y.vec_id % 100 = 0 AND x.vec_id <> y.vec_id JOIN m ON m.vec_id = x.vec_id JOIN m k ON k.vec_id = y.vec_id)
SELECT q, vec_id, round(1 - list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / (ma * mb) / 2, 5) AS similarity FROM p""")
def nicdm(spark, d):
    means = embeddings.neighbour_means(embeddings.normalised(table(spark, d, "embeddings"))).where("j = 99").select("vec_id", "mean").persist()
    rows = embeddings.loaded(table(spark, d, "embeddings")).join(means, "vec_id")  # before they are paired: a pair is long
    left = rows.select("vec_id", F.col("vec").alias("a"), F.col("mean").alias("mean_a"))
    right = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("vec").alias("b"), F.col("mean").alias("mean_b"))
    found = embeddings.compared(left, right, "vec_id", "q", apart=True)
    return found.select("q", "vec_id", F.round(V.scaled_nearness(F.sqrt("x"), F.col("mean_a"), F.col("mean_b")), 5).alias("similarity"))


RANKS = """
WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
r AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i DESC) AS r FROM x),
rk AS (SELECT vec_id, list(r ORDER BY i) AS ranks FROM r GROUP BY vec_id)"""


@query(RANKS + " SELECT vec_id, array_to_string(ranks, ' ') AS ranks FROM rk")
def apsynp_ranks(spark, d):
    rows = embeddings.component_ranks(table(spark, d, "embeddings"))
    return rows.select("vec_id", F.array_join(F.col("ranks").cast("array<string>"), " ").alias("ranks"))


@query(RANKS + """, b AS (SELECT list_sum(list_transform(range(1, 65), lambda i: pow(i, -0.1))) AS most, 64 * pow(32.5, -0.1) AS least)
SELECT y.vec_id AS q, x.vec_id, round((list_sum(list_transform(list_zip(x.ranks, y.ranks), lambda z: 2 / (pow(z[1], 0.1) + pow(z[2], 0.1)))) - least) / (most - least), 6) AS similarity
FROM rk x JOIN rk y ON y.vec_id % 100 = 0 AND x.vec_id <> y.vec_id, b""")
def apsynp(spark, d):
    rows = embeddings.component_ranks(table(spark, d, "embeddings"))
    left = rows.select("vec_id", F.col("ranks").alias("ranks_a"))
    right = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("ranks").alias("ranks_b"))
    both = embeddings.against(left, right, "vec_id", "q")
    return both.select("q", "vec_id", six(V.measure("apsynp")).alias("similarity"))


@query(PAIRS + """, s AS (SELECT q, vec_id, round(list_dot_product(a, b), 6) AS s FROM p), o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT (i * 10) // (n - 1) AS part, s AS value FROM o WHERE i IN (SELECT ((n - 1) * k) // 10 FROM range(11) t(k)) AND (i * 10) // (n - 1) >= 0
QUALIFY row_number() OVER (PARTITION BY i ORDER BY s) = 1""")
def percentiles(spark, d):
    """Eleven order statistics of the pair similarities."""
    s = pairs(spark, d).select(six(V.cosine(F.col("a"), F.col("b"))).alias("s"))
    # as in the files of percentiles, a part is told by where its row stands
    return embeddings.percentiles(s, "s", 11).select(F.expr("((n - 1) * part) div 10 * 10 div (n - 1)").alias("part"), "value")


@query(PAIRS + """, t AS (SELECT list_transform(range(0, 11), lambda k: k / 10.0::DOUBLE) AS pc), s AS (SELECT q, vec_id, list_dot_product(a, b) AS s, pc FROM p, t)
SELECT q, vec_id, round(CASE WHEN s < pc[1] THEN 0.0 WHEN s >= pc[11] THEN 1.0 ELSE (floor(s * 10) + (s * 10 - floor(s * 10))) / 10 END, 5) AS similarity FROM s""")
def ranked_measure(spark, d):
    steps = F.array(*[F.lit(k / 10) for k in range(11)])
    rows = embeddings.loaded(table(spark, d, "embeddings"))
    right = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("vec").alias("b"))
    found = embeddings.compared(rows.select("vec_id", F.col("vec").alias("a")), right, "vec_id", "q")
    return found.select("q", "vec_id", F.round(V.ranked(F.col("x"), steps), 5).alias("similarity"))


def engine_vocabulary(spark, d, counts: DataFrame | None = None) -> DataFrame:
    """At most as many rows as there are word vectors."""
    rows = embeddings.loaded(corpus.embedded_vocabulary(docs(spark, d), table(spark, d, "embeddings"), counts), "raw")
    return rows.select("token", "idf", "vec")


def held_vocabulary(spark, d) -> DataFrame:
    """engine_vocabulary, persisted: the texts are counted once."""
    counts = corpus.word_counts(docs(spark, d)).persist()
    vocabulary = engine_vocabulary(spark, d, counts).persist()
    vocabulary.count()
    counts.unpersist()
    return vocabulary


def one_needle(spark, d, words: int = 6) -> DataFrame:
    """The first words of the corpus' most frequent vocabulary, as a needle that has vectors."""
    rows = corpus.vocabulary(docs(spark, d)).orderBy(F.desc("n"), "token").limit(words).collect()
    return spark.createDataFrame([(1, k, r["token"]) for k, r in enumerate(rows)], "query_id long, t_pos int, t_token string")


NEEDLE = VOCAB + ", needle AS (SELECT token AS t_token, r AS t_pos FROM ranked WHERE r < 6), m AS (SELECT e.token, n.t_token, e.idf, list_dot_product(e.vec, t.vec) AS s FROM needle n JOIN ev t ON t.token = n.t_token, ev e)"


@query(NEEDLE + " SELECT token, t_token, round(s, 5) AS similarity FROM m")
def similarity_matrix(spark, d):
    return similarity.matrix(engine_vocabulary(spark, d), one_needle(spark, d)).select("token", "t_token", F.round("similarity", 5).alias("similarity"))


@query(NEEDLE + ", x AS (SELECT max(idf) AS most FROM ev) SELECT token, t_token, round(s * idf / most, 5) AS similarity FROM m, x")
def idf_scaling(spark, d):
    vocab = engine_vocabulary(spark, d)
    rows = similarity.with_idf(similarity.matrix(vocab, one_needle(spark, d)), vocab, 0.5)
    return rows.select("token", "t_token", F.round("similarity", 5).alias("similarity"))


@query(NEEDLE + " SELECT token, t_token, round(CASE WHEN token = t_token THEN 1.0 ELSE s END, 5) AS similarity FROM m")
def identity_override(spark, d):
    needle = one_needle(spark, d)
    rows = similarity.with_identity(similarity.matrix(engine_vocabulary(spark, d), needle), needle)
    return rows.select("token", "t_token", F.round("similarity", 5).alias("similarity"))


@query(NEEDLE + " SELECT token, t_token, round(pow(CASE WHEN token = t_token THEN 1.0 ELSE s END, 2.5), 5) AS similarity FROM m")
def falloff(spark, d):
    needle = one_needle(spark, d)
    rows = similarity.with_falloff(similarity.with_identity(similarity.matrix(engine_vocabulary(spark, d), needle), needle), 2.5)
    return rows.select("token", "t_token", F.round("similarity", 5).alias("similarity"))


@query(VOCAB + """, needle AS (SELECT token AS t_token, r AS t_pos FROM ranked WHERE r < 6),
m AS (SELECT e.token, n.t_token, list_dot_product(e.vec, t.vec) AS x, greatest(0.0, 1 - sqrt(list_sum(list_transform(list_zip(e.vec, t.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 0.5) / 3 AS y
  FROM needle n JOIN ev t ON t.token = n.t_token, ev e)
SELECT token, t_token, round(greatest(x, y), 5) AS similarity, CASE WHEN x >= y THEN 'cosine' ELSE 'p-norm' END AS origin FROM m""")
def composite_mix(spark, d):
    vocab, needle = engine_vocabulary(spark, d), one_needle(spark, d)
    rows = similarity.composite(similarity.matrix(vocab, needle), similarity.matrix(vocab, needle, "p-norm"), 0.25, "cosine", "p-norm")
    return rows.select("token", "t_token", F.round("similarity", 5).alias("similarity"), "origin")


WEIGHTS = "CASE {} ELSE 1.0 END"


@query(
    TOKENS + f", p AS (SELECT DISTINCT token, CASE {POS} WHEN 'DET' THEN 'DT' WHEN 'NUM' THEN 'CD' ELSE 'NN' END AS tag FROM tok) SELECT token, tag, "
    "round(0.5 + 0.5 * CASE tag WHEN 'DT' THEN 0.7 WHEN 'CD' THEN 0.8 ELSE 0.8 END, 6)::DOUBLE AS weight FROM p"
)
def pos_weighting(spark, d):
    rows = corpus.tokens(docs(spark, d)).select("token", "tag").distinct()
    return rows.select("token", "tag", six(T.pos_weight(F.col("tag"), 0.5)).alias("weight"))


@query(TOKENS + f""", p AS (SELECT DISTINCT token, {POS} AS pos FROM tok)
SELECT token, pos, t_pos, CASE WHEN pos = t_pos THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM p, (SELECT unnest(['DET', 'NOUN']) AS t_pos)""")
def pos_mismatch(spark, d):
    rows = corpus.tokens(docs(spark, d)).select("token", "pos").distinct().select("*", F.explode(F.array(F.lit("DET"), F.lit("NOUN"))).alias("t_pos"))
    return rows.withColumn("weight", S.mismatch_weight(F.col("pos"), F.col("t_pos"), F.lit(1.0), 0.5))


@query(SENTENCES + """, m AS (SELECT doc_id, max(n_tokens) AS longest FROM sn GROUP BY doc_id)
SELECT doc_id, n::INT AS n, CASE WHEN n >= longest THEN 1e10 ELSE round(least(1.0, 1 - pow(2.0, -n / 5.0)), 6) END::DOUBLE AS cost FROM m, range(0, 40) t(n)""")
def gap_curve(spark, d):
    rows = corpus.document_stats(docs(spark, d)).select("doc_id", "max_len_s", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("n"))
    return rows.select("doc_id", "n", six(T.gap_penalty(F.col("n"), 5, F.col("max_len_s"))).alias("cost"))


@query(SENTENCES + f"""
SELECT doc_id, sentence_id, sentence_id % 40 - 1 AS book, CASE WHEN sentence_id % 5 = 0 THEN
    CASE WHEN sentence_id % 40 < 1 THEN 'line ' || sentence_id
    ELSE coalesce({list(T.NUMERALS)}[sentence_id % 40], (sentence_id % 40)::VARCHAR) || '.' || (sentence_id % 7 + 1) || ', line ' || sentence_id END
  WHEN sentence_id % 3 = 0 THEN 'par. ' || sentence_id
  WHEN sentence_id % 40 < 1 THEN 'Chapter ' || (sentence_id % 7 + 1) || ', par. ' || sentence_id
  ELSE 'Book ' || (sentence_id % 40 - 1) || ', Chapter ' || (sentence_id % 7 + 1) || ', par. ' || sentence_id END AS place FROM sn""")
def location_description(spark, d):
    """Sentences placed as in plays (every fifth), by paragraph alone (every third of the others) and as in novels."""
    i = F.col("sentence_id")
    rows = corpus.sentences(docs(spark, d)).select("doc_id", "sentence_id", (i % 40 - 1).alias("book"))
    speaker = F.when(i % 5 == 0, 1).otherwise(-1)
    chapter = F.when((i % 3 == 0) & (speaker < 0), -1).otherwise(i % 7 + 1)
    return rows.select("doc_id", "sentence_id", "book", T.location(F.col("book"), chapter, speaker, i).alias("place"))


SCRIPT = """
WITH c AS (SELECT conv_id, turn AS line_no, role || ': ' || replace(text, chr(10), ' ') AS line FROM conversations),
p AS (SELECT conv_id, line_no, upper(trim(split_part(line, ':', 1))) AS name, trim(substr(line, strpos(line, ':') + 1)) AS text FROM c)"""


def script(spark, d) -> DataFrame:
    line = F.concat_ws(": ", "role", F.replace("text", F.lit("\n"), F.lit(" ")))
    return readers.script_lines(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), line.alias("line")), ["conv_id"])


@query(SCRIPT + """, f AS (SELECT conv_id, name, min(line_no) AS first_line FROM p GROUP BY ALL), i AS (SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY first_line)::INT AS speaker FROM f)
SELECT conv_id, line_no, name, text, speaker FROM p JOIN i USING (conv_id, name)""")
def screenplay_lines(spark, d):
    return script(spark, d).select("conv_id", "line_no", "name", "text", "speaker")


@query(SCRIPT + " SELECT conv_id, name, row_number() OVER (PARTITION BY conv_id ORDER BY min(line_no))::INT AS speaker, count(*) AS n FROM p GROUP BY conv_id, name")
def speaker_ids(spark, d):
    return script(spark, d).groupBy("conv_id", "name", "speaker").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_texts(spark, d):
    return readers.page_texts(table(spark, d, "pages"))


RANKED = """
WITH t AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents),
rec AS (SELECT * FROM t WHERE rank <= 100), truth AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
j AS (SELECT rec.source, rec.rank, rec.doc_id, (truth.doc_id IS NOT NULL)::INT AS rel FROM rec LEFT JOIN truth USING (source, doc_id)),
c AS (SELECT *, sum(rel) OVER (PARTITION BY source ORDER BY rank) AS cumrel FROM j), n AS (SELECT source, count(*) AS n_relevant FROM truth GROUP BY source)"""


def ranking(spark, d) -> tuple[DataFrame, DataFrame]:
    """Recommended: a source's longest documents; relevant: those labelled good."""
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = docs(spark, d).select("source", "doc_id", place.alias("rank")).where("rank <= 100")
    good = table(spark, d, "labels").where("quality = 1")
    truth = docs(spark, d).select("source", "doc_id").join(good, "doc_id", "left_semi")
    return evaluate.judged(rows, truth, ["source"], "doc_id"), evaluate.relevant(truth, ["source"], "doc_id")


@query(RANKED + " SELECT source, rank, doc_id, rel, cumrel::BIGINT AS cumrel FROM c")
def relevance_flags(spark, d):
    return ranking(spark, d)[0].select("source", "rank", "doc_id", "rel", "cumrel")


@query(RANKED + " SELECT source, round(sum(rel) / 10, 6) AS value FROM c WHERE rank <= 10 GROUP BY source")
def precision_at_k(spark, d):
    return evaluate.precision_at_k(ranking(spark, d)[0], ["source"], 10).withColumn("value", six("value"))


@query(RANKED + " SELECT source, round(sum(rel * cumrel / rank) / max(n_relevant), 6) AS value FROM c LEFT JOIN n USING (source) WHERE rank <= 100 GROUP BY source")
def average_precision(spark, d):
    return evaluate.average_precision(*ranking(spark, d), ["source"], 100).withColumn("value", six("value"))


@query(RANKED + " SELECT round(avg(value), 6) AS value FROM (SELECT source, sum(rel * cumrel / rank) / max(n_relevant) AS value FROM c LEFT JOIN n USING (source) GROUP BY source)")
def mean_average_precision(spark, d):
    return evaluate.average_precision(*ranking(spark, d), ["source"], 100).agg(six(F.avg("value")).alias("value"))


@query(RANKED + " SELECT source, round(sum(rel / log2(rank + 1)), 6) AS value FROM c WHERE rank <= 20 GROUP BY source")
def discounted_gain(spark, d):
    return evaluate.discounted_cumulative_gain(ranking(spark, d)[0], ["source"], 20).withColumn("value", six("value"))


@query(RANKED + " SELECT source, round(sum(rel) / max(n_relevant), 6) AS value FROM c JOIN n USING (source) WHERE rank <= n_relevant GROUP BY source")
def r_precision(spark, d):
    return evaluate.r_precision(*ranking(spark, d), ["source"]).withColumn("value", six("value"))


GRID = """
WITH g AS (SELECT a, b, l.lang AS topic FROM (SELECT unnest([1, 2, 3]) AS a), (SELECT unnest([10, 20]) AS b), (SELECT DISTINCT lang FROM documents) l),
v AS (SELECT a, b, topic, count(*) FILTER (doc_id % a = 0) AS value FROM g JOIN documents ON lang = topic GROUP BY ALL),
m AS (SELECT a, b, avg(value) AS value FROM v GROUP BY a, b HAVING count(*) = (SELECT count(DISTINCT lang) FROM documents)),
best AS (SELECT * FROM m WHERE value = (SELECT max(value) FROM m))"""


def grid_values(spark, d) -> tuple[DataFrame, int]:
    points = evaluate.grid(spark, {"b": [10, 20], "a": [1, 2, 3]})
    topics = docs(spark, d).select(F.col("lang").alias("topic"), "doc_id")
    values = topics.crossJoin(F.broadcast(points)).groupBy("a", "b", "topic").agg(F.sum(F.when(F.col("doc_id") % F.col("a") == 0, 1).otherwise(0)).alias("value"))
    return values, topics.select("topic").distinct().count()


@query(GRID + " SELECT a, b, round(value, 6) AS value FROM best")
def grid_optimal(spark, d):
    values, n = grid_values(spark, d)
    return evaluate.optimal(evaluate.mean_over_topics(values, ["a", "b"], n)).select("a", "b", six("value").alias("value"))


@query(GRID + " SELECT a::VARCHAR AS a, string_agg(b::VARCHAR, ', ' ORDER BY b::VARCHAR) AS b, round(value, 6) AS value FROM best GROUP BY a, value")
def merge_dimensions(spark, d):
    values, n = grid_values(spark, d)
    best = evaluate.optimal(evaluate.mean_over_topics(values, ["a", "b"], n)).withColumn("value", six("value"))
    merged = evaluate.merge_all_dimensions(best, ["a", "b"])
    return merged.withColumn("a", F.col("a").cast("string"))


@query(SENTENCES + NEEDLES + f""", q AS (SELECT query_id, {NORMAL.format('sentence')} AS q FROM nl),
t AS (SELECT doc_id, {NORMAL.format('sentence')} AS t FROM sn)
SELECT query_id FROM q WHERE NOT EXISTS (SELECT 1 FROM t WHERE contains(' ' || t.t || ' ', ' ' || q.q || ' '))""")
def unresolved_topics(spark, d):
    """Quotes of any length that no sentence holds."""
    wanted = needles(spark, d).select("query_id")
    return wanted.join(quote_resolver(spark, d).select(F.col("quote_id").alias("query_id")), "query_id", "left_anti")


# A needle of one token: its score is the greater of the floor and the best token similarity.
SINGLE = S.Options(metrics=("cosine",), similarity_threshold=0.11)


def single_queries(spark, d) -> DataFrame:
    rows = corpus.vocabulary(docs(spark, d)).orderBy(F.desc("n"), "token").limit(8)
    place = F.row_number().over(W.orderBy(F.desc("n"), "token"))
    return rows.select(place.cast("long").alias("query_id"), F.col("token").alias("query"))


@query(VOCAB + f""", nd AS (SELECT r + 1 AS query_id, token AS t_token FROM ranked WHERE r < 8),
sim AS (SELECT n.query_id, e.token, CASE WHEN e.token = n.t_token THEN 1.0 ELSE list_dot_product(e.vec, t.vec) END AS s FROM nd n JOIN ev t ON t.token = n.t_token, ev e),
wp AS (SELECT query_id, {POS.replace("token", "t_token")} AS tp FROM nd),
cell AS (SELECT DISTINCT sn.doc_id, sn.sentence_id, unnest(sn.tokens) AS token FROM sn),
hit AS (SELECT query_id, doc_id, sentence_id, max(s) AS s FROM cell JOIN sim USING (token) JOIN wp USING (query_id) WHERE s > 0.11 AND ({POS}) = tp GROUP BY ALL),
sc AS (SELECT n.query_id, sn.doc_id, sn.sentence_id, greatest(0.5, coalesce(h.s, 0)) AS score FROM nd n CROSS JOIN sn LEFT JOIN hit h USING (query_id, doc_id, sentence_id)),
fl AS (SELECT *, first_value(score) OVER (PARTITION BY query_id, doc_id ORDER BY sentence_id) AS f, first_value(sentence_id) OVER (PARTITION BY query_id, doc_id ORDER BY sentence_id) AS fs FROM sc),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, sentence_id DESC) AS dn FROM fl WHERE sentence_id = fs OR score > f),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC, sentence_id DESC)::INT AS place FROM kept WHERE dn <= 101)
SELECT query_id, place, doc_id, sentence_id, round(score, 6) AS score FROM top WHERE place <= 100""")
def search_single_token(spark, d):
    found = corpus_search(spark, d, SINGLE, single_queries(spark, d))
    return found.select("query_id", "place", "doc_id", "sentence_id", six("score").alias("score"))


FULL = S.Options(metrics=("cosine",), pos_mismatch_penalty=0.5, similarity_threshold=0.11)


#: What a user types: texts, not rows of a table.
ASKED = (
    "the rest of that was with the and",
    "une fois que le des les pour",
    "in der und das ist nicht von",
    "que de la los en por",
)


def asked(spark) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ASKED, 1)), "query_id long, query string")


def chosen(spark, d) -> DataFrame:
    """(query_id, query): every sentence of the benchmark items whose id 100 divides."""
    return needles(spark, d).where("query_id div 1000 % 100 = 0")


def corpus_search(spark, d, options: S.Options, queries: DataFrame | None = None, told: int | None = 0) -> DataFrame:
    """told: as in search_corpus."""
    queries = chosen(spark, d) if queries is None else queries
    vocabulary = held_vocabulary(spark, d)  # read for both sides of the matrix, for the table alone
    found = S.search_corpus(docs(spark, d), vocabulary, queries, options, told=told)
    vocabulary.unpersist()
    return found


def scored(found: DataFrame) -> DataFrame:
    return found.select("query_id", "place", "doc_id", "sentence_id", six("score").alias("score"))


def search_sql(metrics: str, threshold: float = 0.11, mismatch: float = 0.5, weight: str = "1.0", skip: str = "false", both: bool = False, grid: str = "", chosen: str = "WHERE (query_id // 1000) % 100 = 0") -> str:
    """A search as SQL, up to ``top`` (m, query_id, place, doc_id, sentence_id, score).

    ``metrics`` selects (m, token, t_token, s) from pairs ``pr`` of vocabulary words and needle tokens nt;
    ``grid`` may give the cells of sentences (gr) in another way. An alignment is a fold over the needle's tokens: each adds the column of its cells (one for each token of the sentence).
    """
    cost = lambda n: f"CASE WHEN {n} >= longest THEN 1e10 ELSE 1 - pow(2.0, -({n}) / 5.0) END"
    v = "x[1][1]::INT"
    column = f"""list_transform([list_transform(range(1, n + 1), lambda u: greatest(0.5, g[u][{v}] + CASE WHEN {v} > 1 AND u > 1 THEN cols[{v} - 1][u - 1] ELSE 0 END,
      coalesce(list_max(list_transform(range(1, {v}), lambda k: cols[k][u] - {cost(f'{v} - k')})), 0.5)))],
      lambda b: list_transform(range(1, n + 1), lambda u: greatest(b[u], coalesce(list_max(list_transform(range(1, u), lambda k: b[k] - {cost('u - k')})), 0.5))))[1]"""
    raw = f"list_max(flatten(list_reduce(list_transform(range(1, len(g[1]) + 1), lambda v: [[v::DOUBLE]]), lambda cols, x: list_append(cols, {column}), []::DOUBLE[][])))"
    turned = "UNION ALL SELECT m, query_id, total, doc_id, sentence_id, n, longest, list_reverse(list_transform(g, lambda r: list_reverse(r))) FROM gr" if both else ""
    pos = lambda c: POS.replace("token", c)
    cells = grid or f"""most AS (SELECT max(idf) AS most FROM ev),
pr AS (SELECT e.token, t.token AS t_token, e.idf / most AS share, e.vec AS a, t.vec AS b FROM ndt JOIN ev t ON t.token = ndt.t_token, ev e, most WHERE e.token <> t.token),
near AS ({metrics}),
sc AS (SELECT m, query_id, token, v, s * (w * CASE WHEN {pos('near.token')} = {pos('nt.t_token')} THEN 1.0 ELSE {mismatch} END) AS score FROM near JOIN nt USING (t_token)),
hit AS (SELECT * FROM sc WHERE score > {threshold}),
ts AS (SELECT m, query_id, token, list(coalesce(score, 0) ORDER BY v) AS l FROM (SELECT DISTINCT m, query_id, token FROM hit)
       JOIN (SELECT query_id, v FROM nt) USING (query_id) LEFT JOIN hit USING (m, query_id, token, v) GROUP BY ALL),
zero AS (SELECT m, query_id, list(0.0::DOUBLE ORDER BY v) AS z, sum(w)::DOUBLE AS total FROM nt, (SELECT DISTINCT m FROM near) GROUP BY m, query_id),
tk AS (SELECT doc_id, sentence_id, n_tokens AS n, max_len_s AS longest, unnest(tokens) AS token, unnest(range(len(tokens))) AS u FROM sn),
gr AS (SELECT m, query_id, any_value(total) AS total, doc_id, sentence_id, any_value(n) AS n, any_value(longest) AS longest, list(coalesce(l, z) ORDER BY u) AS g
       FROM tk CROSS JOIN zero LEFT JOIN ts USING (m, query_id, token) GROUP BY m, query_id, doc_id, sentence_id),"""
    return (
        VOCAB
        + NEEDLES
        + f""",
w0 AS (SELECT query_id, list_filter(words, lambda token: NOT ({skip})) AS words FROM nl {chosen}),
nw AS (SELECT query_id, unnest(words) AS token, unnest(range(len(words)))::INT AS v FROM w0),
nt AS (SELECT query_id, token AS t_token, v, {weight} AS w FROM nw),
ndt AS (SELECT DISTINCT t_token FROM nt),
{cells}
ways AS (SELECT m, query_id, total, doc_id, sentence_id, n, longest, g FROM gr {turned}),
rw AS (SELECT m, query_id, doc_id, sentence_id, max({raw} / total) AS score FROM ways GROUP BY m, query_id, doc_id, sentence_id HAVING max({raw} / total) > 0.2),
fl AS (SELECT *, first_value(score) OVER w AS f, row_number() OVER w AS fn FROM rw WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY m, sentence_id)),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, sentence_id DESC, m) AS dn FROM fl WHERE fn = 1 OR score > f),
pl AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC, sentence_id DESC, m)::INT AS place FROM kept WHERE dn <= 101),
top AS (SELECT * FROM pl WHERE place <= 100)"""
    )


COSINE_SQL = "SELECT 0 AS m, token, t_token, list_dot_product(a, b) AS s FROM pr UNION ALL SELECT 0, t_token, t_token, 1.0 FROM ndt"
SCORED = " SELECT query_id, place, doc_id, sentence_id, round(score, 6) AS score FROM top"


@query(search_sql(COSINE_SQL) + SCORED)
def search_full(spark, d):
    """Several needles against the whole corpus, in one scan."""
    return scored(corpus_search(spark, d, FULL))


@query(search_sql(COSINE_SQL, both=True) + SCORED)
def search_reversed(spark, d):
    """The better of the alignment and that of both sequences reversed."""
    return scored(corpus_search(spark, d, S.Options(similarity_threshold=0.11, pos_mismatch_penalty=0.5, bidirectional=True)))


@query()
def search_bidirectional(spark, d):
    """As search_reversed, with a weight for what is left unmatched; tests/test_search.py holds it against plain Python."""
    options = S.Options(similarity_threshold=0.11, pos_mismatch_penalty=0.5, bidirectional=True, submatch_weight=2.0)
    return corpus_search(spark, d, options, told=None).select("query_id", "place", "doc_id", "sentence_id", six("score").alias("score"), "match")


def shape_encoder(sentences: list[list[str]]) -> list:
    """An encoder for tests of the plan: one layer for a token's shape, one for that of the token before it."""
    own = np.array([(len(t), t.count("e"), 1.0) for tokens in sentences for t in tokens]).reshape(-1, 3)
    ends = np.cumsum([len(tokens) for tokens in sentences])
    both = np.stack([own, np.concatenate([np.zeros((1, 3)), own])[:-1]]) if len(own) else np.zeros((2, 0, 3))
    both[1, ends[:-1][ends[:-1] < len(own)]] = 0.0  # nothing stands before a sentence
    return [both[:, end - len(tokens) : end] for tokens, end in zip(sentences, ends.tolist(), strict=True)]


def _shapes(rows: str, keys: str, at: str) -> str:
    parts = ["len(token)", "len(token) - len(replace(token, 'e', ''))", "1"]
    mean = ", ".join(f"(({x}) + coalesce(lag({x}) OVER w, 0)) / 2.0" for x in parts)
    return f"SELECT *, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS vec FROM (SELECT {keys}, {at}, [{mean}]::DOUBLE[] AS r FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY {at}))"


SHAPES_SQL = f"""tk AS (SELECT doc_id, sentence_id, n_tokens AS n, max_len_s AS longest, unnest(tokens) AS token, unnest(range(len(tokens))) AS u FROM sn),
ov AS ({_shapes("tk", "doc_id, sentence_id, n, longest", "u")}), nv AS ({_shapes("nw", "query_id", "v")}),
ct AS (SELECT query_id, count(*)::DOUBLE AS total FROM nw GROUP BY query_id),
rr AS (SELECT query_id, doc_id, sentence_id, n, longest, u, list(list_dot_product(ov.vec, nv.vec) ORDER BY v) AS r FROM ov, nv GROUP BY ALL),
gr AS (SELECT 0 AS m, query_id, any_value(total) AS total, doc_id, sentence_id, n, longest, list(r ORDER BY u) AS g FROM rr JOIN ct USING (query_id) GROUP BY query_id, doc_id, sentence_id, n, longest),"""


@query(search_sql("", grid=SHAPES_SQL) + SCORED)
def contextual_search(spark, d):
    """Search by vectors of occurrences, here from an encoder that looks at the shapes of a token and the one before it."""
    return scored(contextual.search_documents(docs(spark, d), chosen(spark, d), shape_encoder))


# Both metrics are scaled by idf before words count as wholly similar to themselves, then raised to the falloff. A mix
# at 0.25 weighs its first metric by 1 and its second by 1/3.
MIXED_SQL = """
SELECT 0 AS m, token, t_token, pow(list_dot_product(a, b) * share, 2.0) AS s FROM pr UNION ALL SELECT 0, t_token, t_token, 1.0 FROM ndt
UNION ALL SELECT 1, token, t_token, greatest(pow(list_dot_product(a, b) * share, 2.0),
  pow(greatest(0.0, 1 - sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) * 0.5) * share, 2.0) * (0.5 / 1.5)) FROM pr
UNION ALL SELECT 1, t_token, t_token, 1.0 FROM ndt"""
TAG_SQL = f"CASE {POS} WHEN 'DET' THEN 0.85 WHEN 'NUM' THEN 0.9 ELSE 0.9 END::DOUBLE"


@query(search_sql(MIXED_SQL, weight=TAG_SQL, skip=f"token IN {DETERMINERS}") + " SELECT m AS metric_no, query_id, place, doc_id, sentence_id, round(score, 6) AS score FROM top")
def search_mixed(spark, d):
    """Two metrics, one a mix; idf, falloff and part-of-speech weights on."""
    options = S.Options(
        metrics=("cosine", ("cosine", "p-norm", 0.25)), idf_weight=0.5, similarity_falloff=2.0, pos_mismatch_penalty=0.5,
        pos_weights={k: 0.5 + 0.5 * w for k, w in T.TAG_WEIGHTS.items()}, similarity_threshold=0.11, ignore_determiners=True,
    )
    return corpus_search(spark, d, options).select("metric_no", "query_id", "place", "doc_id", "sentence_id", six("score").alias("score"))


MEASURES = [{"type": "average_precision", "n": 100}, {"type": "discounted_cumulative_gain", "n": 20}, {"type": "precision_at_k", "k": 10}, {"type": "r_precision"}]
THRESHOLDS = [0.11, 0.6]


def evaluated(spark, d) -> DataFrame:
    """Every sentence of the benchmark is a topic. Its truth: sentences that have at least four of its different words."""
    vocabulary, topics = held_vocabulary(spark, d), needles(spark, d)
    values = {"similarity_threshold": THRESHOLDS, "pos_mismatch_penalty": [0.5]}
    truth = evaluation.SharedWords(docs(spark, d), S.needles(topics, FULL).select("query_id", "t_token"), least=4)
    rows = evaluation.run_grid(docs(spark, d), vocabulary, topics, truth, values, MEASURES)
    vocabulary.unpersist()
    return rows


EVALUATED_SQL = (
    " UNION ALL ".join(f"SELECT {t}::DOUBLE AS similarity_threshold, * FROM ({search_sql(COSINE_SQL, threshold=t, chosen='')} SELECT query_id, place AS rank, doc_id, sentence_id FROM top)" for t in THRESHOLDS)
)
EVALUATED_SQL = f"""WITH found AS ({EVALUATED_SQL}),
truth AS ({SENTENCES}{NEEDLES}, own AS (SELECT DISTINCT query_id, unnest(words) AS token FROM nl),
  w AS (SELECT DISTINCT doc_id, sentence_id, unnest(tokens) AS token FROM sn)
  SELECT query_id, doc_id, sentence_id FROM w JOIN own USING (token) GROUP BY ALL HAVING count(*) >= 4),
n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY query_id),
j AS (SELECT f.similarity_threshold, f.query_id, f.rank, (t.doc_id IS NOT NULL)::INT AS rel FROM found f LEFT JOIN truth t USING (query_id, doc_id, sentence_id)),
c AS (SELECT *, sum(rel) OVER (PARTITION BY similarity_threshold, query_id ORDER BY rank) AS cumrel FROM j JOIN n USING (query_id)),
m AS (SELECT similarity_threshold, query_id, coalesce(sum(rel * cumrel / rank) / any_value(n), 0) AS "ap@100", coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= 20), 0) AS "dcg@20",
  coalesce(sum(rel) FILTER (rank <= 10), 0) / 10 AS "precision_at_k@10", coalesce(sum(rel) FILTER (rank <= n), 0) / any_value(n) AS r_precision FROM c GROUP BY similarity_threshold, query_id),
e AS (SELECT t.similarity_threshold, n.query_id, coalesce("ap@100", 0) AS "ap@100", coalesce("dcg@20", 0) AS "dcg@20", coalesce("precision_at_k@10", 0) AS "precision_at_k@10", coalesce(r_precision, 0) AS r_precision
  FROM n CROSS JOIN (SELECT unnest({THRESHOLDS})::DOUBLE AS similarity_threshold) t LEFT JOIN m USING (similarity_threshold, query_id)),
v AS (UNPIVOT e ON "ap@100", "dcg@20", "precision_at_k@10", r_precision INTO NAME measure VALUE value)"""


@query(EVALUATED_SQL + " SELECT similarity_threshold, query_id, measure, round(value, 6) AS value FROM v")
def evaluation_grid(spark, d):
    """All needles searched at every point of a grid of options, and what the results are worth."""
    return evaluated(spark, d).select("similarity_threshold", "query_id", "measure", six("value").alias("value"))


@query()
def evaluation_best(spark, d):
    """The point of the grid with the best mean average precision; tests/test_evaluation.py holds it against plain Python."""
    return evaluation.best_points(evaluated(spark, d), ["similarity_threshold"], "ap@100").withColumn("value", six("value"))


@query()
def match_regions(spark, d):
    found = corpus_search(spark, d, FULL, told=10).where("place <= 10")
    out = regions.regions(found, corpus.sentences(docs(spark, d)), S.needles(chosen(spark, d), FULL), FULL.cutoff, docs=docs(spark, d))
    return out.select("query_id", "place", "doc_id", "sentence_id", F.to_json("regions").alias("regions"), F.array_join("omitted", " ").alias("omitted"))


@query("SELECT lang AS query_id, doc_id, 0 AS sentence_id, n_chars::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id DESC) AS n FROM documents) WHERE n <= 20")
def progressive_topk(spark, d):
    """The running top-k over two halves of the corpus is that of the whole."""
    rows = docs(spark, d).select(F.col("lang").alias("query_id"), "doc_id", F.lit(0).alias("sentence_id"), F.col("n_chars").cast("double").alias("score"))
    first = incremental.merged(None, rows.where("doc_id % 2 = 0"), 20)
    return incremental.merged(first, rows.where("doc_id % 2 = 1"), 20)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user types, against the whole corpus."""
    return scored(corpus_search(spark, sf_dir, FULL, asked(spark)))
