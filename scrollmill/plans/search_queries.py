"""Index, BM25, phrases, substring search, fills, snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from scrollmill.functions.times import iso
from scrollmill.operators import search
from scrollmill.plans.testbed import QUERIES, STORE_SQL, conversations, documents_as_messages, messages, query, query_table

TOKENS_SQL = r"""t AS (SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents))"""
ASKED_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUERIES)) + ") v(query_id, query))"
TERMS_SQL = r"""terms AS (SELECT query_id, unnest(range(len(ts))) AS term_no, unnest(ts) AS term FROM (SELECT query_id, string_split(query, ' ') AS ts FROM q)),
parts AS (SELECT query_id, term_no, regexp_extract_all(lower(strip_accents(term)), '[\p{L}\p{N}]+') AS ps FROM terms)"""
HITS_SQL = f"""{TOKENS_SQL}, {ASKED_SQL}, {TERMS_SQL},
k AS (SELECT query_id, term_no, len(ps) AS n, unnest(ps) AS token, unnest(range(len(ps))) AS off FROM parts),
starts AS (SELECT query_id, term_no, doc_id, pos - off AS s FROM k JOIN t USING (token) GROUP BY query_id, term_no, doc_id, pos - off, n HAVING count(*) = n),
hits AS (SELECT query_id, term_no, doc_id, count(*) AS freq FROM starts GROUP BY ALL)"""
BM25_SQL = f"""{HITS_SQL}, lens AS (SELECT d.doc_id, count(token) AS dl FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS a FROM lens),
df AS (SELECT query_id, term_no, count(*) AS df FROM hits GROUP BY ALL),
w AS (SELECT h.query_id, h.doc_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * freq * 2.2 / (freq + 1.2 * (0.25 + 0.75 * dl / a)) AS part FROM hits h JOIN df USING (query_id, term_no) JOIN lens USING (doc_id), st),
need AS (SELECT query_id, count(*) AS n, min(len(ps)) AS least FROM parts GROUP BY 1),
s0 AS (SELECT query_id, doc_id, -sum(part) AS score, count(*) AS held FROM w GROUP BY query_id, doc_id),
sc AS (SELECT s0.query_id, doc_id, score FROM s0 JOIN need ON need.query_id = s0.query_id AND need.n = held AND need.least > 0),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id DESC) AS row FROM sc),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY row) AS rank, doc_id, score FROM r1 WHERE row <= 50)"""


def corpus(spark, sf_dir):
    m = documents_as_messages(spark, sf_dir)
    c = m.select(F.col("conversation_id").alias("id"), "title", F.col("created_at").alias("updated_at"))
    return m, c, search.build_index(m)


@query("token_df", f"WITH {TOKENS_SQL} SELECT token, count(DISTINCT doc_id) AS df FROM t GROUP BY 1")
def token_df(spark, sf_dir):
    return corpus(spark, sf_dir)[2].token_df()


@query("corpus_stats", f"WITH {TOKENS_SQL}, l AS (SELECT d.doc_id, count(token) AS dl FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1) SELECT count(*) AS n_rows, CAST(sum(dl) AS BIGINT) AS n_tokens, round(avg(dl), 6) AS avg_dl FROM l")
def corpus_stats(spark, sf_dir):
    return corpus(spark, sf_dir)[2].stats().withColumn("avg_dl", F.round("avg_dl", 6))


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS message_id, round(score, 6) AS score FROM ranked WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    m, c, index = corpus(spark, sf_dir)
    found = search.best_per_conversation(search.bm25_scores(index, query_table(spark)), c, 10, True)
    return found.select(F.col("query_id").cast("int"), "rank", "message_id", F.round("score", 6).alias("score"))


@query("phrase_search", f"WITH {HITS_SQL} SELECT query_id, CAST(term_no AS INT) AS term_no, CAST(doc_id AS VARCHAR) AS message_id, freq FROM hits")
def phrase_search(spark, sf_dir):
    index = corpus(spark, sf_dir)[2]
    return search.phrase_hits(index, search.terms_of(query_table(spark))).select(F.col("query_id").cast("int"), "term_no", "message_id", "freq")


LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SUB_SQL = f"""sub0 AS (SELECT q.query_id, d.doc_id FROM q, documents d WHERE (SELECT bool_and(contains({LOW.format('d.text')}, {LOW.format('x')})) FROM (SELECT unnest(string_split(q.query, ' ')) AS x))),
sub AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id DESC) AS rank FROM sub0)"""


@query("substring_search", f"WITH {ASKED_SQL}, {SUB_SQL} SELECT query_id, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS message_id FROM sub WHERE rank <= 10")
def substring_search(spark, sf_dir):
    m = documents_as_messages(spark, sf_dir)
    c = m.select(F.col("conversation_id").alias("id"), "title", F.col("created_at").alias("updated_at"))
    return search.substring_matches(m.drop("title"), c, query_table(spark), 10).select(F.col("query_id").cast("int"), "rank", "message_id")


RARE_QUERIES = QUERIES + ("hbleat", "own cl", "f-the-", "erkei", "é", "GNU gen", "nsed under the apach", "-")
RARE_SQL = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(RARE_QUERIES)) + ") v(query_id, query))"


@query("substring_indexed", f"WITH {RARE_SQL}, {SUB_SQL} SELECT query_id, CAST(rank AS INT) AS rank, CAST(doc_id AS VARCHAR) AS message_id FROM sub WHERE rank <= 10")
def substring_indexed(spark, sf_dir):
    """Parts of words, and punctuation between them: texts are read where the index shows all rare pieces."""
    m, c, index = corpus(spark, sf_dir)
    asked = spark.createDataFrame(list(enumerate(RARE_QUERIES)), "query_id long, query string")
    return search.substring_matches(m.drop("title"), c, asked, 10, index).select(F.col("query_id").cast("int"), "rank", "message_id")


@query("search_filled", f"WITH {BM25_SQL}, {SUB_SQL}, two AS (SELECT query_id, doc_id, 0 AS stage, rank, round(score, 6) AS score FROM ranked WHERE rank <= 10 UNION ALL SELECT s.query_id, s.doc_id, 1, s.rank, 0.0 FROM sub s WHERE s.rank <= 10 AND NOT EXISTS (SELECT 1 FROM ranked r WHERE r.rank <= 10 AND r.query_id = s.query_id AND r.doc_id = s.doc_id)), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, rank) AS place FROM two) SELECT query_id, CAST(place AS INT) AS rank, CAST(doc_id AS VARCHAR) AS message_id, score FROM p WHERE place <= 10")
def search_filled(spark, sf_dir):
    m, c, index = corpus(spark, sf_dir)
    found = search.search_many(m.drop("title"), c, index, query_table(spark), 10)
    return found.select(F.col("query_id").cast("int"), "rank", "message_id", F.round("score", 6).alias("score"))


@query("snippets")
def snippets(spark, sf_dir):
    m, c, index = corpus(spark, sf_dir)
    found = search.search_many(m.drop("title"), c, index, query_table(spark), 10)
    return search.with_snippets(found, m, query_table(spark)).select("query_id", "rank", "message_id", "snippet", "uri")


@query("substring_conversations", f"WITH {STORE_SQL}, q AS (SELECT * FROM (VALUES (0, 'the'), (1, 'thing re'), (2, 'ZZZ')) v(query_id, query)), h AS (SELECT query_id, m.conversation_id, m.message_id, c.updated_at, row_number() OVER (PARTITION BY query_id, m.conversation_id ORDER BY m.created_at DESC, m.message_id) AS own FROM q, m JOIN c ON c.id = m.conversation_id WHERE (SELECT bool_and(contains({LOW.format('c.title')}, {LOW.format('x')}) OR contains({LOW.format('m.text')}, {LOW.format('x')})) FROM (SELECT unnest(string_split(q.query, ' ')) AS x))), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY updated_at DESC, conversation_id) AS rank FROM h WHERE own = 1) SELECT query_id, CAST(rank AS INT) AS rank, conversation_id, message_id FROM r WHERE rank <= 10")
def substring_conversations(spark, sf_dir):
    asked = spark.createDataFrame([(0, "the"), (1, "thing re"), (2, "ZZZ")], "query_id long, query string")
    found = search.substring_matches(messages(spark, sf_dir).drop("updated_at"), conversations(spark, sf_dir), asked, 10)
    return found.select(F.col("query_id").cast("int"), "rank", "conversation_id", "message_id")
