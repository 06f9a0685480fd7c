"""Text, search and vectors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from halyard.functions import text as X
from halyard.functions import vectors as V
from halyard.operators import search as H
from halyard.queries.registry import query
from halyard.sources.tables import load_table

_FOLD = "translate(lower({}), 'áéíóúüñ', 'aeiouun')"
_SEARCH_FOLD = "translate({}, 'áàäâéèëêíìïîóòöôúùüûñÁÀÄÂÉÈËÊÍÌÏÎÓÒÖÔÚÙÜÛÑABCDEFGHIJKLMNOPQRSTUVWXYZ', 'aaaaeeeeiiiioooouuuunaaaaeeeeiiiioooouuuunabcdefghijklmnopqrstuvwxyz')"


def _docs(spark, sf_dir):
    """Documents as search documents: source as code, language as title."""
    d = load_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("code"), F.col("lang").alias("title"), F.col("text").alias("description"))


def _parts(spark, sf_dir):
    """Parts, with names short enough for edit distances."""
    p = load_table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("code"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))


@query(f"SELECT doc_id, {_FOLD.format('text')} AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return load_table(spark, sf_dir, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, list_filter(regexp_split_to_array({_SEARCH_FOLD.format('text')}, '[^a-z0-9]+'), lambda t: length(t) >= 2) AS tokens FROM documents")
def tokenize_search(spark, sf_dir):
    return load_table(spark, sf_dir, "documents").select("doc_id", X.tokens_search(F.col("text")).alias("tokens"))


_TRI = "list_sort(list_distinct([substr('  ' || {x} || ' ', i, 3) FOR i IN range(1, length({x}) + 2)]))"


@query(f"SELECT p_partkey, {_TRI.format(x=_FOLD.format('trim(p_name)'))} AS grams FROM part")
def trigrams(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", X.trigrams(F.col("p_name")).alias("grams"))


@query(f"WITH t AS (SELECT p_partkey, {_TRI.format(x=_FOLD.format('trim(p_name)'))} AS g FROM part), q AS (SELECT {_TRI.format(x=_FOLD.format(chr(39) + 'small ring' + chr(39)))} AS g) SELECT p_partkey, len(list_intersect(q.g, t.g)) / len(q.g) AS ratio FROM t, q", doubles="ratio")
def trigram_similarity(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", H.trigram_ratio(F.lit("small ring"), F.col("p_name")).alias("ratio"))


@query()
def trigram_candidates(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return H.trigram_candidates(p, F.col("title"), "small ring")


def _phonetic_sql(x: str, pairs=()) -> str:
    for a, b in (*pairs, *X.PHONETIC):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"regexp_replace({x}, '[^b-df-hj-np-tv-z0-9]', '', 'g')"
    for c in "bcdfghjklmnpqrstvwxyz0123456789":
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return f"upper({x})"


@query(f"SELECT p_partkey, {_phonetic_sql(_SEARCH_FOLD.format('p_name'))} AS sound FROM part")
def phonetic_key(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", X.phonetic(F.col("p_name")).alias("sound"))


@query(f"SELECT c_custkey, {_phonetic_sql(_SEARCH_FOLD.format('c_mktsegment'), X.METAPHONE_FIRST)} AS first, {_phonetic_sql(_SEARCH_FOLD.format('c_mktsegment'), X.METAPHONE_SECOND)} AS second FROM customer")
def metaphone_pair(spark, sf_dir):
    return load_table(spark, sf_dir, "customer").select("c_custkey", X.metaphone(F.col("c_mktsegment")).alias("m")).select("c_custkey", "m.first", "m.second")


@query("SELECT p_partkey, damerau_levenshtein(p_name, 'small rnig')::INT AS d FROM part")
def edit_distance(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", X.edit_distance(F.col("p_name"), F.lit("small rnig")).alias("d"))


@query()
def fuzzy_match(spark, sf_dir):
    return load_table(spark, sf_dir, "part").where(X.fuzzy_match(F.col("p_name"), "smal rnig")).select("p_partkey", "p_name")


@query()
def canonical_code(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", X.canonical_code(F.col("p_brand")).alias("code"))


@query("SELECT p_partkey, 'PRT-' || CASE WHEN length(p_partkey::VARCHAR) >= 4 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 4, '0') END AS code FROM part")
def padded_code(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", X.padded_code("PRT", F.col("p_partkey")).alias("code"))


@query("SELECT p_partkey, p_name || ' (' || CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE printf('%.2f', p_retailprice) END || ')' AS label FROM part")
def label_values(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    return p.select("p_partkey", X.label("{{p_name}} ({{ part/p_retailprice }}){{nothing}}", p.columns, dict(p.dtypes)).alias("label"))


_TERMS = ["the", "tion", "que"]


def _bm25_sql() -> str:
    fields = {"code": 5.0, "title": 3.5, "description": 1.0}
    tf = lambda t: " + ".join(f"CASE WHEN contains({f}, '{t}') THEN {w} ELSE 0 END" for f, w in fields.items())
    parts = ", ".join(f"({tf(t)}) AS tf{i}, (SELECT greatest(count(DISTINCT doc_id), 1) FROM terms WHERE term = '{t}') AS df{i}" for i, t in enumerate(_TERMS))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / mean)) ELSE 0 END" for i in range(len(_TERMS)))
    return f"""WITH d AS (SELECT doc_id, {_SEARCH_FOLD.format('source')} AS code, {_SEARCH_FOLD.format('lang')} AS title, {_SEARCH_FOLD.format('text')} AS description FROM documents),
        terms AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(code || ' ' || title || ' ' || description, '[^a-z0-9]+')) AS term FROM d),
        s AS (SELECT *, strlen(code) + strlen(title) + strlen(description) AS size FROM d), m AS (SELECT count(*) AS n, avg(size) AS mean FROM s),
        t AS (SELECT doc_id, size, n, mean, {parts} FROM s, m)
        SELECT doc_id, {score} AS bm25f FROM t ORDER BY bm25f DESC, doc_id LIMIT 50"""


@query(_bm25_sql(), doubles="bm25f")
def bm25_topk(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return H.bm25f(docs, H.inverted_index(docs), _TERMS).orderBy(F.desc("bm25f"), "doc_id").limit(50)


@query()
def hybrid_search(spark, sf_dir):
    return H.hybrid_search(_parts(spark, sf_dir), "smal gizmo brand 17")


@query()
def ranked_candidates(spark, sf_dir):
    return H.rank_candidates(_parts(spark, sf_dir), "title", "smal rnig")


_QUERY_VECTOR = [math.sin(i + 1) for i in range(64)]
_Q = "[" + ", ".join(f"{x!r}::FLOAT" for x in _QUERY_VECTOR) + "]"


@query(f"WITH q AS (SELECT {_Q} AS q), s AS (SELECT vec_id, list_sum([a::DOUBLE * b::DOUBLE FOR (a, b) IN list_zip(embedding, q)]) / sqrt(list_sum([a::DOUBLE * a::DOUBLE FOR a IN embedding]) * list_sum([a::DOUBLE * a::DOUBLE FOR a IN q])) AS c FROM embeddings, q) SELECT vec_id, c AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 20".replace("[a::DOUBLE * b::DOUBLE FOR (a, b) IN list_zip(embedding, q)]", "list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)"), doubles="similarity")
def cosine_topk(spark, sf_dir):
    return H.nearest(load_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 20, V.cosine)


@query(f"WITH q AS (SELECT {_Q} AS q), s AS (SELECT vec_id, list_zip(embedding, q) AS z, list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum([a::DOUBLE * a::DOUBLE FOR a IN embedding]) * list_sum([a::DOUBLE * a::DOUBLE FOR a IN q])) AS c FROM embeddings, q) SELECT vec_id, 0.3 * len(list_filter(z, lambda p: (p[1] >= 0) = (p[2] >= 0))) / len(z) + 0.7 * greatest(c, 0) AS similarity FROM s ORDER BY similarity DESC, vec_id LIMIT 20", doubles="similarity")
def vector_similarity_topk(spark, sf_dir):
    return H.nearest(load_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 20)


@query()
def text_embedding(spark, sf_dir):
    return load_table(spark, sf_dir, "part").select("p_partkey", V.embedding(F.col("p_name"), 32).alias("embedding"))


@query("WITH a AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 100), b AS (SELECT p_partkey AS doc_id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS r FROM part QUALIFY r <= 100) SELECT doc_id, sum(w / (60 + r)) AS score FROM (SELECT doc_id, r, 1.0 AS w FROM a UNION ALL SELECT doc_id, r, 0.5 FROM b) GROUP BY 1", doubles="score")
def rank_fusion(spark, sf_dir):
    p = load_table(spark, sf_dir, "part")
    top = lambda c: p.select(F.col("p_partkey").alias("doc_id"), F.col(c).cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(100)
    return H.fuse({"price": (top("p_retailprice"), 1.0), "size": (top("p_size"), 0.5)})
