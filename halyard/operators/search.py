"""Text and vector search over (doc_id, code, title, description, embedding).

The index is two tables: (term, doc_id) of the documents' distinct tokens, and
the lexicon of distinct terms with their keys. A query is matched with the
lexicon, and only the terms that match meet their documents.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halyard.functions.text import edit_distance, fold_search, metaphone, ngrams_2_3, osa, overlap_ratio, phonetic, py_code, py_fold, py_metaphone, py_ngrams, py_phonetic, py_tokens_search, py_trigrams, tokens_search, trigrams
from halyard.functions.vectors import literal, similarity

BOOSTS = {"code": 5.0, "title": 3.5, "description": 1.0}
K1, B = 1.2, 0.75


def inverted_index(docs: DataFrame, fields=tuple(BOOSTS)) -> DataFrame:
    """(term, doc_id), each pair once."""
    text = F.concat_ws(" ", *(F.col(f) for f in fields))
    return docs.select("doc_id", F.explode(F.array_distinct(tokens_search(text))).alias("term"))


def lexicon(index: DataFrame) -> DataFrame:
    """(term, df, sound, grams) of distinct terms."""
    return index.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", phonetic(F.col("term")).alias("sound"), ngrams_2_3(F.col("term")).alias("grams"))


def query_tokens(text: str, synonyms: dict[str, list[str]] | None = None) -> list[str]:
    """Tokens of a query, its canonical code, and their synonyms (both ways)."""
    out = list(dict.fromkeys(py_tokens_search(text)))
    code = py_code(text).lower()
    if len(code) >= 3 and code not in out:
        out.append(code)
    for t in list(out):
        for a, group in (synonyms or {}).items():
            words = [a, *group]
            if t in words:
                out += [w for w in words if w not in out]
    return out


def bm25f(docs: DataFrame, index: DataFrame, tokens: list[str]) -> DataFrame:
    """(doc_id, bm25f): fields that hold a token as a substring add their boosts; lengths are in bytes of the folded text."""
    folded = [fold_search(F.coalesce(F.col(f), F.lit(""))) for f in BOOSTS]
    sized = docs.select("doc_id", *(c.alias(f) for c, f in zip(folded, BOOSTS, strict=True)))
    sized = sized.withColumn("size", sum((F.octet_length(f) for f in BOOSTS), F.lit(0)).cast("double"))
    # two numbers about the collection and one for each token of the query
    n, mean = sized.agg(F.count("*"), F.avg("size")).first()
    df = {r.term: r.df for r in index.where(F.col("term").isin(tokens)).groupBy("term").agg(F.count("*").alias("df")).collect()} if tokens else {}
    norm = 1 - B + B * F.col("size") / max(mean or 1.0, 1.0)
    score = F.lit(0.0)
    for t in tokens:
        tf = sum((F.when(F.contains(F.col(f), F.lit(t)), w).otherwise(0.0) for f, w in BOOSTS.items()), F.lit(0.0))
        d = float(max(df.get(t, 1), 1))
        idf = F.ln(F.lit((max(n, 1) - d + 0.5) / (d + 0.5) + 1))
        score = score + F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * norm)).otherwise(0.0)
    return sized.select("doc_id", score.alias("bm25f"))


def term_bonus(lex: DataFrame, token: str) -> DataFrame:
    """(term, bonus) of lexicon terms for one query token: exact 3, edit distance 0, 1, 2 gives 3, 2, 1.2 and 1.5 more, sound 2.5, metaphone 1.5."""
    near = F.when(F.abs(F.length("term") - len(token)) <= 2, edit_distance(F.col("term"), F.lit(token)))
    d = lex.withColumn("d", near)
    sound, (first, _) = py_phonetic(token), py_metaphone(token)
    bonus = (F.when(F.col("term") == token, 3.0).otherwise(0.0) + F.when(F.col("d") == 0, 3.0).when(F.col("d") == 1, 2.0).when(F.col("d") == 2, 1.2).otherwise(0.0)
             + F.when(F.col("d") <= 2, 1.5).otherwise(0.0) + F.when(F.col("sound") == sound, 2.5).otherwise(0.0) + F.when(F.col("sound") == first, 1.5).otherwise(0.0))
    return d.select("term", bonus.alias("bonus")).where("bonus > 0")


def hybrid_search(docs: DataFrame, text: str = "", vector: list[float] | None = None, k: int = 10, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, score, bm25f, bonus, vector_similarity) of the best ``k`` documents, ties by id."""
    index = inverted_index(docs)
    lex = lexicon(index)
    tokens = query_tokens(text, synonyms)
    parts = []
    for t in tokens:
        parts.append(index.join(term_bonus(lex, t), "term").select("doc_id", "bonus"))
        grams = py_ngrams(t)
        if grams:
            hit = lex.select("term", F.explode("grams").alias("g")).where(F.col("g").isin(grams))
            share = index.join(hit, "term").select("doc_id", "g").distinct().groupBy("doc_id").agg((F.count("*") / len(grams)).alias("share"))
            parts.append(share.where("share >= 0.35").select("doc_id", (F.col("share") * 1.5).alias("bonus")))
    out = bm25f(docs, index, tokens)
    if parts:
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        out = out.join(union.groupBy("doc_id").agg(F.sum("bonus").alias("bonus")), "doc_id", "left")
    out = out.withColumn("bonus", F.coalesce("bonus", F.lit(0.0)) if parts else F.lit(0.0))
    if vector is not None:
        sims = docs.select("doc_id", F.coalesce(similarity(F.col("embedding"), literal(vector)), F.lit(0.0)).alias("vector_similarity"))
        out = out.join(sims, "doc_id")
    else:
        out = out.withColumn("vector_similarity", F.lit(0.0))
    if tokens:
        out = out.where((F.col("bm25f") != 0) | (F.col("bonus") != 0) | (F.col("vector_similarity") >= 0.65))
    score = F.col("bm25f") + F.col("bonus") + 5 * F.col("vector_similarity")
    return out.select("doc_id", score.alias("score"), "bm25f", "bonus", "vector_similarity").orderBy(F.desc("score"), "doc_id").limit(k)


def nearest(df: DataFrame, id_col: str, vector_col: str, query: list[float], k: int, measure=similarity) -> DataFrame:
    """The ``k`` most similar vectors, ties by id."""
    return df.select(F.col(id_col), measure(F.col(vector_col), literal(query)).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def fuse(rankings: dict[str, tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(doc_id, score): sums of weight / (k + rank) over rankings of (doc_id, score)."""
    out = None
    for df, weight in rankings.values():
        r = F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))  # rankings are top-k lists
        part = df.select("doc_id", (F.lit(weight) / (k + r)).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id").agg(F.sum("s").alias("score"))


def trigram_candidates(docs: DataFrame, text: Column, term: str) -> DataFrame:
    """(doc_id, matches): documents with at least half of the term's trigrams (one at least)."""
    grams = trigrams(F.lit(term))
    least = F.greatest(F.floor(F.size(grams) / 2), F.lit(1))
    n = F.size(F.array_intersect(trigrams(text), grams))
    return docs.select("doc_id", n.alias("matches"), least.alias("least")).where("matches >= least").select("doc_id", "matches")


def trigram_ratio(a: Column, b: Column) -> Column:
    """Share of ``a``'s trigrams in ``b``."""
    return overlap_ratio(trigrams(a), trigrams(b))


def sounds(text: Column) -> Column:
    """Phonetic and metaphone codes of a text's tokens."""
    return F.transform(tokens_search(text), lambda t: F.struct(phonetic(t).alias("sound"), metaphone(t)["first"].alias("metaphone")))


def rank_candidates(docs: DataFrame, text_col: str, term: str, most: int = 2, least: float = 0.25) -> DataFrame:
    """(doc_id, score): substring, trigram, code, sound and edit-distance scores added up; at least ``least``."""
    low, code = py_fold(term.strip()), py_code(term)
    grams, sound = py_trigrams(term), py_phonetic(low)
    toks = [t for t in re.split(r"[\W_]+", low) if t]
    token_sounds = {py_phonetic(t) for t in toks if len(t) >= 3} - {""} | ({sound} if sound else set())

    def score(text: str) -> float:
        d = py_fold(text or "")
        out = 1.0 if low and low in d else 0.85 if len(toks) > 1 and all(t in d for t in toks) else 0.0
        out += len(grams & py_trigrams(text or "")) / max(len(grams), 1)
        out += 0.65 if len(code) >= 2 and code in py_code(text or "") else 0.0
        words = {w for w in re.split(r"[\W_]+", d) if w}
        out += 0.5 if any(py_phonetic(w) in token_sounds for w in words) else 0.0
        dist = min((osa(t, w, most) for t in toks for w in words if abs(len(t) - len(w)) <= most), default=most + 1)
        return out + (1 / (1 + dist) if dist <= most else 0.0)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(score)

    if not grams:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    return docs.select("doc_id", run(F.col(text_col)).alias("score")).where(F.col("score") >= least)
