"""Vector views of documents: TF-IDF, token embeddings, pooling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.arrays import as_double
from codestrata.functions.text import tfidf_terms
from codestrata.scale import SMALL_ROWS, hash_int, range_running, salted_join, stable_hash
from codestrata.session import cut

ATTENTION_EPSILON = 1e-7
DOCS = 2000  # whose terms a task counts or weighs at a time
PART_TOKENS = 500_000  # tokens of the texts that one task trains on, with the vectors of their distinct tokens
BATCH, STEPS = 1024, 64  # positions whose gradients are applied together, fewer in a part of less than so many batches
NEGATIVES = 5  # per pair; a batch draws SHARED of them, weighted to that many
SHARED = 64
RATE = 0.1


VOCABULARY_BYTES = 32 << 20  # of terms that every task may hold


def _counted(docs: DataFrame, key: str) -> DataFrame:
    """(key, terms, tfs): the distinct terms of every document as lists; only documents whose key repeats are shuffled."""
    t = dict(docs.dtypes)[key]

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                own = batch.slice(at, DOCS)
                lists = own.column("terms")
                codes = lists.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
                pairs, tf = np.unique(row * max(len(codes.dictionary), 1) + codes.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(pairs, max(len(codes.dictionary), 1))
                ends = pa.array(np.searchsorted(row, np.arange(len(lists) + 1)), pa.int32())
                yield pa.record_batch(
                    {key: own.column(key), "terms": pa.ListArray.from_arrays(ends, codes.dictionary.take(pa.array(code))), "tfs": pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))}
                )

    terms = docs.select(key, tfidf_terms(F.col("__text")).alias("terms"))
    rows = cut(terms.mapInArrow(count, f"`{key}` {t}, terms array<string>, tfs array<long>").where(F.size("terms") > 0))
    again = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col(key).alias("__again")))
    if again.isEmpty():
        return rows
    same = rows[key].eqNullSafe(again["__again"])
    every = rows.join(again, same, "left_semi").select(key, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    summed = every.groupBy(key, "term").agg(F.sum("tf").alias("tf")).groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("s"))
    return cut(rows.join(again, same, "left_anti").unionByName(summed.select(key, F.col("s.term").alias("terms"), F.col("s.tf").alias("tfs"))))


def tfidf(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """Sparse weights ``(key, term, w)``: raw counts, idf ``ln((1+n)/(1+df))+1``, unit length per document.

    The counts are written once as lists, so texts are tokenised once for both term and document frequencies. A vocabulary of at most SMALL_ROWS
    terms (counted) and VOCABULARY_BYTES goes to every task, and the documents stay where they are; the look-up in a larger one spreads frequent
    terms over salted keys.
    """
    docs = df.select(key, F.array_join(tokens, " ").alias("__text"))
    n = docs.count()
    rows = _counted(docs, key)
    idf = cut(rows.select(F.explode("terms").alias("term")).groupBy("term").agg((F.log(float(n + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf")))
    many, size = idf.agg(F.count(F.lit(1)), F.sum(F.octet_length("term"))).first()
    if many > SMALL_ROWS or (size or 0) > VOCABULARY_BYTES:
        tf = rows.select(key, F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
        raw = salted_join(tf, idf, ["term"], spread=[key]).select(key, "term", (F.col("tf") * F.col("idf")).alias("v"))
        # one document's distinct terms, bounded by its text
        return raw.select(key, "term", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))).alias("w"))
    known = idf.toArrow()
    sent = df.sparkSession.sparkContext.broadcast((known["term"].combine_chunks(), known["idf"].to_numpy()))

    def weigh(batches):
        terms, idf = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                own = batch.slice(at, DOCS)
                lengths, flat = own.column("terms").value_lengths().to_numpy(), own.column("terms").flatten()
                v = own.column("tfs").flatten().to_numpy() * idf[pc.index_in(flat, value_set=terms).to_numpy()]
                norm = np.sqrt(np.add.reduceat(v * v, np.cumsum(lengths) - lengths))
                row = np.repeat(np.arange(own.num_rows), lengths)
                yield pa.record_batch({key: own.column(key).take(pa.array(row)), "term": flat, "w": v / norm[row]})

    return rows.mapInArrow(weigh, f"`{key}` {dict(rows.dtypes)[key]}, term string, w double")


def tfidf_vectors(weights: DataFrame, key: str) -> DataFrame:
    """Sparse weights as one sparse ML vector per document, terms numbered in text order."""
    weights = cut(weights)  # numbered and looked up from the files, so that the weights are found once
    terms = weights.select("term").distinct().withColumn("__one", F.lit(1).cast("long"))
    vocab = range_running(terms, [], [F.col("term")], {"id": "__one"}).select("term", "id")
    size = vocab.select(F.count(F.lit(1))).scalar()
    cells = salted_join(weights, vocab, ["term"], spread=[key])
    rows = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("s"))
    return rows.select(
        key, size.cast("int").alias("size"), F.transform("s", lambda s: s["id"].cast("int")).alias("indices"), F.transform("s", lambda s: s["w"]).alias("values")
    )


def _add(at: np.ndarray, gradient: np.ndarray, matrix: np.ndarray, squares: np.ndarray) -> None:
    """One step of AdaGrad, with one sum of squares per token, along the gradients summed by token."""
    order = np.argsort(at, kind="stable")
    tokens, starts = np.unique(at[order], return_index=True)
    total = np.add.reduceat(gradient[order], starts, axis=0)
    squares[tokens] += (total * total).mean(1)
    matrix[tokens] += RATE * total / np.sqrt(squares[tokens] + 1e-12)[:, None]


def _train(ids: np.ndarray, text: np.ndarray, counts: np.ndarray, both: np.ndarray, window: int, rng: np.random.Generator) -> None:
    """One pass of skip-gram with negative sampling over the tokens of one part; ``both`` holds the vectors as words and as contexts and is changed."""
    width = both.shape[1] // 2
    words, contexts = both[:, :width], both[:, width:]
    squares = np.zeros((2, len(both)), np.float32)
    noise = np.cumsum(counts.astype(np.float64) ** 0.75)
    reach = rng.integers(1, window + 1, len(ids))
    offsets = [d for d in range(-window, window + 1) if d]
    batch = max(min(BATCH, len(ids) // STEPS), 2 * window)
    for start in range(0, len(ids), batch):
        here = np.arange(start, min(start + batch, len(ids)))
        first, last = max(start - window, 0), min(start + batch + window, len(ids))
        h = words[ids[here]]
        to_words, to_contexts = np.zeros_like(h), np.zeros((last - first, width), np.float32)
        pairs = np.zeros(len(here), np.float32)
        for d in offsets:
            own = np.flatnonzero((here + d >= 0) & (here + d < len(ids)) & (reach[here] >= abs(d)))
            own = own[text[here[own] + d] == text[here[own]]]
            there = here[own] + d
            u = contexts[ids[there]]
            g = 1.0 / (1.0 + np.exp(np.clip((h[own] * u).sum(1), -30, 30)))[:, None]
            to_words[own] += g * u
            to_contexts[there - first] += g * h[own]
            pairs[own] += 1
        drawn = np.minimum(np.searchsorted(noise, rng.random(SHARED) * noise[-1]), len(noise) - 1)
        u = contexts[drawn]
        g = pairs[:, None] * (NEGATIVES / SHARED) / (1.0 + np.exp(-np.clip(h @ u.T, -30, 30)))
        to_words -= g @ u
        _add(np.concatenate((ids[first:last], drawn)), np.concatenate((to_contexts, -(g.T @ h))), contexts, squares[1])
        _add(ids[here], to_words, words, squares[0])


def word2vec(df: DataFrame, tokens: str = "tokens", size: int = 128, window: int = 5, min_count: int = 3, seed: int = 42, partitions: int | None = None, iterations: int = 1) -> DataFrame:
    """Token vectors ``(token, id, vec)`` with ids by falling count: skip-gram with negative sampling.

    The texts are dealt to parts of about ``PART_TOKENS`` tokens, at least ``partitions`` of them (as many as a shuffle has, unless given). In each of
    ``iterations`` a part meets the vectors of its own tokens, trains them, and the vectors that come back are averaged by token, weighted by its occurrences. Vectors are
    rows of a table throughout: the driver holds none, and a task those of one part.
    """
    spark = df.sparkSession
    counts = cut(df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count))
    known = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(known / PART_TOKENS))
    dealt = df.select(F.monotonically_increasing_id().alias("row"), F.col(tokens).alias("tokens")).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    texts = cut(dealt.repartition("part"))  # written once: a part has the same texts in every iteration
    own = texts.select("part", F.explode("tokens").alias("token")).groupBy("part", "token").agg(F.count(F.lit(1)).alias("n"))
    own = cut(own.join(counts.select("token"), "token"))
    draw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: ((hash_int(stable_hash(seed, i, F.col("token"))) / float(2**32) - 0.5) / size).cast("float"))
    state = counts.select("token", F.concat(draw, F.array_repeat(F.lit(0.0).cast("float"), size)).alias("both"))

    def trained(turn: int):
        def run(key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
            if words.empty or texts.empty:
                return pd.DataFrame({"token": [], "n": [], "both": []})
            words = words.sort_values("token")
            lists = [t for t in texts.sort_values("row")["tokens"] if t is not None]  # the same order on every run
            ids = pd.Index(words["token"]).get_indexer(np.concatenate(lists))
            text = np.repeat(np.arange(len(lists)), [len(t) for t in lists])[ids >= 0]
            both = np.stack(words["both"].to_numpy()).astype(np.float32)
            _train(ids[ids >= 0], text, words["n"].to_numpy(), both, window, np.random.default_rng([seed, turn, int(key[0])]))
            return pd.DataFrame({"token": words["token"], "n": words["n"], "both": list(both)})

        return run

    for turn in range(iterations):
        met = texts.groupBy("part").cogroup(own.join(state, "token").groupBy("part"))
        made = met.applyInPandas(trained(turn), "token string, n long, both array<float>")
        mean = Summarizer.mean(array_to_vector(F.col("both")), F.col("n").cast("double"))
        state = cut(made.groupBy("token").agg(vector_to_array(mean, "float32").alias("both")))
    ids = range_running(counts.withColumn("__one", F.lit(1).cast("long")), [], [F.col("n").desc(), F.col("token")], {"id": "__one"}).select("token", "id")
    return state.join(ids, "token").select("token", "id", F.slice("both", 1, size).cast("array<double>").alias("vec"))


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "vec", out: str = "x") -> DataFrame:
    """Mean vector per key over many rows, combined map-side."""
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(array_to_vector(as_double(F.col(vec))))).alias(out))


def attention_pool(df: DataFrame, keys: list[str], weight: str = "weight", mask: str | None = None, vec: str = "x") -> DataFrame:
    """Softmax-weighted sum of the vectors of an item; masked positions weigh nothing."""
    e = F.exp(F.col(weight))
    if mask:
        e = F.when(F.col(mask), e).otherwise(F.lit(0.0))
    d = df.select(*keys, vec, e.alias("__e"))
    weighted = array_to_vector(F.transform(vec, lambda v: v.cast("double") * F.col("__e")))
    got = d.groupBy(*keys).agg(vector_to_array(Summarizer.sum(weighted)).alias("s"), F.sum("__e").alias("total"))
    return got.select(*keys, F.transform("s", lambda v: v / (F.col("total") + ATTENTION_EPSILON)).alias(vec))
