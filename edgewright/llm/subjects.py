"""Subject areas of documents.

Every document becomes a normalised vector of its prose, and bisecting k-means cuts all
documents of each language into leaves. A leaf is labelled by its discriminative terms and gets
a mixture of subjects from the hand labels that fall into it. A term's weight for a subject
is the mixture of the leaves that hold it, sharpened by the labelled documents it stands in,
each against what is usual in the term's language. A sentence is about the subject that its
terms and the mixture of its document's leaf speak for most, and a document has every
subject that enough of its sentences are about.

Leaves, terms, words that begin sentences and language statistics are those of all documents, and
every label counts. Terms are told apart by a hash into ``buckets`` values, which bounds the
model and drops no term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgewright.llm.prose import sentence_starts, sentences
from edgewright.plans.scratch import stash

#: Stands for "no subject" among the subject identifiers.
NONE = 0


@dataclass(frozen=True)
class SubjectParams:
    """``share``: least share of a document's sentences. The rest shapes the model.

    ``leaves`` per language at most; ``leaf_counts``: how many sentences a term's leaf mixture stands
    for beside labelled ones; ``leaf_prior``: share of the document's own leaf in what is
    expected of a sentence.
    """

    share: float = 0.2
    buckets: int = 2**20
    leaves: int = 64
    vector_size: int = 2**13
    leaf_counts: float = 10.0
    leaf_prior: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class SubjectModel:
    """``trees``: per language the vectors and the tree; the other fields are of bounded size.

    ``weights`` has a row for each of ``known`` (sorted term hashes) and one of zeros, columns for
    subjects (the first is none) and for languages; ``mixtures`` a row for each leaf.
    """

    params: SubjectParams
    subject_ids: list[int]
    languages: list[str]
    starts: frozenset[str]
    spoken: tuple[np.ndarray, np.ndarray]
    trees: list[PipelineModel | None]
    known: np.ndarray
    weights: np.ndarray
    priors: np.ndarray
    mixtures: np.ndarray


def label_shares(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``subject_id``, ``share``: the subjects at least half of a document's annotators found, in equal shares.

    A document without any such subject has ``NONE``. Rows without doc_id are left out.
    """
    told = labels.filter("doc_id is not null").select("doc_id", F.coalesce("subject_id", F.lit(NONE)).alias("subject_id"), F.coalesce("annotator", F.lit("")).alias("annotator")).distinct()
    people = told.groupBy("doc_id").agg(F.countDistinct("annotator").alias("n"))
    votes = told.groupBy("doc_id", "subject_id").agg(F.count("*").alias("votes")).join(people, "doc_id")
    kept = votes.filter((F.col("votes") * 2 >= F.col("n")) & (F.col("subject_id") != NONE)).select("doc_id", "subject_id")
    per = Window.partitionBy("doc_id")
    some = kept.withColumn("share", 1 / F.count("*").over(per))
    without = people.select("doc_id").join(kept, "doc_id", "left_anti").select("doc_id", F.lit(NONE).alias("subject_id"), F.lit(1.0).alias("share"))
    return some.unionByName(without)


def _starts(documents: DataFrame) -> frozenset[str]:
    """Words that, where capitalised, nearly always begin a sentence of the documents."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(w, n * first, n * (not first)) for (w, first), n in sentence_starts(part["text"]).items()], columns=["word", "first", "within"])

    counted = documents.select("text").mapInPandas(run, "word string, first bigint, within bigint").groupBy("word").agg(F.sum("first").alias("first"), F.sum("within").alias("within"))
    # a vocabulary, which grows far slower than the documents
    return frozenset(r["word"] for r in counted.filter("first >= 3 and first > 4 * within").select("word").collect())


def _read(documents: DataFrame, starts: frozenset[str], params: SubjectParams) -> DataFrame:
    """``doc_id``, ``lang`` and the prose of each document: distinct ``words`` of its sentences one after the other, their hashes ``buckets``, and ``ends`` of the sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words, ends = [], []
                for text in batch.column("text").to_pylist():
                    own: list[str] = []
                    stops: list[int] = []
                    for sentence in sentences(text, starts=starts):
                        own.extend(set(sentence))
                        stops.append(len(own))
                    words.append(own)
                    ends.append(stops)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(words, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], names=["doc_id", "lang", "words", "ends"])

    told = documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.coalesce("lang", F.lit(""))).alias("lang"), "text")
    read = told.mapInArrow(run, "doc_id bigint, lang string, words array<string>, ends array<int>").filter("size(ends) > 0")
    return read.withColumn("buckets", F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(params.buckets)).cast("int")))


def _term_languages(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, term hashes, the language each is commonest in, counted by share of the language's terms)."""
    counts = docs.select("lang", F.explode("buckets").alias("bucket")).groupBy("bucket", "lang").agg(F.count("*").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]) - {""}) or [""]
    counts = counts[counts["lang"].isin(languages)]
    known, row = np.unique(counts["bucket"].to_numpy(np.int64), return_inverse=True)
    table = np.zeros((len(known), len(languages)))
    np.add.at(table, (row, counts["lang"].map(languages.index).to_numpy(np.int64)), counts["n"].to_numpy(float))
    return languages, known, (table / np.maximum(table.sum(axis=0), 1)).argmax(axis=1)


def _index(known: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Row of each hash in ``known``; the last row, of zeros, for those it doesn't hold."""
    if not len(known):
        return np.zeros(len(buckets), np.int64)
    at = np.minimum(np.searchsorted(known, buckets), len(known) - 1)
    return np.where(known[at] == buckets, at, len(known))


def _with_language(docs: DataFrame, languages: list[str], known: np.ndarray, spoken: np.ndarray) -> DataFrame:
    """``docs`` plus ``tongue``: number of the language that most of a document's terms are of."""
    held = docs.sparkSession.sparkContext.broadcast((known, np.eye(len(languages), dtype=np.int64)[np.append(spoken, 0)]))

    def tongue(buckets: pd.Series) -> pd.Series:
        own, of = held.value
        sizes = buckets.map(len).to_numpy()
        votes = np.zeros((len(buckets), of.shape[1]), np.int64)
        if sizes.sum():
            row = _index(own, np.concatenate(buckets.to_numpy()))
            there = row < len(own)
            np.add.at(votes, np.repeat(np.arange(len(buckets)), sizes)[there], of[row[there]])
        return pd.Series(votes.argmax(axis=1).astype(np.int32))

    return docs.withColumn("tongue", F.pandas_udf(tongue, "int")("buckets"))


def _tree(docs: DataFrame, params: SubjectParams) -> PipelineModel:
    """Vectors and bisecting k-means of the documents of one language."""
    steps = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=params.vector_size, binary=True),
        IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2),
        Normalizer(inputCol="tfidf", outputCol="features"),
    ]
    vectors = Pipeline(stages=steps).fit(docs)
    held = vectors.transform(docs).select("features").persist()
    tree = BisectingKMeans(k=params.leaves, seed=params.seed, maxIter=4, minDivisibleClusterSize=8, predictionCol="leaf").fit(held)
    held.unpersist()
    return PipelineModel([*vectors.stages, tree])


def _placed(docs: DataFrame, trees: list[PipelineModel | None], params: SubjectParams) -> DataFrame:
    """``docs`` plus ``leaf``: every document goes down the tree of its language."""
    out = None
    for no, tree in enumerate(trees):
        if tree is None:
            continue
        own = tree.transform(docs.filter(F.col("tongue") == no)).withColumn("leaf", F.col("leaf") + no * params.leaves)
        own = own.select("doc_id", "words", "buckets", "ends", "tongue", "leaf")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else docs.select("doc_id", "words", "buckets", "ends", "tongue", F.lit(0).alias("leaf"))


def _fit(documents: DataFrame, labels: DataFrame, params: SubjectParams) -> tuple[SubjectModel, DataFrame]:
    """(the model, all documents in their leaves)."""
    shares = stash(label_shares(labels), "shares")
    starts = _starts(documents.filter("doc_id is not null and text is not null"))
    docs = stash(_read(documents, starts, params), "docs")
    languages, known, spoken = _term_languages(docs)
    docs = stash(_with_language(docs, languages, known, spoken), "told")
    present = {r["tongue"] for r in docs.select("tongue").distinct().collect()}
    # one after the other: the driver gathers the sums and sends the centres of all clusters in each round, and holds those of one tree at a time
    trees = [_tree(docs.filter(F.col("tongue") == no), params) if no in present else None for no in range(len(languages))]
    placed = stash(_placed(docs, trees, params), "placed")
    # labels: a few rows by language and subject, leaf and subject, and by term and subject
    told = stash(placed.select("doc_id", "tongue", "leaf", "buckets", F.size("ends").alias("n")).join(shares, "doc_id"), "fitted")
    by_tongue = told.groupBy("tongue", "subject_id").agg(F.sum(F.col("share") * F.col("n")).alias("n")).toPandas()
    by_leaf = told.groupBy("leaf", "subject_id").agg(F.sum("share").alias("n")).toPandas()
    subjects = sorted({NONE, *map(int, by_tongue["subject_id"])})
    prior = _table(by_tongue, "tongue", "subject_id", list(range(len(languages))), subjects) + 0.5
    prior /= prior.sum(axis=1, keepdims=True)
    of_leaf = np.repeat(np.arange(len(languages)), params.leaves)
    mixture = _table(by_leaf, "leaf", "subject_id", list(range(len(of_leaf))), subjects) + 0.5 * prior[of_leaf]
    mixture /= mixture.sum(axis=1, keepdims=True)
    rows = _term_rows(placed, told, mixture, subjects)
    known, spoken, weights = _weights(rows, known, spoken, prior, params)
    model = SubjectModel(params, subjects, languages, starts, (known, spoken), trees, known, weights, prior.astype(np.float32), mixture.astype(np.float32))
    return model, placed


def _term_rows(placed: DataFrame, told: DataFrame, mixture: np.ndarray, subjects: list[int]) -> pd.DataFrame:
    """For each term hash: ``m_k`` (its leaves' mixture of subject k) and ``h_k`` (sentences of labelled documents of subject k).

    No more rows than there are hash values.
    """
    spark = placed.sparkSession
    mixed = spark.createDataFrame([(leaf, row.tolist()) for leaf, row in enumerate(mixture)], "leaf int, mixture array<double>")
    held = placed.select("leaf", F.explode("buckets").alias("bucket")).groupBy("bucket", "leaf").agg(F.count("*").alias("n"))
    # a fixed number of leaves
    in_leaves = held.join(F.broadcast(mixed), "leaf").groupBy("bucket").agg(
        *[(F.sum(F.col("n") * F.col("mixture")[k]) / F.sum("n")).alias(f"m_{k}") for k in range(len(subjects))]
    )
    seen = told.select("subject_id", "share", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        *[F.sum(F.when(F.col("subject_id") == s, F.col("share")).otherwise(0.0)).alias(f"h_{k}") for k, s in enumerate(subjects)]
    )
    return in_leaves.join(seen, "bucket", "left").fillna(0.0).toPandas()


def _weights(rows: pd.DataFrame, known: np.ndarray, spoken: np.ndarray, prior: np.ndarray, params: SubjectParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted term hashes, their languages, their weights)."""
    rows = rows.sort_values("bucket")
    own = rows["bucket"].to_numpy(np.int64)
    n = prior.shape[1]
    of = np.append(spoken, 0)[_index(known, own)]
    mixed, held = (rows[[f"{x}_{k}" for k in range(n)]].to_numpy(float).reshape(-1, n) for x in "mh")
    start = 0.95 * mixed + 0.05 * prior[of]
    odds = np.log((held + params.leaf_counts * start) / (held.sum(axis=1, keepdims=True) + params.leaf_counts) / prior[of])
    out = np.zeros((len(own) + 1, n + len(prior)), np.float32)
    out[:-1, :n] = odds
    out[np.arange(len(own)), n + of] = 1
    return own, of, out


def _table(rows: pd.DataFrame, by: str, over: str, names: list, across: list) -> np.ndarray:
    out = np.zeros((len(names), len(across)))
    if len(rows):
        at, to = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(across)}
        np.add.at(out, (rows[by].map(at).to_numpy(), rows[over].map(to).to_numpy()), rows["n"].to_numpy(float))
    return out


def fit_subjects(documents: DataFrame, labels: DataFrame, params: SubjectParams | None = None) -> SubjectModel:
    """Leaves of all documents and the weights of their terms; every label counts."""
    return _fit(documents, labels, params or SubjectParams())[0]


def leaf_terms(documents: DataFrame, labels: DataFrame, subjects: DataFrame, params: SubjectParams | None = None, most: int = 8) -> DataFrame:
    """Each leaf with its main subject: ``leaf``, ``lang``, ``n_docs``, ``subject`` (null for none), ``subject_share`` and its ``most`` most discriminative ``terms``.

    A term discriminates by its share among the leaf's terms times the logarithm of that share over the share in the language.
    """
    model, placed = _fit(documents, labels, params or SubjectParams())
    spark = documents.sparkSession
    counted = placed.select("tongue", "leaf", F.explode("words").alias("term")).groupBy("tongue", "leaf", "term").agg(F.count("*").alias("n"))
    counted = stash(counted, "leaf_terms")
    in_leaf = counted.groupBy("leaf").agg(F.sum("n").alias("of_leaf"))
    in_tongue = counted.groupBy("tongue").agg(F.sum("n").alias("of_tongue"))
    usual = counted.groupBy("tongue", "term").agg(F.sum("n").alias("usual"))
    own = counted.join(usual, ["tongue", "term"]).join(F.broadcast(in_leaf), "leaf").join(F.broadcast(in_tongue), "tongue")
    gain = F.col("n") / F.col("of_leaf") * F.log(F.col("n") / F.col("of_leaf") / (F.col("usual") / F.col("of_tongue")))
    best = own.select("leaf", F.struct((-gain).alias("loss"), "term").alias("x"))
    # per leaf only the best few are held while merging
    top = best.groupBy("leaf").agg(F.expr(f"transform(slice(array_sort(collect_list(x)), 1, {most}), y -> y.term)").alias("terms"))
    names = {r["subject_id"]: r["subject"] for r in subjects.filter("subject_id is not null").select("subject_id", "subject").collect()}
    rows = [(k, model.languages[k // model.params.leaves], names.get(model.subject_ids[int(m.argmax())]), float(m.max())) for k, m in enumerate(model.mixtures)]
    told = spark.createDataFrame(rows, "leaf int, lang string, subject string, subject_share double")
    return placed.groupBy("leaf").agg(F.count("*").alias("n_docs")).join(F.broadcast(told), "leaf").join(top, "leaf").select("leaf", "lang", "n_docs", "subject", "subject_share", "terms")


def sentence_shares(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """``doc_id``, ``subject_id``, ``n_about``, ``n_sentences`` for each subject any sentence of a document is about.

    Documents without sentences (null, empty, code or tables only) have no rows; the model,
    of bounded size, goes with the task.
    """
    told = _with_language(_read(documents, model.starts, model.params), model.languages, *model.spoken)
    return _classified(_placed(told, model.trees, model.params), model)


def _classified(placed: DataFrame, model: SubjectModel) -> DataFrame:
    share = model.params.leaf_prior
    held = placed.sparkSession.sparkContext.broadcast((model.known, model.weights, model.priors, model.mixtures, np.array(model.subject_ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, priors, mixtures, ids = held.value
        n = len(ids)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                ends, buckets = batch.column("ends"), batch.column("buckets")
                total = pc.list_value_length(ends).to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), total)
                size = pc.list_value_length(buckets).to_numpy()
                # first term of each sentence in the batch's terms one after the other
                stop = ends.flatten().to_numpy() + np.repeat(np.cumsum(size) - size, total)
                start = np.concatenate([[0], stop[:-1]])
                sums = np.add.reduceat(weights[_index(known, buckets.flatten().to_numpy())], start, axis=0)
                leaf = batch.column("leaf").to_numpy()[owner]
                score = sums[:, :n] + np.log(share * mixtures[leaf] + (1 - share) * priors[sums[:, n:].argmax(axis=1)])
                found = np.zeros((batch.num_rows, n), np.int64)
                np.add.at(found, (owner, score.argmax(axis=1)), 1)
                found[:, ids == NONE] = 0
                doc, subject = np.nonzero(found)
                arrays = [batch.column("doc_id").take(pa.array(doc)), pa.array(ids[subject], pa.int32()), pa.array(found[doc, subject]), pa.array(total[doc], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "subject_id", "n_about", "n_sentences"])

    return placed.select("doc_id", "buckets", "ends", "leaf").mapInArrow(run, "doc_id bigint, subject_id int, n_about bigint, n_sentences bigint")


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, params: SubjectParams | None = None) -> DataFrame:
    """``doc_id``, ``subject``, ``n_about``, ``n_sentences``: none, one or more subjects of each document.

    Repeated rows of one document come out each; documents of no subject have no row.
    """
    params = params or SubjectParams()
    model, placed = _fit(documents, labels, params)
    found = _classified(placed, model)
    enough = found.filter(F.col("n_about") >= F.col("n_sentences") * F.lit(params.share) - 1e-9)
    return enough.join(F.broadcast(subjects.select("subject_id", "subject")), "subject_id").select("doc_id", "subject", "n_about", "n_sentences")


def subject_composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, params: SubjectParams | None = None) -> DataFrame:
    """``subject``, ``n_docs``, ``doc_share`` (of all documents) and ``n_sentences`` of the corpus."""
    found = document_subjects(documents, labels, subjects, params)
    total = max(1, documents.count())
    return found.groupBy("subject").agg(F.count("*").alias("n_docs"), (F.count("*") / total).alias("doc_share"), F.sum("n_about").alias("n_sentences"))
