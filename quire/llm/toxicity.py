"""Toxicity by classifier chains (operator 5).

Categories are predicted one after the other. Each link of the chain is a
logistic model over lexical features and the probabilities of the categories
before it; for training, those probabilities are out-of-fold predictions, so
that a later link sees earlier ones as unsure as they will be on new text.

Features are presences of words and of word beginnings, chosen by how much more
often they occur in labelled toxic documents (or in others) than chance allows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import dropped, kept, remembering, sample_share, text_or_empty, unused

#: Bounds of the training sample, by class, and of the features.
POSITIVES, NEGATIVES, FEATURES = 3000, 5000, 2048
FOLDS = 3
#: A feature's least number of documents, and least log-likelihood ratio of its shares of toxic and other ones; by chance one in 150,000 has it.
LEAST_DOCUMENTS, LEAST_RATIO = 4, 20.0
#: Lengths of word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)
REMEMBERED = 150_000
_WORDS = re.compile(r"[^\W\d_]+")

#: Categories that a toxic document also belongs to if it has one of these
#: words; ``coded`` are toxic documents with none of them, ``toxic`` are all.
#: The order is the chain's.
CATEGORY_TERMS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile"),
    "contempt": ("scum", "trash", "worthless", "pathetic", "disgusting", "garbage", "filth", "vermin"),
    "threat": ("kill", "die", "hurt", "destroy", "burn", "shoot"),
}
CATEGORIES = (*CATEGORY_TERMS, "coded", "toxic")


def word_features(word: str) -> tuple[str, ...]:
    return (word, *(f"^{word[:n]}" for n in BEGINNINGS if len(word) > n))


def document_features(words: set[str]) -> set[str]:
    """Features of a document's words; a beginning that two different words share is a feature of its own, marked ``+``."""
    counts = Counter(f for w in words for f in word_features(w))
    return {*counts, *(f"{f}+" for f, n in counts.items() if n > 1)}


@dataclass
class Model:
    features: dict[str, int]
    #: One row per category: a weight for each feature, then for each category before it, then the bias.
    weights: list[list[float]]
    categories: tuple[str, ...]
    threshold: float

    def probabilities(self, found):
        """By category, for a list of feature-number arrays."""
        import numpy as np

        n = len(self.features)
        w = np.array([row[:n] for row in self.weights]).reshape(len(self.weights), n)
        scores = np.array([w[:, f].sum(axis=1) for f in found]).reshape(len(found), len(self.weights))
        out = np.zeros_like(scores)
        for k, row in enumerate(self.weights):
            out[:, k] = sigmoid(scores[:, k] + out[:, :k] @ np.array(row[n : n + k]) + row[-1])
        return out


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_link(x, y, steps: int = 150, penalty: float = 1e-3):
    """Weights and bias of a logistic model, by accelerated gradient descent; both classes weigh the same."""
    import numpy as np

    if y.min() == y.max():
        return np.zeros(x.shape[1]), -6.0 if y.max() == 0 else 6.0
    each = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()).astype("f4")
    rate = 4.0 / max(1.0, float((each * (x * x).sum(axis=1)).sum()))
    w, b = np.zeros(x.shape[1], "f4"), 0.0
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        off = each * (sigmoid(x @ v + c) - y)
        w1, b1 = v - rate * (off @ x + penalty * v), c - rate * off.sum()
        t1 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return w, float(b)


def fit_chain(found: list[list[int]], labels, n_features: int, folds: int = FOLDS, hidden: list[list[int]] | None = None):
    """The chain's weights, and its out-of-fold probabilities of the last category.

    ``hidden``: by category, features that its link doesn't see. A category that
    is named by words is learned from what stands beside them, so that its
    probabilities tell later links something that its words don't.
    """
    import numpy as np

    x = np.zeros((len(found), n_features), "f4")
    for i, own in enumerate(found):
        x[i, own] = 1
    fold, earlier, weights = np.arange(len(x)) % folds, np.zeros((len(x), 0), "f4"), []
    for k in range(labels.shape[1]):
        y, own = labels[:, k], np.concatenate([x, earlier], axis=1)
        if hidden and k < len(hidden):
            own[:, hidden[k]] = 0
        out = np.zeros(len(x), "f4")
        for f in range(folds):
            w, b = fit_link(own[fold != f], y[fold != f])
            out[fold == f] = sigmoid(own[fold == f] @ w + b)
        w, b = fit_link(own, y)
        weights.append([*w.tolist(), b])
        earlier = np.concatenate([earlier, out[:, None]], axis=1)
    return weights, earlier[:, -1]


def best_threshold(scores, truth, weights=None) -> float:
    """The threshold with the best F1 on out-of-fold scores; in the middle of the gap that it falls in.

    ``weights`` say how many documents each row stands for, one if not given.
    """
    import numpy as np

    order = np.argsort(-scores, kind="stable")
    each = np.ones(len(scores)) if weights is None else np.asarray(weights, "f8")
    s, hits = scores[order], np.cumsum((each * truth)[order])
    f1 = 2 * hits / (np.cumsum(each[order]) + (each * truth).sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # a tie can't be divided
    at = int(f1.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < len(s) else 0)) / 2)


def label_rows(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """A bounded sample of labelled documents: ``key, toxic, weight, text``, where a row stands for ``weight`` labelled documents of its class. A document labelled twice is toxic if one label says so; of a repeated doc_id's texts the least counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen, weight = F.lit(False), F.lit(1.0)
    for value, bound in ((1, positives), (0, negatives)):
        share = 0.95 * bound / max(1, sizes.get(value, 1))
        chosen |= (F.col("toxic") == value) & sample_share(F.col("doc_id"), share)
        weight = F.when(F.col("toxic") == value, 1 / min(1.0, share)).otherwise(weight) if share > 0 else weight
    sample = known.where(chosen).withColumn("weight", weight).limit(positives + negatives)  # the bound that allows the broadcast
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    # one text for each id, so that repeated rows don't go over the bounds
    return found.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("weight").alias("weight"), F.min("text").alias("text")).select(F.col("doc_id").alias("key"), "toxic", "weight", "text")


def train(docs: DataFrame, labels: DataFrame, terms: dict[str, tuple[str, ...]] | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """Learn from ``labels(doc_id, toxic)`` on ``docs(doc_id, text)``.

    The sample is bounded by ``positives`` and ``negatives``; what reaches the
    driver are ``FEATURES`` features at most and their numbers in the sample's
    documents. Without labelled documents of both classes nothing is toxic.
    """
    import numpy as np

    terms = CATEGORY_TERMS if terms is None else terms
    categories = (*terms, "coded", "toxic")
    sample = kept(label_rows(docs, labels, positives, negatives))
    counted = sample.groupBy("toxic").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).collect()
    sizes, stands = {r["toxic"]: r["n"] for r in counted}, {r["toxic"]: r["weight"] for r in counted}
    if not (sizes.get(0) and sizes.get(1)):
        return Model({}, [[-6.0]] + [[0.0] * k + [-6.0] for k in range(1, len(categories))], categories, 0.5)

    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            counts = {0: Counter(), 1: Counter()}
            for toxic, text in zip(part["toxic"], part["text"]):
                counts[int(toxic > 0)].update(document_features(set(_WORDS.findall(text.lower()))))
            both = counts[0] + counts[1]
            yield pd.DataFrame({"feature": list(both), "clean": [counts[0][f] for f in both], "toxic": [counts[1][f] for f in both]})

    # classes as frequent as among all labels, in a sample of this size
    everything = sum(sizes[k] * stands[k] for k in (0, 1))
    scale, share = (sizes[0] + sizes[1]) / everything, sizes[1] * stands[1] / everything
    documents = F.col("toxic") + F.col("clean")
    toxic, clean = F.col("toxic") * (stands[1] * scale), F.col("clean") * (stands[0] * scale)
    both = toxic + clean
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    ratio = 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))
    strong = sample.mapInPandas(frequencies, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = strong.where((documents >= LEAST_DOCUMENTS) & (ratio >= LEAST_RATIO)).orderBy(ratio.desc(), "feature").limit(FEATURES)
    features = {r["feature"]: i for i, r in enumerate(sorted(strong.collect(), key=lambda r: r["feature"]))}
    groups = list(terms.values())

    def describe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, toxic, text in zip(part["key"], part["toxic"], part["text"]):
                words = set(_WORDS.findall(text.lower()))
                own = [int(toxic > 0 and not words.isdisjoint(g)) for g in groups]
                rows.append((key, sorted(features[f] for f in document_features(words) if f in features), [*own, int(toxic > 0 and not any(own)), int(toxic > 0)]))
            yield pd.DataFrame(rows, columns=["key", "found", "labels"])

    rows = sample.mapInPandas(describe, "key long, found array<int>, labels array<int>").collect()
    dropped(sample)
    rows.sort(key=lambda r: (r["key"], r["found"]))
    truth = np.array([r["labels"] for r in rows], "f4")
    hidden = [sorted({features[f] for w in own for f in (*word_features(w), *(f"{f}+" for f in word_features(w))) if f in features}) for own in groups]
    weights, scores = fit_chain([r["found"] for r in rows], truth, len(features), hidden=hidden)
    return Model(features, weights, categories, best_threshold(scores, truth[:, -1], [stands[int(y)] for y in truth[:, -1]]))


def predictor(model: Model):
    """A column function: text to struct<probabilities, toxic>."""

    @F.pandas_udf("probabilities array<double>, toxic boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        remembering("toxicity")
        known: dict[str, tuple[str, ...]] = {}
        features = model.features
        used = {f.removesuffix("+") for f in features}
        for batch in batches:
            found = []
            for text in batch:
                words = set(_WORDS.findall(text.lower())) if text else ()
                hits: list[str] = []
                for w in words:
                    own = known.get(w)
                    if own is None:
                        own = tuple(f for f in word_features(w) if f in used)
                        if len(known) > REMEMBERED:
                            known.clear()
                        known[w] = own
                    hits += own
                counts = Counter(hits)
                numbers = [features[f] for f in (*counts, *(f"{f}+" for f, n in counts.items() if n > 1)) if f in features]
                found.append(np.array(sorted(numbers), "i8"))
            scores = model.probabilities(found) if len(found) else np.zeros((0, len(model.categories)))
            yield pd.DataFrame({"probabilities": list(scores), "toxic": scores[:, -1] >= model.threshold})

    return predict.asNondeterministic()


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``p_<category>`` for each category and ``is_toxic``; these replace columns of the same names.

    Null and empty texts have no feature, so each category's bias decides.
    Rows are independent; repeated rows get equal results, an empty table gives
    an empty one. Whole texts are read; a worker remembers ``REMEMBERED`` words.
    """
    new = [f"p_{c}" for c in model.categories]
    rows = docs.drop(*new, "is_toxic")
    found = unused(rows.columns, "__toxicity")
    own = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.withColumn(found, predictor(model)(F.col(text).cast("string")))
    return rows.select(*own, *[F.col(f"{found}.probabilities")[i].alias(c) for i, c in enumerate(new)], F.col(f"{found}.toxic").alias("is_toxic"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """Documents that aren't toxic; columns as they are."""
    found = unused(docs.columns, "__toxicity")
    rows = docs.withColumn(found, predictor(model)(F.col("text").cast("string")))
    return rows.where(~F.col(f"{found}.toxic")).drop(found)
