"""Language identification by segmentation-marginalised unigrams (operator 9).

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability in a language is the sum over all its segmentations into
pieces, which a forward pass computes; a text's is the product over its words.
The piece probabilities are learned by expectation maximisation: a forward-
backward pass gives the expected piece counts of the training words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import dropped, kept, remembering, sample_share, text_or_empty, unused

VOCABULARY = "piece_bpe_32k.model"
#: Documents of each language that are learned from, chosen by a hash of their id.
TRAINING_DOCUMENTS = 1500
ROUNDS = 3
#: Added to each expected count.
SMOOTHING = 0.02
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Letters after which running products are scaled anew, and numbers in a part of equally long words.
RESCALED, CELLS = 8, 1 << 15
#: Words that a worker remembers, and texts whose new words are scored together.
REMEMBERED, TEXTS = 300_000, 500
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str | None = None) -> frozenset[str]:
    """The vocabulary's pieces that lower-case words can hold; a leading ``▁`` starts a word."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return frozenset(p for p in pieces if p == p.lower() and all(c == "▁" or c.isalpha() for c in p) and "▁" not in p[1:])


class Lattice:
    """Finds the pieces within words: hashes of all substrings of one length are looked up at once.

    ``rows[k]`` is the number of the piece with the k-th hash; the last number,
    ``len(pieces)``, stands for no piece.
    """

    def __init__(self, pieces: list[str]):
        import numpy as np

        self.none, self.longest = len(pieces), max(map(len, pieces), default=1)
        by_size: dict[int, list[int]] = {}
        for number, piece in enumerate(pieces):
            by_size.setdefault(len(piece), []).append(number)
        self.keys, self.rows = {}, {}
        for size, numbers in by_size.items():
            hashes = self.hashes(codes([pieces[i] for i in numbers], size), size)[:, 0]
            order = np.argsort(hashes)
            self.keys[size], self.rows[size] = hashes[order], np.array(numbers, "i4")[order]

    @staticmethod
    def hashes(letters, size: int):
        """A 64-bit hash of each substring of this size, words by rows."""
        import numpy as np

        n = letters.shape[1] - size + 1
        out = np.zeros((len(letters), n), "u8")
        for at in range(size):
            out = (out ^ letters[:, at : at + n]) * _HASH
            out ^= out >> np.uint64(29)
        return out

    def edges(self, letters):
        """By size, the piece numbers of the substrings (words by starts); sizes without any piece are left out."""
        import numpy as np

        out, n = {}, letters.shape[1]
        running = np.zeros(letters.shape, "u8")
        for size in range(1, min(n, self.longest) + 1):
            running = (running[:, : n - size + 1] ^ letters[:, size - 1 :]) * _HASH
            running ^= running >> np.uint64(29)
            if size in self.keys:
                keys = self.keys[size]
                at = np.minimum(np.searchsorted(keys, running.reshape(-1)), len(keys) - 1).reshape(running.shape)
                hit = keys[at] == running
                if hit.any():
                    out[size] = np.where(hit, self.rows[size][at], self.none)
        return out


_HASH = 0x9E3779B97F4A7C15


def codes(words: list[str], size: int):
    """Words of one size as a matrix of code points, each scattered over 64 bits."""
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), size).astype("u8") * np.uint64(0xD6E8FEB86659FD93)


def by_size(words: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Words with their numbers, those of one size together, in parts of bounded size."""
    sizes: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        sizes.setdefault(len(w), []).append(i)
    for size, numbers in sizes.items():
        step = max(1, CELLS // (size + 1))
        for at in range(0, len(numbers), step):
            own = numbers[at : at + step]
            yield own, [words[i] for i in own]


def forward(edges: dict, tables, words: int, size: int, longest: int, keep: bool = False):
    """Log probability of each word by table, over all segmentations; with ``keep`` also all running sums and their log scales.

    ``tables``: probabilities, pieces (and a row of 0 for none) by tables. Running
    sums are scaled anew every few letters, so words of any size have one.
    """
    import numpy as np

    n = tables.shape[1]
    sums, scale = np.zeros((size + 1, words, n)), np.zeros((words, n))
    scales = np.zeros((size + 1, words, n)) if keep else None
    sums[0] = 1.0
    for end in range(1, size + 1):
        total, single = sums[end], edges.get(1)
        for own, numbers in edges.items():
            if own <= end:
                total += sums[end - own] * tables[numbers[:, end - own]]
        # a letter that is no piece is unknown
        lone = np.ones(words, bool) if single is None else single[:, end - 1] == len(tables) - 1
        if lone.any():
            total[lone] += sums[end - 1][lone] * UNKNOWN
        if keep:
            scales[end] = scale
        if end % RESCALED == 0:
            by = total.copy()
            for back in range(max(0, end - longest), end + 1):
                sums[back] /= by
                if keep:
                    scales[back] += np.log(by)
            scale = scale + np.log(by)
    logs = np.log(sums[size]) + scale
    return (logs, sums, scales) if keep else logs


def word_logs(words: list[str], lattice: Lattice, tables):
    """Log probability of each word (by rows) in each language."""
    import numpy as np

    out = np.empty((len(words), tables.shape[1]))
    for numbers, own in by_size(["▁" + w for w in words]):
        size = len(own[0])
        out[numbers] = forward(lattice.edges(codes(own, size)), tables, len(own), size, lattice.longest)
    return out


def expected_counts(words: list[str], weights, lattice: Lattice, table):
    """Forward-backward: how often each piece occurs in the words, over all segmentations, each word ``weights`` times."""
    import numpy as np

    counts = np.zeros(lattice.none + 1)
    column, weights = table[:, None], np.asarray(weights, "f8")
    for numbers, own in by_size(["▁" + w for w in words]):
        size, n = len(own[0]), len(own)
        edges = lattice.edges(codes(own, size))
        logs, sums, scales = forward(edges, column, n, size, lattice.longest, keep=True)
        # backwards is forwards over the words turned round
        turned = {k: found[:, ::-1] for k, found in edges.items()}
        _, back, back_scales = forward(turned, column, n, size, lattice.longest, keep=True)
        for k, found in edges.items():
            for start in range(size - k + 1):
                piece = found[:, start]
                share = sums[start][:, 0] * table[piece] * back[size - start - k][:, 0] * np.exp(scales[start][:, 0] + back_scales[size - start - k][:, 0] - logs[:, 0])
                np.add.at(counts, piece, share * weights[numbers])
    return counts[:-1]


@dataclass
class Model:
    """``table``: each piece's probability by language (pieces by rows), in the order of ``languages``."""

    languages: list[str]
    pieces: list[str]
    table: list[list[float]]
    held_out: int = 2

    def scorer(self):
        """A function: words to log probabilities, words by languages."""
        import numpy as np

        lattice, tables = Lattice(self.pieces), np.vstack([np.array(self.table).reshape(len(self.pieces), len(self.languages)), np.zeros((1, len(self.languages)))])
        return lambda words: word_logs(words, lattice, tables)


def letters(text: str) -> list[str]:
    """The words of a text: runs of letters, in lower case."""
    words = _WORDS.findall(text.lower())
    if words and not "".join(words).isalpha():  # digits that aren't decimal, such as ² or Ⅷ
        words = [w for run in words for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return words


def remainder(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", held_out: int = 2, documents: int = TRAINING_DOCUMENTS, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """Learn from the texts and languages of documents that aren't held out.

    A sample bounded by ``documents`` for each language; which documents it
    holds depends on their ids only. Rows with a null text or language teach
    nothing; without any other row the model has no language. What reaches the
    driver is a row for each language, or for each language and piece.
    """
    rows = docs.select(F.col(key).alias("__key"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("__text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("__text").isNotNull() & (remainder(F.col("__key")) != held_out))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    pieces = sorted(vocabulary(path))
    if not languages:
        return Model([], [], [], held_out)
    chosen = F.lit(False)
    for name in languages:
        chosen |= (F.col("lang") == name) & sample_share(F.col("__key"), documents / sizes[name])
    words = F.explode(F.regexp_extract_all(F.lower("__text"), F.lit(r"(\p{L}+)"))).alias("word")
    counted = kept(rows.where(chosen).select("lang", words).groupBy("lang", "word").count())
    probabilities = {name: [1 / len(pieces)] * len(pieces) for name in languages}
    for _ in range(rounds):
        now = probabilities

        def expect(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            lattice, sums = Lattice(pieces), {}
            for part in parts:
                for name, own in part.groupby("lang"):
                    table = np.append(np.array(now[name]), 0.0)
                    sums[name] = sums.get(name, 0.0) + expected_counts(own["word"].tolist(), own["count"], lattice, table)
            for name, n in sums.items():
                some = np.flatnonzero(n)
                yield pd.DataFrame({"lang": name, "piece": some, "n": n[some]})

        sums = counted.mapInPandas(expect, "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        found = {name: [SMOOTHING] * len(pieces) for name in languages}
        for r in sums:
            found[r["lang"]][r["piece"]] += r["n"]
        probabilities = {name: [n / total for n in own] for name, own in found.items() for total in [sum(own)]}
    dropped(counted)
    return Model(languages, pieces, [list(own) for own in zip(*(probabilities[name] for name in languages))], held_out)


def predictor(model: Model):
    """A column function: text to struct<lang_pred, score>. Null and letterless texts are ``und`` with score 0."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        remembering("languages")
        n, score = len(model.languages), model.scorer()
        known: dict[str, int] = {}
        logs = np.empty((1 << 16, max(1, n)))
        for batch in batches:
            names, scores = [], []
            for texts in (batch.iloc[i : i + TEXTS] for i in range(0, len(batch), TEXTS)):
                split = [letters(text) if text and n else [] for text in texts]
                new = set().union(*split).difference(known)
                if len(known) + len(new) > REMEMBERED and known:
                    known.clear()
                    new = set().union(*split)
                if new:
                    while len(known) + len(new) > len(logs):
                        logs = np.concatenate([logs, np.empty_like(logs)])
                    fresh = list(new)
                    logs[len(known) : len(known) + len(fresh)] = score(fresh)
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                for words in split:
                    if not words:
                        names.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    total = logs[list(map(known.__getitem__, words))].sum(axis=0)
                    likely = np.exp(total - total.max())
                    best = int(likely.argmax())
                    names.append(model.languages[best])
                    scores.append(float(likely[best] / likely.sum()))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict.asNondeterministic()


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of these names.

    ``und`` with score 0 where the text is null or has no letter, or where the
    model has learned no language; ties go to the first language by name. Rows
    are independent; an empty table gives an empty result. A worker remembers
    ``REMEMBERED`` words at most (more only within one text).
    """
    rows = docs.drop("lang_pred", "score")
    found = unused(rows.columns, "__language")
    own = [F.col(f"`{c}`") for c in rows.columns]
    return rows.withColumn(found, predictor(model)(F.col(text).cast("string"))).select(*own, f"{found}.lang_pred", f"{found}.score")


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score. A null doc_id has a null ``held_out`` and teaches nothing."""
    return identify(docs.select("doc_id", (remainder(F.col("doc_id")) == model.held_out).alias("held_out"), text_or_empty().alias("text")), model).drop("text")


def accepted(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """Documents with a language that the model knows, predicted with a score of ``least`` or more; columns as they are."""
    found = unused(docs.columns, "__language")
    rows = docs.withColumn(found, predictor(model)(F.col("text").cast("string")))
    return rows.where((F.col(f"{found}.lang_pred") != UNDETERMINED) & (F.col(f"{found}.score") >= least)).drop(found)
