"""BPE encoding and decoding by prefix-sharing trie traversal (operator 8).

Distinct words of a batch form a trie. Visiting it depth first, every node (a
prefix) gets one state: the last token of that prefix's encoding. A token that
ends a prefix is that last token if it is compatible with the state of the
prefix before it, so the encoding of a prefix is computed once, however many
words share it, and a word's tokens are read backwards from its leaf.

The trie is walked without being built: in sorted order, the path of a word
differs from its predecessor's only after their common prefix, so a stack of
states holds the current root-to-node path.

The vocabulary file is a ``tokenizers`` JSON with a BPE model with an
end-of-word suffix, byte-level symbols, and a normaliser that composes (NFC)
and lower-cases. Unknown layouts are refused rather than guessed at.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections import ChainMap
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import remembering, text_or_empty

VOCABULARY = "word_bpe_49k.json"
#: Words that a Python worker remembers between batches; then it forgets those that weren't met in the last half of them.
REMEMBERED = 1_000_000
#: Longer words aren't remembered, so that the memory has a bound.
LONGEST_REMEMBERED = 64
#: Bytes of text handled at once.
SLICE_BYTES = 4 << 20

_WHITE = "\t-\r \x85\xa0  -     　"
#: The file's own split pattern. No alternative crosses white space, so what
#: stands between white space can be encoded on its own.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + _WHITE + r"\p{L}\p{N}]+"
#: The same for lower-case Latin-1 text.
_LATIN = re.compile("[a-zª\xb5ºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼½¾]|[^\t-\r \x85\xa00-9²³¹¼½¾a-zª\xb5ºß-öø-ÿ]+").findall


def _byte_symbols() -> list[str]:
    """The symbol of each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class TrieEncoder:
    """Encodes texts with one vocabulary; one object serves a Python worker."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: a BPE vocabulary with an end-of-word suffix and no decoder is needed")
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = self.ids | self.special
        self.names = [""] * (max(named.values()) + 1)
        for s, i in named.items():
            self.names[i] = s
        self.inner = {s: i for s, i in self.ids.items() if not s.endswith(self.end)}
        self.final = {s[: -len(self.end)]: i for s, i in self.ids.items() if s.endswith(self.end) and s != self.end}
        self.inner_sizes, self.final_sizes = self._sizes(self.inner), self._sizes(self.final)
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[left, right] = rank
            self.made[whole] = (rank, left, right)
        symbols = _byte_symbols()
        self.sizes = {i: len(s) - (len(self.end) if s.endswith(self.end) and s != self.end else 0) for s, i in self.ids.items()}
        self.symbols = {b: s for b, s in enumerate(symbols)}
        self.fits: dict[int, bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.split = regex.compile(_SPLIT).findall
        self.white = regex.compile(f"[{_WHITE}]+").split
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @staticmethod
    def _sizes(vocabulary: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """By its last three symbols, the lengths that a token may have, longest first."""
        sizes: dict[str, set[int]] = {}
        for token in vocabulary:
            if len(token) > 2:
                sizes.setdefault(token[-3:], {1, 2}).add(len(token))
        return {end: tuple(sorted(own, reverse=True)) for end, own in sizes.items()}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of ``token`` while it is merged, each with the rank at which it ceases to exist."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            until, *parts = self.made[token]
            token = parts[side]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens gives just these two: no merge across the border comes first."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            rank, ends = self.rank.get, self._edge(right, 0)
            known = self.fits[key] = not any((r := rank((a, b))) is not None and r < until_a and r <= until_b for a, until_a in self._edge(left, 1) for b, until_b in ends)
        return known

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """Depth-first over the trie of ``words`` (byte symbols): each word with its tokens, as ``encode`` gives them."""
        states, path, sizes = [-1], "", self.sizes
        inner, final, fits, compatible = self.inner.get, self.final.get, self.fits.get, self.compatible
        inner_sizes, final_sizes = self.inner_sizes.get, self.final_sizes.get
        for word in sorted(words):
            n = len(word)
            shared, most = 0, min(len(path), n - 1)
            if path[:most] == word[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del states[shared + 1 :]
            add, get, size_of = states.append, inner, inner_sizes
            for end in range(shared + 1, n + 1):
                if end == n:
                    get, size_of = final, final_sizes
                for size in size_of(word[end - 3 : end], (2, 1)) if end > 2 else range(end, 0, -1):
                    if size < end:
                        token = get(word[end - size : end])
                        if token is not None:
                            fit = fits(states[end - size] << 32 | token)
                            if fit or (fit is None and compatible(states[end - size], token)):
                                break  # just one token is compatible: the encoding of a prefix is unique
                    elif size == end and (token := get(word[:end])) is not None:
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
                add(token)
            out, at = [], n
            while at:
                token = states[at]
                out.append(token)
                at -= sizes[token]
            del states[n:]
            path = word[: n - 1]
            out.reverse()
            yield word, array("I", out).tobytes()

    def _learn(self, words: set[str], into: dict[str, bytes]) -> None:
        symbols = self.symbols
        spelled = {w: w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(symbols) for w in words}
        tokens = dict(self.walk(spelled.values()))
        for word, own in spelled.items():
            into[word] = tokens[own]

    def _words(self, text: str) -> list[str]:
        """The words of a text, as the file's normaliser and its split pattern give them."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each character by itself: no final sigma
        text = text.lower()
        if text.isascii():
            return _LATIN(text)
        try:
            text.encode("latin-1")
            return _LATIN(text)
        except UnicodeEncodeError:
            # only what stands between white space with other letters needs the pattern itself
            out: list[str] = []
            for chunk in self.white(text):
                try:
                    chunk.encode("latin-1")
                    out += _LATIN(chunk)
                except UnicodeEncodeError:
                    out += self.split(chunk)
            return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        special, plain = self.specials, []
        for text in texts:
            if special and "<|" in text and special.search(text):
                parts, at = [], 0
                for m in special.finditer(text):
                    parts += [*self._words(text[at : m.start()]), m]
                    at = m.end()
                plain.append(parts + self._words(text[at:]))
            else:
                plain.append(self._words(text))
        if len(self.ids_of) > REMEMBERED // 2:
            self.ids_of, self.older = {}, self.ids_of
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        ids_of, older = self.ids_of, self.older
        new = set().union(*plain).difference(ids_of)
        again = {w for w in new if w in older}
        ids_of.update((w, older[w]) for w in again)
        new -= again
        once = {w for w in new if not isinstance(w, str) or len(w) > LONGEST_REMEMBERED}
        self._learn(new - once, ids_of)
        if once:
            ids_of = ChainMap({m: struct.pack("<I", self.special[m[0]]) for m in once if not isinstance(m, str)}, ids_of)
            self._learn({w for w in once if isinstance(w, str)}, ids_of)
        return [b"".join(map(ids_of.__getitem__, words)) for words in plain]

    def decode(self, ids: bytes) -> str:
        """The tokens of little-endian 32-bit ids, as a vocabulary without a decoder joins them."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str | None = None) -> TrieEncoder:
    """This worker's encoder of a vocabulary file; None: the public one, found where the task runs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    remembering("words", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def encode(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """Encode and decode every text.

    Returns ``keys``, ``ids`` (array<int>) and ``decoded``. Null and empty
    texts have no ids and decode to the empty text; strings of special tokens
    in a text become those tokens. Rows are independent: repeated rows give
    repeated results, an empty table an empty one; other columns of ``docs``
    are ignored, so they can't clash. No shuffle; memory is bounded by a slice
    of ``SLICE_BYTES`` (or one text), the trie of its words, and the words
    remembered.
    """
    rows = docs.select(*[F.col(k) for k in keys], text_or_empty(text).alias("__text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = encoder(path)
        for part in slices(batches, "__text"):
            got = own.encode(part.column("__text").to_pylist())
            flat = np.frombuffer(b"".join(got), dtype="<u4").astype("i4")
            ends = np.cumsum([0, *(len(ids) // 4 for ids in got)], dtype="i4")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), ids, pa.array(map(own.decode, got), pa.string())], names=[*keys, "ids", "decoded"])

    return rows.mapInArrow(run, f"{types}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row of ``docs``.

    Hashed where the text is encoded, so that no ids travel back from Python.
    """
    rows = docs.select("doc_id", text_or_empty().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        own = encoder(path)
        for part in slices(batches, "__text"):
            got = own.encode(part.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(ids) // 4 for ids in got], pa.int64()), pa.array([sha256(ids).hexdigest() for ids in got], pa.string()), pa.array([sha256(own.decode(ids).encode()).hexdigest() for ids in got], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
