"""Personal data by bootstrapped contextual extraction (operator 4).

Regular expressions find the base entities. These are seeds: the words around
them induce lexical patterns, and every other token with such a context is an
instance of a pattern, whatever its form. How plausible its form is for the
pattern's kind is a score of its own, which weighs what the patterns say.
Patterns and instances form a graph on which Spark scores both sides in turn: a
pattern by how many of its instances are believed to be of its kind, an
instance by the patterns that found it. Instances of high-confidence patterns
are added.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe_trie import slices
from quire.llm.tables import dropped, kept, text_or_empty

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs this score and this many different instances that are believed; an instance is from this belief on.
LEAST_SCORE, LEAST_SEEDS, LEAST_BELIEF = 0.8, 3, 0.8
#: What unlabelled instances count against a pattern at first.
PRIOR = 0.0

# The base entities, as their definition gives them.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Runs of digits with the separators of numbers between them, as far as they go, and what mustn't follow a number.
_NUMBERS = re.compile(r"[+(]?[0-9][0-9().\x20-]*+")
_GOES_ON = re.compile(r"\w|[:@/_-]\w")
_SEPARATORS = "().\x20-"
#: Account numbers in groups of four.
_GROUPS = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[0-9]{1,3})?(?!\w)")
#: Runs without white space; of these only those that hold two digits or an at sign could be identifiers.
_RUN = re.compile(r"[^\s\"'<>|,;]+")
#: Digits of the longest number that is an identifier; longer runs are several numbers.
LONGEST = 19
_ADDRESS6 = re.compile(r"(?=.*::|(?:[^:]*:){4})[0-9a-f:.]+(?:%\w+|/[0-9]+)?")
_ACCOUNT = re.compile(r"[a-z]{2}[0-9]{2}[a-z0-9]{11,30}")
_DATE = re.compile(r"(?:[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-./])[0-9]{1,2}\2[0-9]{4})")
_WORD = re.compile(r"[^\W\d_]+")
_EDGES = "\"'.,;:!?()[]{}<>*#$%&|=`"
_DIGITS = re.compile("[0-9]")
#: Characters that may stand between a span and a word of its context.
CONTEXT = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email expression, found from their at signs.

    The local part is the whole run before the at sign that isn't part of the
    match before it; this is where a search from the left would have begun.
    """
    local, at, done = _LOCAL, text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in local:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base(text: str) -> list[tuple[int, int, int]]:
    """The base entities of a text, as (kind number, start, end), by kind and start."""
    found = []
    if "@" in text:
        found += [(0, *span) for span in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                found.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((3, *m.span()))
    return found


def plausible(token: str) -> list[tuple[int, float]]:
    """The kinds that a token's form allows (as numbers), with how well it suits each; unseen identifiers differ in detail from the seeds.

    Below ``LEAST_BELIEF`` the form rules a token out, but it still counts against a context.
    """
    token = token.lower()
    if "@" in token:
        return [(0, 1.0)]
    digits = sum(map(str.isdigit, token))
    letters = any(map(str.isalpha, token))
    if _ADDRESS6.fullmatch(token):
        return [(1, 1.0)]
    if _DATE.fullmatch(token):
        return [(2, 0.3), (3, 0.3)]
    if token.startswith("+"):
        return [(3, 1.0 if digits > 4 and not letters else 0.9 if digits > 4 else 0.5)]
    if token.count(".") > 1 and not letters and " " not in token and "-" not in token:
        return [(1, 1.0 if token.count(".") == 3 else 0.5), *([(3, 0.9)] if 6 < digits < 13 and token.count(".") != 3 else [])]
    if letters:
        whole = "".join(filter(str.isalnum, token))
        card = 1.0 if _ACCOUNT.fullmatch(whole) else 0.9 if digits > 4 and 8 <= len(whole) <= 34 else 0.5
        return [(2, card), (3, 0.9 if 3 < digits < 16 and token[0] in "(0123456789" and 7 <= len(whole) <= 20 and not token.isalnum() else 0.5)]
    out = [(2, 1.0 if 11 < digits < 20 else 0.9 if 6 < digits < 20 else 0.5)]
    return [*out, (3, 1.0 if digits > 6 else 0.5)] if digits < 13 else [*out, (3, 0.9)] if digits < 16 else out


def contexts(text: str, start: int, end: int, words: list[tuple[int, int]]) -> list[str]:
    """Lexical contexts of a span: two words before, one before and one after, the word before with the mark between.

    ``words``: the spans of all the text's words; a context has whole words, each within ``CONTEXT`` characters of the next.
    """
    at = bisect_right(words, (start, start))
    while at and words[at - 1][1] > start:
        at -= 1
    after = bisect_left(words, (end, end))
    right = text[slice(*words[after])].lower() if after < len(words) and words[after][0] - end <= CONTEXT else ""
    if not at or start - words[at - 1][1] > CONTEXT:
        return [f">{right}"] if right else []
    last = text[slice(*words[at - 1])].lower()
    gap = text[words[at - 1][1] : start].strip()[:4].lower()
    out = [f"{last}{gap}<"]
    if at > 1 and words[at - 1][0] - words[at - 2][1] <= CONTEXT:
        out.append(f"{text[slice(*words[at - 2])].lower()} {last}<")
    if right:
        out.append(f"{last}<>{right}")
    return out


def numbers(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """The numbers that begin at ``at``, and where they end: one, or those between the spaces of a run with too many digits for one."""
    m = _NUMBERS.match(text, at)
    if not m:
        return [], at
    end = at + len(m[0].rstrip(_SEPARATORS))
    whole = text[at:end]
    if sum(map(str.isdigit, whole)) > LONGEST and " " in whole:
        spans = [(at + p.start(), at + p.end()) for p in re.finditer("[^ ]+", whole)]
    else:
        spans = [(at, end)]
    if _GOES_ON.match(text, end):
        end = spans[-1][0]
        spans = spans[:-1]
    return spans, end


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """The spans of tokens that could be identifiers, in linear time.

    A number that begins within a run, after a mark as in ``tel:030 1234567`` or
    as the run's only digit, and goes on beyond it is a token of its own.
    """
    at = 0
    while m := _RUN.search(text, at):
        start, at = m.span()
        found, end = numbers(text, start)
        if found:
            yield from found
            at = end
            continue
        groups = _GROUPS.match(text, start)
        if groups and sum(map(str.isdigit, groups[0])) > 7:
            at = groups.end()
            yield groups.span()
            continue
        digits = _DIGITS.findall(m[0])
        if digits:
            own = text.index(digits[0], start)
            own -= own > start and text[own - 1] in "+("
            if own > start and (len(digits) < 2 or text[own - 1] in ":=#"):
                found, end = numbers(text, own)
                if found and end > at:
                    at = end
                    yield from found
                    continue
        if len(digits) > 1 or "@" in m[0]:
            yield start, at


def candidates(text: str, own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tokens that could be identifiers: base entities with their kind, others that don't touch one with kind -1."""
    if not _DIGITS.search(text) and "@" not in text:
        return []
    out, reach = list(own), []  # base entities by start, each with the furthest end up to it
    for s, e in sorted((s, e) for _, s, e in own):
        reach.append((s, max(e, reach[-1][1] if reach else 0)))
    for start, end in tokens(text):
        whole = ")" in text[start:end]  # only then is an opening bracket the number's own
        while start < end and text[start] in _EDGES and not (text[start] == "(" and whole and text[start + 1 : start + 2].isdigit()):
            start += 1
        while start < end and text[end - 1] in _EDGES:
            end -= 1
        if end - start >= 4:
            before = bisect_left(reach, (end,))
            if not before or reach[before - 1][1] <= start:
                out.append((-1, start, end))
    return out


def edges_of(text: str, own: list[tuple[int, int, int]]) -> Iterator[dict]:
    """A text's edges between contexts and candidates, one for each kind that the candidate's form allows; a base entity is wholly of its kind."""
    found = candidates(text, own)
    words = [m.span() for m in _WORD.finditer(text)] if found else []
    for kind, s, e in found:
        fits = dict(plausible(text[s:e]))
        if kind >= 0:
            fits[kind] = 1.0
        for c in contexts(text, s, e, words):
            for of, fit in fits.items():
                yield {"kind": kind, "of": of, "fit": fit, "start": s, "end": e, "instance": text[s:e].lower(), "pattern": c}


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, found`` (base spans) and ``edges``: kind, of, fit, start, end, instance, pattern."""
    rows = docs.select(F.col("doc_id").alias("__key"), text_or_empty().alias("__text"))
    kind = rows.schema["__key"].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    edge = pa.struct([("kind", pa.int32()), ("of", pa.int32()), ("fit", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("pattern", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            found, edges = [], []
            for text in part.column("__text").to_pylist():
                own = base(text)
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                edges.append(list(edges_of(text, own)))
            yield pa.RecordBatch.from_arrays([part.column("__key"), pa.array(found, pa.list_(span)), pa.array(edges, pa.list_(edge))], names=["doc_id", "found", "edges"])

    out = "array<struct<kind:int,start:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {kind}, found {out}, edges array<struct<kind:int,of:int,fit:double,start:int,end:int,instance:string,pattern:string>>")


def bootstrapped(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``instance, kind``: identifiers that high-confidence patterns found.

    ``edges(kind, of, fit, instance, pattern)``, kind -1 where no base entity is,
    ``fit`` how plausible the instance's form is for the kind ``of``. In each round,
    a context is a pattern of each kind that enough of its instances are believed
    to be of by then, so that what one round found induces patterns of the next.
    An edge counts once, however many documents repeat it. Both scores are computed by
    partial sums, so a pattern that holds a third of all edges is no burden.
    """
    graph = kept(edges.groupBy("pattern", "of", "instance").agg(F.max("kind").alias("kind"), F.max("fit").alias("fit")))
    own = F.when(F.col("kind") == F.col("of"), 1.0).when(F.col("kind") >= 0, -1.0)
    belief = kept(graph.groupBy("instance", "of").agg(F.max("kind").alias("kind"), F.max("fit").alias("fit")).withColumn("belief", F.coalesce(own, F.lit(PRIOR))))
    scores = None
    for _ in range(rounds):
        judged = graph.select("pattern", "instance", "of").join(belief, ["instance", "of"])
        # believed instances over all, each as far as its form allows, with a doubt for each pattern; wrong kinds count against it
        score = F.sum(F.greatest("belief", F.lit(0.0))) / (F.sum("fit") + 0.5)
        enough = F.sum((F.col("belief") >= LEAST_BELIEF).cast("int")) >= LEAST_SEEDS
        old, scores = scores, kept(judged.groupBy("pattern", "of").agg(score.alias("score"), enough.alias("enough")).where("enough").drop("enough"))
        heard = judged.join(scores, ["pattern", "of"]).groupBy("instance", "of").agg((1 - F.exp(F.sum(F.log(F.lit(1.0001) - F.least("score", F.lit(1.0)))))).alias("heard"))
        before, belief = belief, kept(belief.drop("belief").join(heard, ["instance", "of"], "left").select("instance", "of", "kind", "fit", F.coalesce(own, F.col("heard") * F.lit(0.95) * F.col("fit"), F.lit(PRIOR)).alias("belief")))
        dropped(before, *([old] if old else []))
    found = belief.where((F.col("kind") < 0) & (F.col("belief") >= LEAST_BELIEF)).select("instance", "of", "belief")
    sure = graph.select("pattern", "instance", "of").join(scores.where(F.col("score") >= LEAST_SCORE), ["pattern", "of"]).select("instance", "of").distinct()
    out = kept(sure.join(found, ["instance", "of"]).groupBy("instance").agg(F.max_by("of", F.struct("belief", -F.col("of"))).alias("of")))
    dropped(graph, belief, scores)
    return out


def extract(docs: DataFrame) -> DataFrame:
    """``doc_id, found, added``: base spans and the spans that the patterns add, one row per row of ``docs(doc_id, text)``.

    Null and empty texts have no span. Repeated rows get equal spans; each
    counts once in the graph. An empty table gives no rows; further columns are
    ignored, whatever their names. Whole texts are read. Of an instance with
    equal beliefs in two kinds the first kind counts.
    """
    rows = kept(scanned(docs).withColumn("row", F.monotonically_increasing_id()))
    edges = rows.select("row", F.explode("edges").alias("e")).select("row", "e.*")
    new = bootstrapped(edges.select("kind", "of", "fit", "instance", "pattern"))
    spans = edges.where(F.col("kind") < 0).select("row", "start", "end", "instance").distinct().join(new, "instance")
    added = kept(spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("of").alias("kind"), "start", "end"))).alias("added")))
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select("row", "doc_id", "found").join(added, "row", "left").select("doc_id", "found", F.coalesce("added", nothing).alias("added"))


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns; the counts are those of the base entities, ``n_added`` of the method's."""
    rows = extract(docs)
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select(
        "doc_id", *counts, F.sha2(joined(F.col("found")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("found", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
