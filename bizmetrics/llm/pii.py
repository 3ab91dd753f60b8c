"""Personal data: patterns, and a skip-chain conditional random field that adds to them.

The nodes of a document's field are its tokens with a digit or an at-sign; tokens without are
only observed. A node has potentials from its own features (shape, signs, words beside it,
the pattern that covers it), neighbours share a chain potential, and distant tokens with equal
letters and digits, or equal digits alone, share a skip potential. Equal tokens are linked one
to the next, so a token that stands n times has n - 1 skip edges. Loopy message passing over
chain and skip edges runs for all documents of a batch at once, as array operations.

Weights are trained piecewise on the patterns' own labels in a bounded sample of documents:
a softmax regression for the nodes, where each node is seen with and without the feature that
tells its pattern, and association of labels across chain and skip edges. In a document,
tokens in pattern matches are evidence with their label fixed. Another token becomes a span
if a skip path joins it to such evidence, its label has a posterior of ``SURE`` and most of
it is not in another span: the same number written otherwise, or without what the pattern asks.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bizmetrics.llm.shared import prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
SAMPLE = 2000  # documents that are fitted, the bound of what reaches the driver with
SAMPLE_CHARS = 16_384  # the longest text that may be one of them
FEATURES = 1 << 13
ROUNDS = 10  # of message passing
EDGES = 1 << 15  # whose messages are made at a time
DAMPING = 0.5
SURE = 0.5
AGREE = 10.0  # skip edges of each label with itself that count before any is seen
STRONGEST = 4.0  # largest association of two labels across an edge
STEPS, RATE, RIDGE = 150, 0.5, 1.0
FIXED = 50.0

_SOME = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
# Each is the pattern, or its part from the at-sign, in a form that never tries a place twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNS = re.compile(r"[^0-9A-Za-z]+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, int]  # start, kind, end


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Matches of the four patterns, leftmost and not overlapping within a kind, sorted."""
    out: list[Span] = []
    done = 0  # end of the last e-mail address
    for match in _DOMAIN.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            out.append((start, 0, done))
    for match in _DOTTED.finditer(text):
        # Four parts at a time; a rest of fewer is no match.
        parts = match.group().split(".")
        start = match.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((start, 1, end))
            start = end + 1
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(match.group()))) <= 15:
                out.append((match.start(), 3, match.end()))
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _shape(token: str) -> str:
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: f"<{min(len(m.group()), 20)}>", token))[:32]


def _hashed(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % FEATURES


@dataclass
class Field:
    """Nodes of some documents and their edges."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray  # of the pattern that covers the node's core, 0 if none
    features: np.ndarray  # nodes by features, the last one tells the pattern
    chain: np.ndarray  # pairs of nodes
    skip: np.ndarray


WIDTH = 7  # features of a node


def field(texts: list[str], spans: list[list[Span]]) -> Field:
    nodes: list[tuple[int, int, int, int]] = []
    features: list[list[int]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    for doc, (text, base) in enumerate(zip(texts, spans, strict=True)):
        last_key: dict[str, int] = {}
        before, was_node = "^", False
        waiting = False  # the next token's word is a feature of the last node
        covered = 0
        for match in _TOKEN.finditer(text):
            token = match.group()
            word = token.lower()[:16]
            if waiting:
                features[-1][4] = _hashed(f"next {'#' if _SOME.search(word) else word}")
                waiting = False
            if not _SOME.search(token):
                before, was_node = word, False
                continue
            signs = _SIGNS.match(token)
            start = match.start() + (signs.end() if signs else 0)
            core = _SIGNS.sub("", token)
            end = match.start() + len(token.rstrip("!\"#$%&'()*,-./:;<=>?[]^_`{|}~"))
            if end <= start:
                start, end = match.start(), match.end()
            if start > match.start() and text[start - 1] in "+(":
                start -= 1
            while covered < len(base) and base[covered][2] <= match.start():
                covered += 1
            label = 0
            for a, kind, b in base[covered:]:
                if a >= match.end():
                    break
                if a < end and b > start and 2 * (min(b, end) - max(a, start)) >= end - start:
                    label = 1 + kind
                    break
            me = len(nodes)
            nodes.append((doc, start, end, label))
            features.append([
                _hashed("bias"), _hashed(f"shape {_shape(token)}"),
                _hashed(f"digits {sum(c.isdigit() for c in core)} {'@' in token} {token.count('.')} {token[0]}"),
                _hashed(f"before {'#' if was_node else before}"), _hashed("next $"),
                _hashed(f"letters {any(c.isalpha() for c in core)} {token.count('-')}"), _hashed(f"pattern {label}"),
            ])
            if was_node:
                chain.append((me - 1, me))
            digits = "".join(_DIGITS.findall(core))
            for key in {core.lower() if len(core) >= 4 else "", digits if len(digits) >= 4 else ""}:
                if key:
                    if key in last_key:
                        skip.append((last_key[key], me))
                    last_key[key] = me
            was_node = waiting = True
    columns = np.array(nodes, np.int64).reshape(-1, 4).T
    return Field(
        *columns, np.array(features, np.int64).reshape(-1, WIDTH),
        np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2),
    )


@dataclass
class Model:
    weights: np.ndarray  # features by labels
    chain: np.ndarray  # labels by labels
    skip: np.ndarray

    def posteriors(self, of: Field) -> np.ndarray:
        """Nodes by labels, after loopy message passing; the labels of patterns are fixed."""
        n = len(of.doc)
        own = self.weights[of.features].sum(axis=1)
        known = of.label > 0
        own[known, of.label[known]] += FIXED
        edges = np.concatenate([of.chain, of.skip])
        # Both directions of an edge beside each other: the reverse of message e is e ^ 1.
        source, target = edges.ravel(), edges[:, ::-1].ravel()
        pair = np.stack([self.chain, self.skip])
        kind = np.repeat([0, 1], [2 * len(of.chain), 2 * len(of.skip)])
        back = np.arange(len(source)) ^ 1
        sent = np.zeros((len(source), LABELS))

        def beliefs() -> np.ndarray:
            return own + np.stack([np.bincount(target, sent[:, y], n) for y in range(LABELS)], axis=1)

        for _ in range(ROUNDS if len(source) else 0):
            rest = beliefs()[source] - sent[back]
            new = np.empty_like(sent)
            for at in range(0, len(source), EDGES):
                part = slice(at, at + EDGES)
                value = rest[part, :, None] + pair[kind[part]]
                top = value.max(axis=1)
                new[part] = top + np.log(np.exp(value - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            sent = DAMPING * sent + (1 - DAMPING) * new
        value = beliefs()
        value = np.exp(value - value.max(axis=1, keepdims=True))
        return value / value.sum(axis=1, keepdims=True)


def _association(pairs: np.ndarray, label: np.ndarray, same: float) -> np.ndarray:
    """How much oftener two labels meet across an edge than by chance, as a symmetric log;
    ``same`` edges of each label with itself, and half an edge of all, count beforehand."""
    counts = 0.5 + same * np.eye(LABELS)
    np.add.at(counts, (label[pairs[:, 0]], label[pairs[:, 1]]), 1.0)
    counts = counts + counts.T  # an edge has no direction
    p = counts / counts.sum()
    return np.clip(np.log(p / np.outer(p.sum(axis=1), p.sum(axis=0))), -STRONGEST, STRONGEST)


def train(of: Field) -> Model:
    """Piecewise: nodes by softmax regression, with and without their pattern; edges apart."""
    hidden = of.features.copy()
    hidden[:, -1] = _hashed("pattern 0")
    features, label = np.concatenate([of.features, hidden]), np.concatenate([of.label, of.label])
    wanted = np.eye(LABELS)[label]
    weights, squares = np.zeros((FEATURES, LABELS)), np.full((FEATURES, LABELS), 1e-8)
    flat = features.ravel()
    for _ in range(STEPS if len(label) else 0):
        score = weights[features].sum(axis=1)
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = np.repeat((p - wanted) / len(label), features.shape[1], axis=0)
        slope = np.stack([np.bincount(flat, error[:, y], FEATURES) for y in range(LABELS)], axis=1) + RIDGE * weights / len(label)
        squares += slope**2
        weights -= RATE * slope / np.sqrt(squares)
    return Model(weights, _association(of.chain, of.label, 0.0), _association(of.skip, of.label, AGREE))


def _joined_to_evidence(of: Field) -> np.ndarray:
    """For each node the label that skip paths join it to, 0 if none; the least of several."""
    root = list(range(len(of.doc)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in of.skip.tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(len(root))], np.int64)
    least = np.full(len(root), LABELS)
    known = of.label > 0
    np.minimum.at(least, roots[known], of.label[known])
    return np.where(least[roots] == LABELS, 0, least[roots])


def found(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Pattern spans, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    # Only documents with evidence can have more.
    some = [i for i, spans in enumerate(base) if spans]
    every = [list(spans) for spans in base]
    of = field([texts[i] for i in some], [base[i] for i in some])
    if len(of.doc):
        posterior = model.posteriors(of)
        label = posterior.argmax(axis=1)
        add = (of.label == 0) & (label > 0) & (label == _joined_to_evidence(of)) & (posterior.max(axis=1) >= SURE)
        for k in np.flatnonzero(add).tolist():
            i, start, end = some[of.doc[k]], int(of.start[k]), int(of.end[k])
            every[i].append((start, int(label[k]) - 1, end))
    return [(b, sorted(set(e))) for b, e in zip(base, every, strict=True)]


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the ``sample`` different texts with the least hashes that have a digit or
    an at-sign and at most ``SAMPLE_CHARS`` characters."""
    able = rows.select("text", F.xxhash64("text").alias("h")).filter(
        (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike("[0-9@]")
    )
    # Hashes alone choose, so texts are only shuffled for the sample.
    last = able.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return train(field([], []))
    texts = able.filter(F.col("h") <= last).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text")
    texts = [r.text for r in texts.collect()]
    return train(field(texts, [base_spans(t) for t in texts]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Counts and places of personal data in every text.

    Returns one row per input row: ``doc_id, n_email, n_ip, n_card, n_phone`` (matches of the
    patterns), ``base_sha256`` of their places and ``spans``, these places and those that the
    field adds, as ``kind:start:end`` in code points, by start, then kind. Defined cases: null and
    empty texts have none; null and repeated ids and repeated rows are judged as they come;
    a table without digits and at-signs trains nothing; an empty table gives an empty result;
    other columns are ignored, whatever their names. All matching takes time in proportion to
    the text, whatever stands in it.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))
    shared = spark.sparkContext.broadcast(fit(rows, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            counts = np.zeros((len(KINDS), batch.num_rows), np.int64)
            digests, spans = [nothing] * batch.num_rows, [""] * batch.num_rows
            texts = [t or "" for t in batch.column(0).to_pylist()]
            able = [i for i, t in enumerate(texts) if _SOME.search(t)]
            for i, (base, every) in zip(able, found([texts[i] for i in able], shared.value), strict=True):
                for _, kind, _ in base:
                    counts[kind, i] += 1
                digests[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                spans[i] = joined(every)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), *[pa.array(c) for c in counts], pa.array(digests), pa.array(spans)],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string"
    )
