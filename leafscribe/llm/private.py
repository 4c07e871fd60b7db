"""Personal data in page texts: patterns, and a skip-chain random field that makes their labels agree."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafscribe.llm.common import per_slice, plain, slices

KINDS = ["email", "ip", "card", "phone"]
#: Token shapes are counted by hash in so many buckets, which bounds what tasks, driver and broadcast hold.
BUCKETS = 1 << 18
#: Pull of a pattern's match, of equal tokens far apart, and of neighbouring tokens (log potentials).
MATCHED, SKIP, CHAIN = 8.0, 6.0, 0.3
ROUNDS, DAMPING, SURE = 12, 0.3, 0.8

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_PART = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK, _SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")
_EDGE = "()[]{}<>\"'.,;:!?|*&%$#"

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost addresses, found from each `@` to both sides, so that no run is read twice."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    return found


def addresses(text: str) -> list[Span]:
    """Four numbers with dots between, from the left; those with a part above 255 are dropped."""
    found = []
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts: list[re.Match] = []
        for part in _PART.finditer(text, run.start(), run.end()):
            if parts and part.start() != parts[-1].end() + 1:
                parts = []
            parts.append(part)
            if len(parts) == 4:
                if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in parts):
                    found.append((parts[0].start(), parts[3].end()))
                parts = []
    return found


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def cards(text: str) -> list[Span]:
    """Runs of 13 to 19 digits, single spaces or hyphens between, with a right check digit."""
    found = []
    for run in _CARD.finditer(text):
        digits = run.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(run.span())
    return found


def phones(text: str) -> list[Span]:
    """International numbers of 9 to 15 digits."""
    found = []
    if "+" in text:
        for run in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, run.group())) <= 15:
                found.append(run.span())
    return found


_NUMBER = re.compile(r"[0-9][ .()-]?[0-9]")


def base_spans(text: str) -> list[list[Span]]:
    """Spans of each kind, in order."""
    numbers = _NUMBER.search(text) is not None
    dotted = numbers or "." in text
    return [emails(text), addresses(text) if dotted else [], cards(text) if numbers else [], phones(text)]


def _tokens(text: str) -> list[Span]:
    """Tokens with a digit or an `@`, without marks at their ends: only these can be personal data here.

    Found from the first digit or `@` to both sides, so that a long run without one is read once.
    """
    found, mark = [], _MARK.search(text)
    while mark:
        start = mark.start()
        while start and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, mark.end())
        end = space.start() if space else len(text)
        own = text[start:end]
        left = len(own) - len(own.lstrip(_EDGE))
        kept = own.strip(_EDGE)
        if kept:
            found.append((start + left, start + left + len(kept)))
        mark = _MARK.search(text, end)
    return found


def shape(token: str) -> str:
    """Letters as a, digits as 0, long runs shortened."""
    cut = re.sub(r"[0-9]", "0", re.sub(r"[^\W\d_]", "a", token))
    return re.sub(r"(.)\1{3,}", r"\1\1\1", cut)[:40]


@lru_cache(maxsize=100_000)
def bucket(token_shape: str) -> int:
    """The bucket that a shape is counted in, the same in every task."""
    return zlib.crc32(token_shape.encode("utf-8", "surrogatepass")) % BUCKETS


def _buckets(text: str, tokens: list[Span]) -> np.ndarray:
    return np.array([bucket(shape(text[s:e])) for s, e in tokens], np.int64)


def _same(token: str) -> str:
    """Tokens with the same value here are alike: all digits if there are many, else the lower-case token."""
    digits = re.sub(r"\D", "", token)
    return digits if len(digits) >= 7 else token.lower()


def _labels(tokens: list[Span], base: list[list[Span]]) -> np.ndarray:
    """0 outside, else 1 + kind of the pattern match that covers a part of the token."""
    result = np.zeros(len(tokens), np.int64)
    starts = np.array([s for s, _ in tokens])
    ends = np.array([e for _, e in tokens])
    for kind, spans in reversed(list(enumerate(base, 1))):
        for s, e in spans:
            result[np.searchsorted(ends, s, side="right") : np.searchsorted(starts, e)] = kind
    return result


class Field:
    """Skip-chain conditional random field over the tokens of one page.

    counts: how often each bucket of shapes (rows) has no label or each kind (columns); a bucket without a count leans
    to no label.
    """

    def __init__(self, counts: np.ndarray | None = None):
        self.shapes = np.zeros((BUCKETS, len(KINDS) + 1), np.float32)
        self.shapes[:, 1:] = -3.0
        if counts is not None:
            seen = counts.any(axis=1)
            smooth = counts[seen] + np.array([1.0] + [0.02] * len(KINDS))
            self.shapes[seen] = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def marginals(self, text: str, tokens: list[Span], labels: np.ndarray) -> np.ndarray:
        """Label probabilities of each token by loopy sum-product messages."""
        own = [text[s:e] for s, e in tokens]
        unary = self.shapes[_buckets(text, tokens)].astype(float)
        unary[np.flatnonzero(labels), labels[labels > 0]] += MATCHED
        # Neighbours in the page, and each token with the next one like it: no more links than twice the tokens.
        links, last = [(i, i + 1, CHAIN) for i in range(len(own) - 1)], {}
        for i, t in enumerate(own):
            key = _same(t)
            if key in last:
                links.append((last[key], i, SKIP))
            last[key] = i
        a, b = (np.array([x[k] for x in links], np.int64) for k in (0, 1))
        pull = np.exp(np.array([x[2] for x in links]))[:, None]
        source, target, pull = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([pull, pull])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        messages = np.zeros((len(source), unary.shape[1]))
        for _ in range(ROUNDS if len(source) else 0):
            belief = unary.copy()
            np.add.at(belief, target, messages)
            out = belief[source] - messages[back]
            p = np.exp(out - out.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            new = np.log(1 + (pull - 1) * p)
            messages = DAMPING * messages + (1 - DAMPING) * new
        np.add.at(unary, target, messages)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[list[Span]]) -> list[list[Span]]:
        """Spans that the field adds: tokens surely of a kind that touch no base span."""
        found: list[list[Span]] = [[] for _ in KINDS]
        tokens = _tokens(text)
        labels = _labels(tokens, base)
        for span, label, p in zip(tokens, labels, self.marginals(text, tokens, labels) if tokens else [], strict=True):
            kind = int(p.argmax())
            if label == 0 and kind and p[kind] >= SURE:
                found[kind - 1].append(span)
        return found


def learn_shapes(pages: DataFrame) -> Field:
    """Learns from the pattern matches of all pages how likely each token shape is of each kind.

    Every token of every page counts, at every size of the input. A task adds up its own counts first, so at most
    `BUCKETS` short rows per task are shuffled, and as many come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BUCKETS, len(KINDS) + 1), np.int64)
        for batch in batches:
            for _, texts in slices(batch["text"]):
                for text in texts:
                    tokens = _tokens(text)
                    if tokens:
                        np.add.at(counts, (_buckets(text, tokens), _labels(tokens, base_spans(text))), 1)
        seen = np.flatnonzero(counts.any(axis=1))
        if len(seen):
            yield pa.record_batch([pa.array(seen), *map(pa.array, counts[seen].T)], ["bucket", *columns])

    columns = [f"k{k}" for k in range(len(KINDS) + 1)]
    counted = plain(pages).mapInArrow(count, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    found = counted.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    counts = np.zeros((BUCKETS, len(columns)), np.int64)
    counts[found["bucket"].to_numpy()] = np.stack([found[c].to_numpy() for c in columns], axis=1)
    return Field(counts)


def _written(spans: list[list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans, strict=True) for s, e in sorted(own))


def private_data(pages: DataFrame) -> DataFrame:
    """Addresses, numbers and cards in every page text.

    Patterns give the base spans (email, ip, card, phone; leftmost, not overlapping within a kind). A skip-chain
    conditional random field over the page's tokens with digits or an `@` then adds tokens: neighbours and, however
    far apart, tokens with the same digits or letters share potentials, and loopy message passing makes their labels
    agree, on pages with and without base spans. Base spans always stay. The field's shape potentials are learnt from the
    pattern matches of all pages; very long texts are read whole.

    pages: `doc_id`, `text` (null: empty); other columns are not looked at. Returns per page `doc_id`, `n_email`, `n_ip`,
    `n_card`, `n_phone` (base spans), `base_sha256` (of kind:start:end, joined by commas, by kind, then start) and `spans`
    (all spans, joined likewise; code points, end exclusive). Repeated rows give a row each, no pages no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(learn_shapes(pages))

    def work(doc_ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
        counts, digests, spans = [], [], []
        for text in texts:
            base = base_spans(text)
            more = shared.value.added(text, base)
            counts.append([len(b) for b in base])
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            spans.append(_written([b + m for b, m in zip(base, more, strict=True)]))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
        names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
        return pa.record_batch([doc_ids, *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    rows = plain(pages)
    kind = dict(rows.dtypes)["doc_id"]
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(per_slice(work), f"doc_id {kind}, {counts}, base_sha256 string, spans string")
