"""Spelling variants among the words of transcribed pages, by composing automata."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leafscribe.llm.common import pin, plain

#: A word is a maximal run of these letters; only A-Z are lower-cased.
WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Least length and least number of occurrences of a word; a form occurs at least so many times as often as its variant.
LENGTH, COUNT, RATIO = 5, 3, 2
#: Different words that a task counts before it passes the counts on.
COUNTED = 400_000
#: Words behind one initial state that one task composes; more are parted by their next letter.
STATE_WORDS = 20_000
#: Rows of a batch of results.
ROWS = 50_000


def _with_fault(word: str, start: int, fault: int) -> str:
    """The word without one letter, if its checksum with the page's asks for it."""
    h = zlib.crc32(word.encode(), start)
    if h % fault:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def _counts(length: int, fault: int | None):
    def counted(held: dict[str, int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"], strict=True):
                text = text.as_py()
                if text is None:
                    continue
                # Repeats meet inside the page first.
                own: dict[str, int] = {}
                for m in WORD.finditer(text):
                    word = m.group()
                    own[word] = own.get(word, 0) + 1
                name = name.as_py()
                start = None if name is None or fault is None else zlib.crc32(f"{name}:".encode())
                for word, n in own.items():
                    word = word.translate(_LOWER) if not word.islower() else word
                    if start is not None:
                        word = _with_fault(word, start, fault)
                    if len(word) >= length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= COUNTED:
                    yield counted(held)
                    held = {}
        if held:
            yield counted(held)

    return run


def word_counts(pages: DataFrame, length: int = LENGTH, count: int = COUNT, fault: int | None = None) -> DataFrame:
    """Words of page texts that occur `count` times or more in all, and how often.

    A word is a maximal run of ASCII letters and U+00C0 to U+00FF, with A-Z lower-cased and `length` code points at least. With `fault`,
    reading faults are planted: where the CRC-32 h of `<doc_id>:<word>` is divisible by it, the word loses its code point h % its length
    on this page, before its length is looked at.

    pages: `doc_id`, `text`; other columns are not looked at. A null text has no words; a page without doc_id gets no faults. Every row
    counts, repeated ones too. Very long texts are read as a whole. No pages give no rows. Returns `word`, `n` (long).
    """
    counts = plain(pages).mapInArrow(_counts(length, fault), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Acceptor:
    """Minimal acyclic automaton of sorted words, built word by word; equal states are kept once.

    A state has arcs (letter to state, ascending), `final`, a bit mask of the lengths of the words that it accepts, and their number.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.lengths: list[int] = []
        self.count: list[int] = []
        self._known: dict[tuple, int] = {}
        path, last = [({}, False)], ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, same, last)
            path += [({}, False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, 0, last)
        self.start = self._state(*path[0])

    def _close(self, path: list, depth: int, last: str) -> None:
        while len(path) > depth + 1:
            arcs, final = path.pop()
            path[-1][0][last[len(path) - 1]] = self._state(arcs, final)

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            lengths, count = int(final), int(final)
            for to in arcs.values():
                lengths |= self.lengths[to] << 1
                count += self.count[to]
            self.arcs.append(arcs)
            self.final.append(final)
            self.lengths.append(lengths)
            self.count.append(count)
        return found

    def common(self, a: int, b: int, length: int, but: str = "") -> Iterator[str]:
        """Words of this length that both states accept; with `but`, none that begins with this letter."""
        if not (self.lengths[a] & self.lengths[b]) >> length & 1:
            return
        open_pairs = [(a, b, "", length)]
        while open_pairs:
            p, q, word, left = open_pairs.pop()
            if left == 0:
                yield word
                continue
            others = self.arcs[q]
            for letter, to in self.arcs[p].items():
                too = others.get(letter)
                if too is None or (letter == but and not word):
                    continue
                if (self.lengths[to] & self.lengths[too]) >> (left - 1) & 1:
                    open_pairs.append((to, too, word + letter, left - 1))


def composed(acceptor: Acceptor, size: int, first: bool) -> Iterator[tuple[str, str]]:
    """Pairs accepted by the acceptor, one edit and the acceptor again: words of length `size` with others of this length, one
    letter replaced, or with others one letter longer. Each pair comes once, the shorter or smaller word first.

    States of the composition are pairs of states with the number of edits so far. As long as it is zero both are the same; after the
    edit only equal letters follow. With `first` the edit is at the first letter. An inserted letter is the last one of its run.
    """
    open_states = [(acceptor.start, "")]
    while open_states:
        state, word = open_states.pop()
        left = size - len(word)
        arcs = acceptor.arcs[state]
        letters = list(arcs.items())
        for i, (letter, to) in enumerate(letters):
            # One letter more on the right.
            if left >= 0:
                for rest in acceptor.common(state, to, left, letter):
                    yield word + rest, word + letter + rest
            if left >= 1:
                for other, too in letters[i + 1 :]:
                    for rest in acceptor.common(to, too, left - 1):
                        yield word + letter + rest, word + other + rest
            # A single word behind a state has no partner there.
            if not first and acceptor.count[to] > 1:
                open_states.append((to, word + letter))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word with near words behind an initial state: their number, and the most frequent one (ties: the smallest)."""
    out = {"word": [], "n_near": [], "near": [], "near_n": []}

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        found = pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))
        for v in out.values():
            v.clear()
        return found

    def solve(state: tuple, counts: dict[str, int]) -> None:
        backward, size, prefix, tail = state
        skip, half = len(prefix), size // 2
        best: dict[str, list] = {}
        for pair in composed(Acceptor(sorted(w[skip:] for w in counts)), size - skip, tail is not None):
            a, b = prefix + pair[0], prefix + pair[1]
            # Pairs that share the first half of the shorter word are found on the forward side.
            if backward and a[::-1][:half] == b[::-1][:half]:
                continue
            for word, near in ((a, b), (b, a)):
                n, word, near = counts[near], word[::-1] if backward else word, near[::-1] if backward else near
                held = best.setdefault(word, [0, near, n])
                held[0] += 1
                if n > held[2] or (n == held[2] and near < held[1]):
                    held[1:] = near, n
        for word, (n, near, near_n) in best.items():
            for column, value in zip(out.values(), (word, n, near, near_n), strict=True):
                column.append(value)

    state, counts = None, {}
    names = ["backward", "size", "prefix", "tail"]
    for rows in batches:
        columns = [rows[c].to_pylist() for c in (*names, "word", "n")]
        for *place, word, n in zip(*columns, strict=True):
            if place != state:
                if len(counts) > 1:
                    solve(state, counts)
                    if len(out["word"]) >= ROWS:
                        yield batch()
                state, counts = place, {}
            counts[word] = n
    if len(counts) > 1:
        solve(state, counts)
    if out["word"]:
        yield batch()


def _initial_states(words: DataFrame) -> DataFrame:
    """Each word at the states after its first half, and backward after its second half, with words of its own length and with
    words one letter longer or shorter. Two words that differ by one edit share one of these states."""
    turned = F.reverse("word")
    sides = F.array(
        F.struct(F.lit(False).alias("backward"), F.col("word").alias("read")),
        F.struct(F.lit(True).alias("backward"), turned.alias("read")),
    )
    length = F.length("word")
    # `size` is the length of the shorter word of a pair.
    rows = words.select("n", F.explode(sides).alias("s"), F.explode(F.array(length, length - 1)).alias("size"))
    half = F.expr("size div 2")
    kept = F.when(F.col("s.backward"), F.col("size") - half).otherwise(half)
    prefix = F.substr(F.col("s.read"), F.lit(1), kept)
    return rows.select("s.backward", "size", prefix.alias("prefix"), F.lit(None).cast("string").alias("tail"), F.col("s.read").alias("word"), "n")


def _bounded(rows: DataFrame, most: int) -> DataFrame:
    """The same composition over initial states with at most `most` words each.

    A larger state is taken one letter further. The edits at its own first letter are composed apart: there the words agree after
    the edit, so they are grouped by what follows it (`tail`), at most two words for each letter.
    """
    state = ["backward", "size", "prefix"]
    done = []
    while True:
        sizes = pin(rows.groupBy(*state).agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most).drop("words"))
        if sizes.isEmpty():
            break
        rows = pin(rows)
        # Fewer than one state in `most` words: still joined by a shuffle, split where skewed.
        done.append(rows.join(sizes, state, "left_anti").select(*rows.columns))
        large = rows.join(sizes, state, "left_semi").select(*rows.columns)
        at = F.length("prefix")
        rest = F.substr(F.col("word"), at + 1)
        after = F.substr(F.col("word"), at + 2)
        # A word of the shorter length can lack the letter or have another one; a longer one has one more.
        tails = F.when(F.length("word") > F.col("size"), F.array(after)).when(rest == "", F.array(rest)).otherwise(F.array(rest, after))
        edits = large.withColumn("tail", F.explode(F.array_distinct(tails))).select(*rows.columns)
        done.append(edits)
        rows = large.where(rest != "").withColumn("prefix", F.substr(F.col("word"), F.lit(1), at + 1))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: forms are followed to the last, twice as far each time."""
    known = pin(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = pin(known.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        known = joined.select("word", "root")
        if joined.where("moved").isEmpty():
            return known


def spelling_variants(words: DataFrame, ratio: int = RATIO, state_words: int = STATE_WORDS) -> DataFrame:
    """Words of transcribed pages that differ by one inserted, deleted or replaced code point from a more frequent one.

    The vocabulary's acceptor is parted by initial states: those after the first half of a word, and, for the words read backward,
    those after the second half. Two words at one edit share such a state: the half of the shorter one that the edit leaves alone. Behind
    each state the minimal acceptor is built, composed with a one-edit transducer and with itself, and the accepted pairs are enumerated;
    only numbers of near words and the best one leave the task. Every pair is found behind exactly one state. A state with more than `state_words`
    words is taken further letter by letter, the edits at its own letter apart, so no task holds more. Words of one length
    meet words of that length or one more only.

    words: `word` and `n` (occurrences), as `word_counts` gives them, one row a word; other columns are not looked at. Null words are left out, a
    null `n` counts as zero. Words may be empty or very long. The form of a word is its near word with the largest n (ties: the
    smallest in code-point order) if that is `ratio` (more than 1) or more times its own; the root is the last of the forms that follow each other,
    the word itself if it has no form. No words give no rows.
    Returns `word`, `form`, `root`, `n`, `n_near` (number of near words), `form_n`.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms must not follow each other in a circle")
    words = pin(words.where("word IS NOT NULL").select("word", F.coalesce(F.col("n").cast("long"), F.lit(0).cast("long")).alias("n")))
    rows = _bounded(_initial_states(words), state_words)
    place = ["backward", "size", "prefix", "tail"]
    rows = rows.repartition(*place).sortWithinPartitions(*place)
    near = rows.mapInArrow(_near, StructType.fromDDL("word string, n_near long, near string, near_n long"))
    best = F.struct((-F.col("near_n")).alias("down"), "near")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    joined = words.join(near, "word", "left")
    frequent = -F.col("best.down") >= ratio * F.col("n")
    forms = pin(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.down")).alias("form_n"),
        )
    )
    roots = _roots(forms.where("form IS NOT NULL"))
    named = forms.join(roots, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
