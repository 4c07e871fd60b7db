import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from page_fixtures import hard, pages, with_clashes  # noqa: F401
from leafscribe.llm.packing import TightestWindow, TokenIds, best_fit, packed  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
IDS = TokenIds(PATH)
PARTS = ["a", "b", "'s", "'ll", " ", "  ", "\n", "\t", ".", ", ", "é", "ß", "9", "½", "Ⅷ", "🙂", "\x1c", "\x85"]


def whole(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=500)
@given(st.lists(st.sampled_from([*PARTS, "<|endoftext|>", "　"]), max_size=14).map("".join))
def test_ids_of_odd_texts(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == whole(text)


@given(st.text(max_size=40))
def test_ids_of_any_text(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == whole(text)


@pytest.mark.parametrize("text", ["ab cd\n" * 100_000, " " * 400_000, "x" * 400_000], ids=["words", "spaces", "one"])
def test_ids_of_very_long_texts(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == whole(text)


@given(st.lists(st.integers(1, 20), max_size=60))
def test_tightest_window(lengths):
    window, offset = best_fit(np.array(lengths, np.int64), 20)
    room, at = {}, {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        enough = [c for c in room.values() if c >= lengths[i]]
        w = int(window[i])
        if enough:
            assert room[w] == min(enough)
        else:
            assert w not in room
        assert offset[i] == at.get(w, 0)
        room[w] = room.get(w, 20) - lengths[i]
        at[w] = at.get(w, 0) + lengths[i]


def test_take_from_empty():
    tree = TightestWindow(8)
    assert tree.take(1) is None
    tree.put(3, 0)
    assert tree.take(4) is None and tree.take(2) == (3, 0) and tree.take(1) is None


def test_pieces_cover_every_id(pages, hard, with_clashes):
    ids = [None, 5, 5, *range(7, 7 + len(hard) - 3)]
    rows = packed(with_clashes(pages(hard, ids).repartition(3)), PATH, length=64, shard_pieces=50).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = defaultdict(list)
    for doc_id, text in zip(ids, hard):
        tokens = [*whole(text or ""), 1]
        for s in range(0, len(tokens), 64):
            cut = np.array(tokens[s : s + 64], "<u4")
            want[doc_id].append((s, len(cut), zlib.crc32(cut.tobytes()), len(tokens)))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(r.length for r in rows) > 0.9 * 64 * len(sequences)


def test_no_pages(pages):
    assert packed(pages([]), PATH).collect() == []
