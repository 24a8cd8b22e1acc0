"""What a Python worker holds while a step runs, and what it lets go of when the next one begins."""

import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece

from pagewright.llm import common, jaccard_tgm, spm_wfst


def test_paths_of_new_words_are_sought_a_few_at_a_time(monkeypatch):
    path = spm_wfst.tokenizer_path(spm_wfst.MODEL)
    t, sizes = spm_wfst.Transducer(path), []
    shortest = t.shortest
    monkeypatch.setattr(t, "shortest", lambda words: sizes.append((len(words), sum(map(len, words)))) or shortest(words))
    texts = [" ".join(f"w{k * 7919:x}é{k}" for k in range(n, n + 6000)) for n in (0, 6000)] + ["y" * 100_000 + " z"]
    coded = t.encode_batch(texts)
    assert sum(s for _, s in sizes) > 4 << 15
    assert all(s <= 1 << 15 or n == 1 for n, s in sizes)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [library.encode(x) for x in texts]


def test_pieces_share_the_parts_of_their_edges():
    t = spm_wfst.Transducer(spm_wfst.tokenizer_path(spm_wfst.MODEL))
    parts = [p for edges in (t.left_edge, t.right_edge) for e in edges if e for p in e]
    assert len({id(p) for p in parts}) == len(set(parts)) < len(parts) / 2


def test_what_the_step_before_remembers_goes_at_once(monkeypatch):
    done = []
    monkeypatch.setattr(common, "_holders", {})
    monkeypatch.setattr(common, "let_go", lambda: done.append("let go"))
    common.sole_memory("a", lambda: done.append("a cleared"))
    common.sole_memory("a", lambda: done.append("a cleared"))
    assert done == []
    common.sole_memory("b", lambda: None)
    assert done == ["a cleared", "let go"]


def test_letting_go_asks_arrow_as_well(monkeypatch):
    asked = []

    class Pool:
        def release_unused(self):
            asked.append(True)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    common.let_go()
    assert asked == [True]


def test_counts_of_a_range_take_few_bytes_a_hash():
    rng = np.random.default_rng(3)
    blobs, want = [], Counter()
    for _ in range(8):
        top = np.unique(rng.integers(0, 1 << 32, 100_000, dtype=np.uint32) & np.uint32(0xFFFF8000))
        counts = rng.integers(1, 9, len(top)).astype(np.uint32)
        want.update(dict(zip(top.tolist(), counts.tolist())))
        blobs.append(jaccard_tgm.pack(jaccard_tgm._steps(top), counts))
    n = sum(len(jaccard_tgm.unpack(b, np.uint32, np.uint32)[0]) for b in blobs)
    frame = pd.DataFrame({"rng": 0, "blob": blobs})
    tracemalloc.start()
    found = jaccard_tgm._sum_counts(frame, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for level, size, blob in found.itertuples(index=False):
        top, counts = jaccard_tgm.unpack(blob, np.uint32, np.uint32)
        assert len(top) == size and {int(c).bit_length() - 1 for c in counts} == {level}
        got.update(zip(np.cumsum(top, dtype=np.uint32).tolist(), counts.tolist()))
    assert got == {k: c for k, c in want.items() if c >= 4}
    assert peak < 32 * n, peak / n
