"""Small piece models of either kind, put together by hand: ids against the library's."""

import random
import struct

import pytest
import sentencepiece

from pagewright.llm import spm_wfst

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, body):
    if isinstance(body, int):
        return varint(number << 3) + varint(body)
    if isinstance(body, float):
        return varint(number << 3 | 5) + struct.pack("<f", body)
    return varint(number << 3 | 2) + varint(len(body)) + body


def model(path, kind, pieces, fallback=False, suffix=False, squeeze=False, prefix=True):
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(score)) + field(3, k)) for p, score, k in pieces)
    data += field(2, field(3, kind) + field(24, int(suffix)) + field(35, int(fallback)) + field(40, 0))
    data += field(3, field(1, b"identity") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))
    path.write_bytes(data)
    return str(path)


SPECIAL = [("<unk>", 0, UNKNOWN), ("<s>", 0, CONTROL), ("</s>", 0, CONTROL)]
LETTERS = ["▁", *"abcdé"]
MERGED = ["▁a", "ab", "bc", "▁ab", "abc", "cd", "dd", "▁c", "▁▁", "abab", "dé", "▁abc"]
OWN = [("ab", 0, USER), ("<sep>", 0, USER), ("abca", 0, USER), ("xyz", 0, USER), ("é", 0, USER)]


def pieces(kind, own):
    names = [p for p in MERGED + LETTERS if p not in {o[0] for o in own}]
    score = (lambda k, p: -float(k)) if kind == spm_wfst.BPE else (lambda k, p: -1.5 - (k * 7 % 5) * 0.37 - 0.9 / len(p))
    return SPECIAL + own + [(p, score(k, p), NORMAL) for k, p in enumerate(names)]


def texts(seed, n=500):
    rng = random.Random(seed)
    bits = ["a", "b", "c", "d", "é", " ", "ab", "abc", "x", "q", "東", "<sep>", "xyz", "abca", "<s>", "\n", "  ", "zz"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 18))) for _ in range(n)]


@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("own", [[], OWN])
@pytest.mark.parametrize("kind", [spm_wfst.BPE, spm_wfst.UNIGRAM])
def test_ids_equal_the_library(tmp_path, kind, own, fallback, squeeze):
    known = pieces(kind, own) + ([(f"<0x{b:02X}>", 0, BYTE) for b in range(256)] if fallback else [])
    path = model(tmp_path / "m", kind, known, fallback, squeeze=squeeze)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    mine = spm_wfst.Transducer(path)
    wrong = [(t, mine.encode(t), library.encode(t)) for t in texts(4) if mine.encode(t) != library.encode(t)]
    assert not wrong, (len(wrong), wrong[:3])


def test_unknown_characters_are_one_unk_a_run(tmp_path):
    for kind in (spm_wfst.BPE, spm_wfst.UNIGRAM):
        path = model(tmp_path / f"m{kind}", kind, [p for p in pieces(kind, []) if p[0] != "▁"])  # the mark is unknown as well
        mine = spm_wfst.Transducer(path)
        assert mine.encode("qq a q q") == sentencepiece.SentencePieceProcessor(model_file=path).encode("qq a q q")


def test_what_would_differ_is_refused(tmp_path):
    for name, make in {
        "suffix": lambda p: model(p, spm_wfst.BPE, pieces(spm_wfst.BPE, []), suffix=True),
        "unused": lambda p: model(p, spm_wfst.BPE, [*pieces(spm_wfst.BPE, []), ("ca", -50, UNUSED)]),
        "spaces": lambda p: model(p, spm_wfst.UNIGRAM, [*pieces(spm_wfst.UNIGRAM, []), ("a▁b", 0, USER)]),
    }.items():
        with pytest.raises(NotImplementedError):
            spm_wfst.Transducer(make(tmp_path / name))
