"""Alignment of two tokenizers: against whole texts encoded by the libraries and all pairs of tokens."""

import collections
import hashlib
import random

import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pagewright.llm import token_align as t
from pagewright.llm.token_index import tokenizer_path

A, B = tokenizer_path(t.MODEL_A), tokenizer_path(t.MODEL_B)
NAMES = ["doc_id", *t.NUMBERS, "groups"]


def brute(rows):
    """Rows (doc_id, numbers, groups), by comparing every token of A with every one of B."""
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = t.byte_of_letter()
    docs, count = [], collections.Counter()
    for _, text in rows:
        x = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        bx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)]]
        spelled = f" {text}".encode()
        if not text or b"".join(bx) != spelled or b"".join(by) != spelled:
            docs.append(None)
            continue
        spans = []
        for pieces in (bx, by):
            at, out = 0, []
            for p in pieces:
                out.append((at, at + len(p)))
                at += len(p)
            spans.append(out)
        sx, sy = spans
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if sx[i][0] < sy[j][1] and sy[j][0] < sx[i][1]]
        count.update(links)
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            groups.append(",".join(str(i) for i, s in zip(x, sx) if low < s[1] <= high) + "|" + ",".join(str(i) for i, s in zip(y, sy) if low < s[1] <= high))
        docs.append((len(x), len(y), links, groups))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for (i, _), d in zip(rows, docs):
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, d[0], d[1], len(d[3]), len(d[2]), sum(count[k] == best[k[1]] for k in d[2]), sum(count[k] for k in d[2]), ";".join(d[3])))
    return sorted(out, key=repr)


def got(spark, rows, budget=t.BUDGET):
    df = spark.createDataFrame([(i, x, 1, "u") for i, x in rows], "doc_id long, text string, `row` int, u string")
    return sorted((tuple(r[c] for c in NAMES) for r in t.align_documents(df, A, B, budget=budget).documents.collect()), key=repr)


BITS = ["the", "The", "can't", "I'll", "été", "größe", "naïve", "東京タワー", "😀👍🏽", "a", "", "", "\n", "\t", " ", "　", "123456", "3.14", "!!!", "---", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "Ġ", "x" * 40, "é", "​", "\x00", "'s", "foo_bar(baz)", " ", "ª", "²"]


def texts(seed, n):
    rng = random.Random(seed)
    return [(k, "".join(rng.choice(BITS) + rng.choice([" ", " ", " ", "", "  "]) for _ in range(rng.randint(1, 30)))) for k in range(n)]


@pytest.mark.parametrize("budget", [t.BUDGET, 4000, 0])
def test_documents_equal_brute_force(spark, budget):
    rows = texts(3, 150)
    assert got(spark, rows, budget) == brute(rows)


def test_odd_rows(spark):
    long = "Wort für Wort ohne Ende. " * 4000 + "ohneleerzeichen" * 300
    rows = [(1, None), (2, ""), (3, "the same text"), (3, "the same text"), (None, "no id"), (4, "the mark ▁ is no space"), (5, " "), (6, "   two  spaces "), (7, long), (8, "x")]
    short = [r for r in rows if r[0] != 7]
    want = brute(short)
    assert [r for r in got(spark, short)] == want
    whole = got(spark, rows)
    assert [r[1:3] for r in whole if r[0] in (1, 2, 4)] == [(0, 0)] * 3
    d = next(r for r in whole if r[0] == 7)
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    assert d[1:3] == (len(a.encode(f" {long}").ids), len(b.encode(long))) and d[4] == d[1] + d[2] - d[3] and d[7].count(";") + 1 == d[3]
    ids = [[int(i) for g in d[7].split(";") for i in g.split("|")[side].split(",")] for side in (0, 1)]
    assert ids == [a.encode(f" {long}").ids, b.encode(long)]
    assert got(spark, []) == []


def test_table_of_the_smallest_scale(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text) < 3000]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    out = t.align_documents(few, A, B).documents
    assert sorted((tuple(r[c] for c in NAMES) for r in out.collect()), key=repr) == brute(rows)


def test_units_have_the_tokens_of_their_text(spark):
    assert t.divides_at_spaces(A, B)
    rows = texts(11, 300)
    df = spark.createDataFrame(rows, "k long, x string")
    split = {r.k: r.u for r in df.select("k", t.units_of(df.x, True).alias("u")).collect()}
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for k, x in rows:
        assert " ".join(split[k]) == x
        if "▁" not in x:
            assert [i for u in split[k] for i in a.encode(f" {u}").ids] == a.encode(f" {x}").ids
            assert [i for u in split[k] for i in b.encode(u)] == b.encode(x)
    assert sum(map(len, split.values())) > 3 * len(rows)


@pytest.mark.parametrize("budget", [t.BUDGET, 0])
def test_texts_that_are_not_spelled_do_not_count(spark, monkeypatch, budget):
    # as with a model that reads some characters as others: found by their units alone
    monkeypatch.setattr(t, "MARK", "\ue000")
    rows = [(1, "the same ▁ text"), (2, "the same text"), (3, "▁"), (4, "same ▁▁ a")]
    monkeypatch.setattr(t, "divides_at_spaces", lambda a, b: True)
    assert got(spark, rows, budget) == brute(rows)


def test_whole_texts_are_units_where_spaces_divide_nothing(spark, monkeypatch):
    monkeypatch.setattr(t, "divides_at_spaces", lambda a, b: False)
    rows = texts(7, 40) + [(99, "the mark ▁ again")]
    assert got(spark, rows) == brute(rows)


def test_what_is_broadcast_fits_the_budget(spark):
    table = spark.createDataFrame([(k, k + 1, "x" * 10) for k in range(1000)], "k long, n long, x string")
    size = t.F.octet_length("x")
    for budget in (0, 10, 500, 5000, 10_000):
        often, seldom = t._split(table, "n", size, budget)
        assert 10 * often.count() <= budget and often.count() + seldom.count() == 1000
        if often.count() and seldom.count():
            assert often.agg(t.F.min("n")).first()[0] > seldom.agg(t.F.max("n")).first()[0]


def test_digest_of_groups(spark):
    rows = [(1, "hello there"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = t.align_documents(df, A, B)
    assert found.pairs.agg(t.F.sum("links")).first()[0] == sum(r[4] for r in brute(rows))
    groups = {r.doc_id: r.groups for r in found.documents.collect()}
    assert groups[2] == "" and hashlib.sha256(groups[1].encode()).hexdigest() == hashlib.sha256(brute(rows)[0][7].encode()).hexdigest()


def test_units_part_at_seams_too(monkeypatch):
    seams = t.seams_of(B)
    lists = lambda texts: t._units(pa.array(texts, pa.string()), seams).to_pylist()
    assert lists(["Of that.\nThen, it's"]) == [[" Of", " that", ".", "\n", "Then", ",", " it", "'s"]]
    assert lists(["a  b \n c"]) == [[" a  b \n c"]]
    assert lists([None, "x", None]) == [[], [" x"], []] and lists([]) == []
    rng = random.Random(5)
    letters = "ab12²'.,-_ \n\n\t\ré☃ªⅣ́​͸😀ßñ<>|s't中ー。\xa0"
    rows = [x for _, x in texts(12, 200) if x and "▁" not in x] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(2000)]
    a, b, both = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), t.Tokenizers(A, B)
    a.encode_special_tokens = True
    for block in (t.BLOCK, 37):  # characters and their neighbours lie across blocks
        monkeypatch.setattr(t, "BLOCK", block)
        divided = lists(rows)
        for x, units in zip(rows, divided):
            assert "".join(units) == f" {x}"
            of_b, ids, numbers = both.encode(units, seams)
            assert numbers.min() > 0 and ids[~of_b].tolist() == a.encode(f" {x}").ids and ids[of_b].tolist() == b.encode(x)
    of_b, ids, numbers = both.encode([u for units in divided for u in units], seams)  # many at a time
    assert ids[of_b].tolist() == [i for x in rows for i in b.encode(x)] and ids[~of_b].tolist() == [i for x in rows for i in a.encode(f" {x}").ids]


def test_words_with_and_without_punctuation_are_one_unit(spark):
    # each distinct unit is tokenized, aligned and scored: what only punctuation tells apart costs nothing anew
    words = ["".join(random.Random(k).choices("aeinrst", k=9)) for k in range(50)]
    rows = [(k, f"{w} {w}, {w}. {w}!! {w}; ({w}) {w}:\n{w}") for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = t.align_documents(df, A, B)
    assert found.units.count() <= 3 * len(words) + 20
    assert sorted((tuple(r[c] for c in NAMES) for r in found.documents.collect()), key=repr) == brute(rows)
