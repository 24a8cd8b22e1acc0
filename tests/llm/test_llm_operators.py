"""Operators over small tables with every odd row, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagewright.llm import cap_filters, chat, jaccard_tgm, langid_gru, maglev, matroska, mixing, quality_fm, spm_wfst, token_index
from pagewright.llm.components import connected_components

# clashing names: what operators call their own columns
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, slot int, shard int, hash string, size string, cid long, t string, y int, s_id long, `a.b` int, rest int, lang_pred string, comp long, kind int"
LONG = "palabra larga " * 20_000


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, g, s, len(t or ""), 0.5, 1, 2, "h", "s", 3, "t", 4, 5, 6, 7, "l", 8, 9) for i, t, g, s in rows], DOCS)


ODD = [
    (1, "the cat sat on the mat today", "en", "b"), (1, "the cat sat on the mat today", "en", "b"), (2, None, None, None), (None, "no id here at all", "en", "a"),
    (3, "", "de", "a"), (4, " \n\t ", "de", "c"), (5, LONG, "es", "c"), (1, "another text of the same id", "en", None), (7, "x", "en", "é"), (-4, "Ein kurzer Satz.", "de", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark, ODD).cache()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_token_index(spark, docs, tmp_path):
    path, tokenizer = f"file://{tmp_path}", token_index.tokenizer_path("word_bpe_49k.json")
    for name, table, shards in (("a", docs, 3), ("b", docs.limit(0), 2)):
        entries = token_index.write_shards(table, f"{path}/{name}", tokenizer, shards=shards)
        parts = token_index.build_index(entries, f"{path}/{name}-index", 2)
        found = token_index.lookup(token_index.all_keys(table), f"{path}/{name}-index", parts)
        got = _rows(token_index.read_digests(found, f"{path}/{name}"))
        assert found.where("shard is null").count() == 0
        if name == "b":
            assert got == []
            continue
        library = Tokenizer.from_file(tokenizer)
        ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _, _ in table.select("doc_id", "text", "lang", "source").collect()]
        want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=repr)
        assert sorted(((i, n, c) for i, _, n, c in got), key=repr) == want
        starts = sorted((s, n) for _, s, n, _ in got)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
        by_start = [i for _, i in sorted((s, i if i is not None else -(10**9)) for i, s, _, _ in got)]
        assert by_start == sorted(by_start)
        absent = spark.createDataFrame([(k, 0) for k in range(100, 150)] + [(1, 3)], "doc_id long, occurrence long")
        assert token_index.lookup(absent, f"{path}/{name}-index", parts).where("shard is not null").count() == 0


def test_token_index_of_a_hot_id(spark, tmp_path, monkeypatch):
    """A third of all rows have one id, most of them one text: they are many shards' work, and each is found."""
    monkeypatch.setattr(token_index, "NUMBERED", 64)
    path, tokenizer = f"file://{tmp_path}", token_index.tokenizer_path("word_bpe_49k.json")
    rows = [(50, "the same text") for _ in range(400)] + [(50, f"text number {k}") for k in range(20)] + [(k, f"some words {k}") for k in range(300)] + [(None, "no id")] * 90
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    entries = token_index.write_shards(table, f"{path}/s", tokenizer, shards=12)
    per_shard = {r["shard"]: r["count"] for r in entries.filter("doc_id = 50").groupBy("shard").count().collect()}
    assert len(per_shard) >= 4 and sorted(r.occurrence for r in entries.filter("doc_id = 50").collect()) == list(range(421))
    assert sorted(r.occurrence for r in entries.filter("doc_id is null").collect()) == list(range(90))
    parts = token_index.build_index(entries, f"{path}/i")
    found = token_index.lookup(token_index.all_keys(table), f"{path}/i", parts)
    got = token_index.read_digests(found, f"{path}/s").collect()
    library = Tokenizer.from_file(tokenizer)
    want = sorted((repr(i), zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows)
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_chat(spark):
    rows = [(1, 1, "assistant", "fine <|im_end|>", 9), (1, 0, "user", "hi", 9), (1, 1, "assistant", "fine <|im_end|>", 9), (2, 0, None, None, 9), (None, 0, "assistant", "lost", 9), (3, 0, "system\n<|x", "a" * 300_000, 9)]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}", 9) for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.digest(chat.format_chat(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for i, t, r, x, _ in rows if i == c)
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(got) == 5 and chat.digest(chat.format_chat(df.limit(0))).count() == 0
    apart = chat.format_chat(df).repartition(7)  # rows as files may give them
    assert _rows(chat.digest(chat.in_order(apart))) == _rows(chat.digest(chat.format_chat(df)))


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    content = [("text", "look: ", None, None, None, None, None), ("image", None, "s3", 10, 10, None, None)]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    rows = chat.format_chat(df, content="parts").orderBy("seq").collect()
    assert rows[0].formatted == "<|im_start|>user\nlook: <|image|><|im_end|>\n" and rows[0].expanded_tokens == 255
    a = rows[0].attachments[0]
    assert (a.kind, a.ref, rows[0].formatted[a.at : a.at + 9]) == ("image", "s3", "<|image|>") and rows[1].loss_start == rows[1].loss_end


def test_quality(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(5))
    rows = [(k, " ".join(word() + ("&&" if k % 2 else "") for _ in range(30)), "en", "a") for k in range(200)]
    table = _docs(spark, rows + [(None, None, None, None), (7, "dup id", "en", "a"), (900, "", "en", "a")])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(150)] + [(None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    model = quality_fm.train(table, quality_fm.learned_rows(labels), sample=50)
    got = {r.doc_id: r.score for r in quality_fm.score(table, model).collect()}
    assert len(got) == 202 and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.3) == (k % 2 == 0) for k in range(200) if k != 7)
    kept = quality_fm.keep_good(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= {k for k in range(0, 200, 2)} - {7}
    assert quality_fm.keep_good(table.limit(0), labels).count() == 0
    assert {r.score for r in quality_fm.score(table, quality_fm.train(table, labels.limit(0))).collect()} == {0.5}
    with_meta = quality_fm.train(table, labels, metadata=["n_chars"], sample=50)
    assert quality_fm.score(table, with_meta, metadata=["n_chars"]).count() == 203


def test_held_out_accuracy(spark):
    """Both classifiers' queries against the rows they may not learn from; every row has a result."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality_fm._digest(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r.predicted == marks[r.doc_id] for r in rows if r.held_out and r.doc_id in marks]
    assert len(held) > 50 and np.mean(held) >= 0.95
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid_gru._digest(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out and langs[r.doc_id]]
    assert len(held) > 300 and np.mean(held) >= 0.97


def test_quality_among_clashing_names_and_repeated_ids(spark):
    rows = [(k, ("good words here and there " if k % 2 else "&&& ||| !!! ") * (k % 5 + 1)) for k in range(60)]
    rows += [(3, f"a hot id, text {k}") for k in range(40)]
    clashing = [F.lit(k).alias(c) for k, c in enumerate(("y", "s_id", "a.b", "k", "t", "meta", "score", "h", "r", "d_id", "c0", "k0"))]
    table = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.length("text").alias("n_chars"), *clashing)
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(50)], "doc_id long, quality int, y int")
    model = quality_fm.train(table, labels, metadata=["n_chars"], sample=20)
    again = quality_fm.train(table.repartition(5, "text").select("*"), labels, metadata=["n_chars"], sample=20)
    assert (model.v == again.v).all() and len(model.mean) == len(quality_fm.STATS) + 1
    kept = quality_fm.keep_good(table, labels)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} >= {k for k in range(60) if k % 2}
    # every row's score, one at a time
    got = {(r.doc_id, r.text): r.score for r in quality_fm.score(table.drop("score"), model, metadata=["n_chars"], keep=("doc_id", "text")).collect()}
    for (i, t), score in got.items():
        b, x, s = quality_fm.features(t)
        assert score == pytest.approx(model.score(b, x, np.append(s, np.log1p(len(t))))), i


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (101, 101), (5, None), (200, 300), (300, 250)], "a long, b long")
    got = dict(_rows(connected_components(links)))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert connected_components(links.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_caps(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = [(k, (base[k % 12] + 0.06 * rng.normal(size=16)).tolist(), k % 2) for k in range(80)]
    rows += [(100 + k, rows[0][1], 0) for k in range(30)] + [(5, rows[0][1], 0), (None, rows[2][1], 0)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] + [1.0] * 15, 0), (204, rows[0][1], None), (205, [], 0), (206, rows[0][1][:8], 0), (207, [float("inf")] * 16, 1), (208, [2 * x for x in rows[0][1]], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, cid int")
    got = _rows(cap_filters.near_duplicates(df, block=block))
    ok = [k for k, (_, v, g) in enumerate(rows) if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    cos = lambda p, q: float(np.dot(p, q) / (np.linalg.norm(p) * np.linalg.norm(q)))
    near = {k: [j for j in ok if j != k and rows[j][2] == rows[k][2] and len(rows[j][1]) == len(rows[k][1]) and cos(rows[k][1], rows[j][1]) >= 0.98] for k in ok}
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids, default=None)
        want.append((i, len(near.get(k, [])), least, i is not None and i == least))
    assert got == sorted(want, key=repr)
    assert cap_filters.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [4, 16, 64, 256])
def test_caps_find_all_links_at_any_dimension(spark, dim):
    """Pairs just above the threshold, where directions differ most: none of them may be lost."""
    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1500, dim)))
    u = rng.normal(size=x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    t = rng.uniform(0.98001, 0.985, size=(len(x), 1))
    rows = np.concatenate([x, t * x + np.sqrt(1 - t * t) * u])
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in cap_filters.near_duplicates(df).collect()}
    want = (rows @ rows.T / np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(rows, axis=1)) >= 0.98).sum(1) - 1
    assert [got[k] for k in range(len(rows))] == want.tolist() and want.min() >= 1


def test_pieces(spark, docs):
    import sentencepiece

    path = spm_wfst.tokenizer_path(spm_wfst.MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = spm_wfst.encode(docs, path, keep=("doc_id", "t"))
    want = [(i, sp.encode(t or "")) for i, t, _, _ in ODD]
    assert _rows(got.select("doc_id", F.col("piece_ids"))) == sorted(want, key=repr) and all(r.round_trip for r in got.collect())
    back = spm_wfst.decode(got, path)
    assert _rows(back) == sorted(((i, t or "") for i, t, _, _ in ODD), key=repr)
    assert spm_wfst.encode(docs.limit(0), path).count() == 0


def test_languages(spark, docs):
    model = langid_gru.train(docs, docs_each=50)
    got = langid_gru.predict(docs, model, keep=("doc_id", "text")).collect()
    assert len(got) == len(ODD) and {r.lang_pred for r in got if not (r.text or "").strip()} == {"und"}
    assert all(r.lang_pred in ("en", "de", "es") and 0 < r.score <= 1 for r in got if (r.text or "").strip())
    kept = langid_gru.keep_identified(docs, 0.0)
    assert kept.columns == docs.columns and kept.count() == 7
    assert langid_gru.keep_identified(docs.limit(0)).count() == 0
    nobody = langid_gru.train(docs.where("lang is null"))
    assert {r.lang_pred for r in langid_gru.predict(docs, nobody).collect()} == {"und"}


def test_language_sample_is_bounded_by_rows(spark):
    # one id holds most rows, and one row repeats
    rows = [(7, f"palabra larga numero {k}", "es", "a") for k in range(180)] + [(k, f"ein kurzer satz {k}", "de", "a") for k in range(11)]
    rows += [(500, "the same row", "en", "a")] * 400 + [(k, f"some other rows {k}", "en", "a") for k in range(600, 604)] + [(None, "no id", "fr", "a"), (3, "no language", None, "a")]
    table = _docs(spark, rows)
    got = langid_gru.sample_rows(table, "text", "lang", "doc_id", 10)
    assert {g: sum(x == g for x, _ in got) for g in ("de", "en", "es", "fr")} == {"de": 10, "en": 5, "es": 10, "fr": 0} and len(set(got)) == len(got)
    assert langid_gru.sample_rows(table.repartition(3), "text", "lang", "doc_id", 10) == got


def test_language_stage_drops_only_what_has_no_letter(spark, monkeypatch):
    # a short clean document scores low where languages share its words
    monkeypatch.setattr(langid_gru, "train", lambda docs, f=langid_gru.train: f(docs, docs_each=20))
    langs = ("de", "en", "es", "fr")
    rows = [(k, "animal normal total", langs[k % 4], "a") for k in range(160)] + [(900, "animal", "es", "a"), (901, "123 ...", "en", "a"), (902, None, "en", "a")]
    table = _docs(spark, rows)
    scores = [r.score for r in langid_gru.predict(table, langid_gru.train(langid_gru.learned_rows(table))).collect() if r.doc_id < 901]
    assert sum(s < 0.4 for s in scores) == 160
    dropped = {r.doc_id for r in table.collect()} - {r.doc_id for r in langid_gru.keep_identified(table).collect()}
    assert dropped == {901, 902}
    unlabelled = table.withColumn("lang", F.lit(None).cast("string"))
    assert _rows(langid_gru.keep_identified(unlabelled)) == _rows(unlabelled)


def test_sharding(spark, docs, tmp_path):
    names = maglev.shard_names(5)
    placed = maglev.place(docs, "doc_id", names, 101)
    table = maglev.lookup_table(names, 101)
    slot = lambda i: int(hashlib.md5(("\\N" if i is None else str(i)).encode()).hexdigest()[:12], 16) % 101
    assert set(placed.columns) == set(docs.columns)
    assert _rows(placed.select("doc_id", "slot", "shard")) == sorted(((i, slot(i), table[slot(i)]) for i, *_ in ODD), key=repr)
    assert maglev.place(docs.limit(0), "doc_id", names, 101).count() == 0
    maglev.write_shards(docs.select("doc_id", "text"), "doc_id", names, str(tmp_path / "s"), size=101)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "SortMergeJoin" not in plan


def _near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(20)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 60))]
        if rng.random() < 0.5:
            base[3:3] = shared
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) if rng.random() < 0.7 else "\n".join(copy).upper())
    chain = [word() for _ in range(40)]
    for k in range(25):  # each like the next, the ends unlike
        texts.append(" ".join(chain))
        chain = [*chain[1:], word()]
    return texts + texts[:9] + ["a b", "A  b", "a b c", "", None, "\n"]


@pytest.mark.parametrize(("group", "frequent", "seed"), [(64, 1 << 21, 1), (2, 50, 2), (3, 0, 3)])
def test_jaccard_join(spark, monkeypatch, group, frequent, seed):
    monkeypatch.setattr(jaccard_tgm, "GROUP", group)
    monkeypatch.setattr(jaccard_tgm, "QUERIES", 3)
    monkeypatch.setattr(jaccard_tgm, "frequent", lambda base, f=jaccard_tgm.frequent: f(base, frequent))
    texts = _near_copies(seed)
    rows = [(k, t, "en", "a") for k, t in enumerate(texts)] + [(3, texts[10], "en", "a"), (None, texts[1], "en", "a"), (None, "only here", "en", "a")]
    got = _rows(jaccard_tgm.near_duplicates(_docs(spark, rows).repartition(3)))
    sets = [set(jaccard_tgm.shingles(t).tolist()) for _, t, _, _ in rows]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = []
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            at = todo.pop()
            for j in range(len(rows)):
                if j not in seen and near(sets[at], sets[j]):
                    seen.add(j)
                    todo.append(j)
        want.append((i, len(sets[k]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    assert got == sorted(want, key=repr)


def test_links_of_a_large_group_stay_few(spark, monkeypatch):
    """Two thousand near copies, a fifth of whose pairs link: links to be joined are about as many as texts."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(2000):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    seen = []
    real = jaccard_tgm.connected_components
    monkeypatch.setattr(jaccard_tgm, "connected_components", lambda links: seen.append(links.count()) or real(links))
    monkeypatch.setattr(jaccard_tgm, "GROUP", 256)
    got = {r.doc_id: r.component_id for r in jaccard_tgm.near_duplicates(_docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    assert max(seen) <= 2 * len(texts)
    sets = [set(jaccard_tgm.shingles(t).tolist()) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    assert [got[k] for k in range(len(texts))] == [root(k) for k in range(len(texts))]


def _most_joined(spark, since):
    """Rows out of the largest join of classes and groups by shingle, among the executions after the first ``since``; and their number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for k in range(since, runs.size()):
        at = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if "Join" in node.name() and "g_token" in node.desc():
                for metric in (node.metrics().apply(j) for j in range(node.metrics().size())):
                    value = values.get(metric.accumulatorId())
                    if metric.name() == "number of output rows" and value.isDefined():
                        most = max(most, int(value.get().replace(",", "")))
    return most, runs.size()


def _far_copies():
    """Copies of a text with so many changes that few of them link, and the least number of each one's component."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(90)]
    texts = []
    for _ in range(400):
        copy = list(base)
        for at in rng.sample(range(2, 88), rng.randint(2, 6)):
            copy[at] = f"x{rng.randrange(10**6)}" if rng.random() < 0.8 else f"y{at}"
        texts.append(" ".join(copy))
    sets = [set(jaccard_tgm.shingles(t).tolist()) for t in texts]
    want = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if want[a] != want[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((want[a], want[b]))
                want = [low if k == high else k for k in want]
    return texts, want


@pytest.mark.parametrize("stage", [False, True])
def test_copies_too_far_apart_to_link_do_not_meet(spark, monkeypatch, stage):
    """They share the text's common shingles, and must not meet by those, in the operator or in the pipeline's stage."""
    texts, want = _far_copies()
    docs = _docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])
    monkeypatch.setattr(jaccard_tgm, "GROUP", 16)
    _, since = _most_joined(spark, 0)
    rows = (jaccard_tgm.keep_one if stage else jaccard_tgm.near_duplicates)(docs).collect()
    most, _ = _most_joined(spark, since)
    assert 0 < most <= 10 * len(texts)
    assert len(set(want)) > 50
    if stage:
        assert len(rows) == len(set(want)) and {want[r.doc_id] for r in rows} == set(want)
    else:
        assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))


def test_all_pairs_of_linked_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard_tgm, "GROUP", 4)
    texts = _near_copies(5)
    pairs, rows = jaccard_tgm.similar_classes(_docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]))
    of = {r.doc_id: r.cid for r in rows.collect()}
    sets = {of[k]: set(jaccard_tgm.shingles(t).tolist()) for k, t in enumerate(texts) if of[k] is not None}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(want) and want


def test_least_shared_entries(spark):
    rng = random.Random(6)
    rows = [(q, low, low + rng.randint(0, low // 4 + 1)) for q in [*range(1, 90), 333, 2000] for low in {max(1, int(q * f)) for f in (0.75, 0.9, 1.0, 1.2)}]
    got = spark.createDataFrame(rows, "q long, low long, high long").select("*", jaccard_tgm._shared_with(F.col("q"), F.col("low"), F.col("high")).alias("k"))
    for q, low, high, k in got.collect():
        outside = lambda n: -(-75 * n // 100) - max(1, n // 16)
        sizes = [m for m in range(low, high + 1) if 75 * q <= 100 * m and 75 * m <= 100 * q]
        if sizes:
            assert k == min(-(-75 * (q + m) // 175) - max(outside(q), outside(m)) for m in sizes), (q, low, high)


def test_keep_one(spark):
    same = "one two three four five six seven"
    rows = [(4, same, "en", "a"), (2, same.upper(), "en", "b"), (2, same, "en", "b"), (9, "quite another text than that one", "en", "a"), (10, None, None, None), (None, "text without an id, that nobody else has", None, None)]
    table = _docs(spark, rows)
    kept = jaccard_tgm.keep_one(table)
    assert kept.columns == table.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 9, 10, None], key=repr)
    assert jaccard_tgm.keep_one(table.limit(0)).count() == 0


def test_keep_one_tells_rows_apart(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    near = lambda k: text(k).replace("x39", "x40")
    rows = [(5, text(0), "en"), (5, text(1), "en")]  # a repeated id with different texts
    rows += [(3, text(2), "en"), (6, text(3), "en"), (6, near(2), "en")]  # one of them a near copy of another id's
    rows += [(7, text(k), "en") for k in range(10, 20)] + [(7, text(20), "en")] * 9  # a hot id, among it equal rows
    rows += [(None, text(4), "en"), (None, near(4), "de"), (None, text(5), "en"), (9, text(5), "en")]  # copies with null ids
    rows += [(1, None, "en"), (1, None, "en"), (None, " ", "en")]  # no shingles: components of their own
    rows += [(2, text(6), g) for g in ("de", "en", None)]  # rows that differ in another column only
    first, again = (_rows(jaccard_tgm.keep_one(_docs(spark, [(i, t, g, "a") for i, t, g in order]).repartition(n))) for order, n in ((rows, 3), (rows[::-1], 2)))
    assert first == again
    null_id = [r[1] for r in first if r[0] is None and r[1] in (text(4), near(4))]
    assert len(null_id) == 1
    want = [(5, text(0)), (5, text(1)), (3, text(2)), (6, text(3)), *[(7, text(k)) for k in range(10, 21)], (None, *null_id), (9, text(5)), (1, None), (1, None), (None, " "), (2, text(6))]
    assert sorted((r[:2] for r in first), key=repr) == sorted(want, key=repr)


def test_media(spark, docs):
    stored = matroska.store_texts(docs)
    got = _rows(matroska.read_features(stored).select("doc_id", "n_bytes", "payload_sha256", "tail_crc32", "n_packets"))
    want = []
    for i, t, _, _ in ODD:
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((i, len(raw), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(p) // 576))
    assert got == sorted(want, key=repr)
    packets = matroska.packet_table(stored.unionByName(spark.createDataFrame([(99, bytearray(b"junk"), 0), (98, None, 0)], "doc_id long, media binary, n_bytes long")), "doc_id", "media")
    assert packets.where("error is null").count() == sum(w[-1] for w in want) and packets.where("error is not null").count() == 1
    assert matroska.read_features(matroska.store_texts(docs.limit(0))).count() == 0


def test_mixing(spark):
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(0, 60), "en", ("a", "b", "c", "d", None)[min(4, rng.randrange(9))]) for k in range(1500)] + [(7, "w w", "en", "a"), (None, None, None, "e")]
    table = _docs(spark, rows)
    decided, _ = mixing.mix(table)
    got = decided.collect()
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(size.values()))
    while True:  # share, cap, share the excess anew
        level = left / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    target |= {s: level * weight[s] for s in free}
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 60 for s in order)
    mixed = mixing.take(table)
    assert mixed.columns == table.columns and mixed.count() == sum(r.copies for r in got)
    larger = {r.doc_id: r.copies for r in mixing.mix(table, budget=1.2)[0].collect()}
    assert all(larger[r.doc_id] >= r.copies for r in got if r.doc_id != 7)  # thresholds nest
    for none in (table.limit(0), _docs(spark, [(1, None, "en", "a"), (2, "", "en", None)])):
        assert sum(r.copies * r.size for r in mixing.mix(none)[0].collect()) == 0
        assert mixing.take(none).columns == table.columns


def test_mixing_splits_equal_rows(spark):
    # a third of all rows are one row, and hold half of their source's words
    rows = [(k, "w " * (k % 7 + 1), "en", "ab"[k % 2]) for k in range(600)] + [(9999, "hot " * 8, g, "a") for g in ("en", "de", None) for _ in range(100)]
    table = _docs(spark, rows)
    for budget in (0.35, 0.65, 1.0):
        got = mixing.mix(table, budget=budget)[0].collect()
        assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
        for s in "ab":
            mine = [r for r in got if r.source == s]
            assert abs(sum(r.size * r.copies for r in mine) - mine[0].target) <= 8
        taken, again = (_rows(mixing.take(t, budget=budget)) for t in (table, table.repartition(3)))
        assert taken == again and len(taken) == sum(r.copies for r in got)
        assert sum(len(r[1].split()) for r in taken) == sum(r.size * r.copies for r in got)


def test_mixing_takes_nothing_more_often_than_it_may(spark):
    # sources at three times their size, rows without words among them
    rows = [(k, "" if k % 4 == 0 else "w " * (k % 5), "en", "abcdefgh"[k % 8]) for k in range(200)] + [(k, "w " * 500, "en", "z") for k in range(300, 310)]
    table = _docs(spark, rows)
    for budget in (1.0, 2.9, 5.0):
        assert max(r.copies for r in mixing.mix(table, budget=budget)[0].collect()) <= 3
        assert mixing.take(table, budget=budget).groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_ranges_grow_with_the_text(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"word{k} " * 50) for k in range(40)] + [(99, None)], "doc_id long, t string")
    few = jaccard_tgm.ranges_for(rows)
    monkeypatch.setattr(jaccard_tgm, "RANGE_BYTES", 100)
    assert jaccard_tgm.ranges_for(rows) > 100 > few and jaccard_tgm.ranges_for(rows.limit(0)) == few
    named = rows.select("doc_id", F.col("t").alias("a.b"))
    out = jaccard_tgm.near_duplicates(named.withColumnRenamed("doc_id", "x.y"), "x.y", "a.b")  # many ranges, and names with a dot
    assert sorted(r.component_id for r in out.collect()) == [*range(40), 99]


def test_damaged_media_give_error_rows(spark):
    rng = random.Random(12)
    texts = ["", "short", "é" * 3000, "word " * 2000]
    whole = [matroska.mux(matroska.padded(t)[0], lacing) for t in texts for lacing in matroska.LACING]
    files = []
    for k in range(2000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 3)):
            data[rng.randrange(min(300, len(data)))] = rng.randrange(256)
        files.append((k, bytes(data[: rng.randrange(1, len(data))] if rng.random() < 0.2 else data)))
    df = spark.createDataFrame(files + [(5000, None), (5001, b"")], "`a.b` long, m binary")
    rows = matroska.packet_table(df, "a.b", "m").collect()
    damaged = {r["a.b"] for r in rows if r.error}
    assert 200 < len(damaged) < 2001 and 5001 in damaged and 5000 not in {r["a.b"] for r in rows}
    assert all(r.track is None for r in rows if r.error) and all(r.size >= 0 for r in rows if not r.error)


def test_language_sample_of_many_rows():
    for rows in (1, 200, 10**6, 10**10, 10**13):
        below = langid_gru.ranked_below(rows, 200)
        assert 0 < below <= langid_gru.HASHES and below * rows >= min(rows, 800) * langid_gru.HASHES - rows
        assert (below - 1) * rows < 800 * langid_gru.HASHES


def test_language_sample_is_bounded_by_bytes_and_languages(spark):
    rows = [(k, f"text {k} " + "x" * (k % 50), ["en", "de", "es", None][k % 4]) for k in range(400)] + [(1000 + k, "rare", f"l{k}") for k in range(9)] + [(5000, "y" * 5000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, `a.b` string, lang string")
    got = langid_gru.sample_rows(docs, "a.b", "lang", "doc_id", 30, 1 << 20, 3)
    assert {x for x, _ in got} == {"en", "de", "es"} and len(got) == 90
    few = langid_gru.sample_rows(docs, "a.b", "lang", "doc_id", 30, 800, 5)
    by = {x: [t for y, t in few if y == x] for x, _ in few}
    assert set(by) == {"en", "de", "es", "l0", "l1"} and all(sum(map(len, t)) <= 800 for t in by.values())
    assert all([t for y, t in got if y == x][: len(by[x])] == by[x] and len(by[x]) < 30 for x in ("en", "de", "es"))  # the same order, cut by bytes
    repeated = spark.createDataFrame([(1, "same", "en")] * 500 + [(2, "other", "en"), (3, "drei", "de")], "doc_id long, text string, lang string")
    assert sorted(langid_gru.sample_rows(repeated, "text", "lang", "doc_id", 20)) == [("de", "drei"), ("en", "other"), ("en", "same")]


def test_language_spans(spark):
    rng = np.random.default_rng(4)
    words = {"en": ["the", "and", "with", "thing"], "de": ["für", "über", "schön", "straße"]}
    said = lambda g, n: " ".join(rng.choice(words[g], n))
    model = langid_gru.fit([(g, said(g, 60)) for g in ("de", "en") for _ in range(80)])
    texts = [f"{said('en', 120)}.  1234 -- {said('de', 90)}!", said("de", 5), None, "12 34", "", "é", "A" * 3000 + " über " * 200]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "`my.id` long, text string, start int")
    got = {}
    for r in langid_gru.label_spans(df, model, key="my.id").collect():
        got.setdefault(r["my.id"], []).append((r.start, r.end, r.lang, r.score))
    for k, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert k not in got
            continue
        # one byte at a time: its window, its place in it, and the code point that it is part of
        plain, raw = langid_gru.spelled(t), t.encode()
        x, _ = langid_gru.windows(plain)
        prob = langid_gru.positions(model, x)
        labels = [model.langs[int(prob[i // langid_gru.SPAN, langid_gru.CONTEXT + i % langid_gru.SPAN].argmax())] for i, c in enumerate(plain) if c != 32]
        points = [len(raw[:i].decode(errors="ignore")) for i, c in enumerate(raw) if langid_gru._plain[c] != 32]
        runs = []
        for g, p in zip(labels, points):
            if runs and runs[-1][2] == g:
                runs[-1][1] = p + 1
            else:
                runs.append([p, p + 1, g])
        assert [list(s[:3]) for s in sorted(got[k])] == runs
        assert all(0 < s[3] <= 1 for s in got[k])
    first = sum(b - a for a, b, g, _ in got[0] if g == "en" and b <= len(texts[0]) // 2)
    assert first > 0.8 * len(texts[0]) / 2 * 0.9
