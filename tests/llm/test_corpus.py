"""Corpus operators against brute force, round trips and odd inputs."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import chat, decontaminate, gru_lm, langid, line_dedup, mixing, rp_forest, simhash, suffix_dedup, token_output

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    (1, None, "en", "src1"), (2, "", None, None), (3, "... 123", "en", "src2"), (None, "a text without id", None, "src3"), (4, "tie", "en", "src1"), (4, "tie", "en", "src1"),
    (5, "Word wörd ÀÉ Ω end. " * 3000, "fr", "odd source"), (6, "the of and the of and", "en", "src1"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_words", F.lit(1)).withColumn("rid", F.lit("x")).withColumn("score", F.lit(None).cast("string")).withColumn("domain", F.lit(0)).withColumn("row", F.lit(0))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def repeats(texts, window):
    seen = Counter(t[p : p + window] for t in texts for p in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = b"\1" * window
        out.append((len(t), sum(gone), sum(1 for p in range(len(gone)) if gone[p] and (not p or not gone[p - 1])), hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_language_id_held_out(spark, docs, odd):
    rows = docs.withColumn("held", langid.held_out())
    found = langid.predict(rows, langid.train(rows.where("not held"))).where("held").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.97 and all(0 <= r.score <= 1 for r in found)
    got = langid.predict(odd, langid.train(odd)).select("doc_id", "lang_pred").collect()
    assert len(got) == len(ODD) and all(r.lang_pred == "und" for r in got if r.doc_id in (1, 2, 3))
    assert langid.predict(odd.limit(0), langid.train(odd.limit(0))).count() == 0
    code = langid.codewords(9)
    assert len(np.unique(code, axis=0)) == 9


def test_language_id_decoding():
    """Loss-weighted decoding against its definition, pair by pair of rows and codewords."""
    r = np.random.default_rng(1)
    for k in (2, 4, 9):
        model = langid.LanguageModel([f"l{i}" for i in range(k)])
        model.weights, model.bias = r.normal(size=(6, model.code.shape[1])), r.normal(size=model.code.shape[1])
        x = r.normal(size=(20, 6))
        at, p, flag = model.decode(x)
        for i in range(20):
            margin = [sum(x[i][f] * model.weights[f][b] for f in range(6)) + model.bias[b] for b in range(model.code.shape[1])]
            loss = [sum(math.log1p(math.exp(-m * c)) for m, c in zip(margin, row)) for row in model.code]
            share = sorted((math.exp(min(loss) - v) for v in loss), reverse=True)
            assert at[i] == min(range(k), key=loss.__getitem__) and p[i] == pytest.approx(share[0] / sum(share))
            assert flag[i] == ((share[0] - share[1]) / sum(share) < langid.AMBIGUOUS)


def test_suffix_dedup_brute_force(spark, docs, odd):
    for df in (docs.where("doc_id < 120"), odd):
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
        want = sorted((-1 if i is None else i, *x) for (i, _), x in zip(rows, repeats([t for _, t in rows], 200)))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, batches=3).collect())
        assert got == want
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_suffix_family_scans_merged_levels(spark, docs):
    """Seven batches: merged levels are scanned by later batches, and what the family matched is what brute force counts."""
    from loomgraph.llm.common import Scratch

    r = np.random.default_rng(2)
    word = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    shared = [word(230) for _ in range(8)]
    texts = [word(300) + shared[k % 8] * (k % 3 > 0) + word(250) for k in range(42)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "rid long, text string")
    runs, family = suffix_dedup.entries(df, 200, 7).cache(), suffix_dedup.SuffixIndexFamily(Scratch(spark, "family"))
    before: set = set()
    for k in range(7):
        batch = runs.where(F.col("batch") == k).drop("batch")
        own = [(x.head, x.key) for x in batch.collect()]
        want = {x for x in own if own.count(x) > 1 or x in before}
        assert {tuple(x) for x in family.add(batch).collect()} == want
        before |= set(own)
    assert family.scans == [[], [0], [1], [0, 1], [2], [0, 2], [1, 2]] and sorted(family.levels) == [0, 1, 2]
    count, keys = Counter((x.head, x.key, x.run) for x in runs.collect()), Counter((x.head, x.key) for x in runs.collect())
    assert {(x.head, x.key, x.run): x.n for x in family.matches().collect()} == {k: n for k, n in count.items() if keys[k[:2]] > 1}
    order = [x.head for x in spark.createDataFrame([], "head long").collect()]
    data = np.frombuffer(texts[0].encode(), np.uint8)
    head, key, _, s, n = suffix_dedup.piece_entries(data, np.array([0]), np.array([len(data)]), 200)
    raw = [int(x ^ np.uint64(1 << 63)).to_bytes(8, "big") for x in head]
    assert not order and all(b in texts[0].encode() for b in raw) and np.argsort(head.view(np.int64), kind="stable").tolist() == sorted(range(len(raw)), key=lambda i: raw[i])


def test_suffix_dedup_batches_agree(spark, docs):
    some = docs.where("doc_id < 150")
    get = lambda n: sorted(tuple(x) for x in suffix_dedup.remove_repeats(some, batches=n).drop("kept").collect())
    assert get(1) == get(2) == get(6) and suffix_dedup.batches_for(50_000) == 2 and suffix_dedup.batches_for(1 << 30) > 10


def test_suffix_dedup_hot_key_path(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET", 1)
    r = np.random.default_rng(1)
    word = lambda n: bytes(r.integers(97, 123, n).astype(np.uint8)).decode()
    core = word(260)
    rows = [(i, word(150) + core + word(150)) for i in range(40)]
    want = sorted((i, *x) for (i, _), x in zip(rows, repeats([t.encode() for _, t in rows], 200)))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == want


def test_chat_round_trip_and_rewrites(spark):
    said = "\\### Assistant: </turn> ok \\\\ ### a: b"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (2, 0, None, None), (None, None, "a: b", "x"), (3, 0, "user", "")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))).collect()}
    assert chat.parse(got[1].formatted) == [("user", said), ("assistant", said)]
    assert chat.unescape(got[1].formatted[got[1].spans[1].text_start : got[1].spans[1].text_end]) == said
    assert chat.parse(got[2].formatted) == [("", ""), ("", "")] and chat.parse(got[None].formatted) == [("a: b", "x")]
    only_last = lambda turns: "".join("<old>" for _ in turns[:-1]) + (f"[{turns[-1][1]}]" if turns else "")
    assert chat.locate(only_last, [("u", "a"), ("u", "b")])[2] and not chat.locate(chat.template, [("u", "a"), ("u", "b")])[2]


def test_decontamination_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "The of AND"), (2, None), (3, "..."), (4, "wörd"), (1, "The of AND")], "item_id long, text string")
    got = {(r.doc_id, r.text): r for r in decontaminate.contamination(odd, bench).collect()}
    assert got[(6, "the of and the of and")].n_hit == 6 and got[(6, "the of and the of and")]["items"] == ["1"]
    assert got[(1, None)].n_words == 0 and not got[(1, None)].contaminated
    assert got[(5, ODD[6][1])].n_hit == 3000 and got[(5, ODD[6][1])].n_words == 5 * 3000
    assert decontaminate.contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0


def test_decontamination_without_broadcast(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    get = lambda: sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    want = get()
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", 0)
    assert get() == want and sum("n_hit=0" not in x for x in want) > 0


def test_forest_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + r.normal(size=16) * 0.12]) for i in range(400)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, []), (1004, [1.0]), (1005, rows[0][1]), (1005, rows[0][1])]
    got = rp_forest.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.array([v for i, v in rows if i < 400 or i == 1005])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = int((x @ x.T >= 0.9).sum()) - len(x)
    assert len(got) == len(rows) and sum(g.n_links for g in got) >= 0.9 * want
    assert sum(g.n_links for g in got) <= want and all(g.n_links == 0 and g.kept for g in got if 1000 <= g.vec_id < 1005)
    assert rp_forest.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_forest_meets_pairs_of_a_hot_cluster():
    r, n = np.random.default_rng(4), 20000
    x, center = r.normal(size=(n, 64)), r.normal(size=64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[: n // 3] = center / np.linalg.norm(center) + x[: n // 3] * 0.27  # mean cosine 0.93
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    forest = rp_forest.Forest(x, 8, rp_forest.TREES, rp_forest.SPILL)
    some = np.concatenate([r.choice(n // 3, 400, False), r.choice(np.arange(n // 3, n), 100, False)])
    row, code = forest.leaves(x[some])
    member = np.zeros((len(some), forest.trees << 8), np.float32)
    member[row, code] = 1
    linked = (x[some] @ x[some].T >= 0.9) & ~np.eye(len(some), dtype=bool)
    assert linked.sum() > 10000 and ((member @ member.T > 0) & linked).sum() >= 0.97 * linked.sum()


def slow_log10(model, symbols):
    """The network's definition, one symbol at a time, in double precision."""
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    k, h, last, total = model.hidden, np.zeros(model.hidden), 0, 0.0
    for s in symbols:
        x = p["x"][last]
        z, r = (1 / (1 + np.exp(-(x[i * k : (i + 1) * k] + p["u"][i * k : (i + 1) * k] @ h))) for i in (0, 1))
        c = np.tanh(x[2 * k :] + p["u"][2 * k :] @ (r * h))
        h = (1 - z) * h + z * c
        kind = int(np.searchsorted(model.bounds, s, "right")) - 1
        a, b = model.bounds[kind], model.bounds[kind + 1]
        for y, i in ((p["c"] @ h + p["cb"][:, 0], kind), (p["w"][a:b] @ h + p["wb"][a:b, 0], s - a)):
            total += y[i] - np.log(np.exp(y).sum())
        last = s
    return total / np.log(10)


def brute_counts(rows):
    tokens = [[*(t or "").encode().lower().split(), 0] for _, t in rows]
    train = Counter(w for (i, _), t in zip(rows, tokens) if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(train.values()), len(train)
    return n, [(len(t), sum(train[w] > 0 for w in t), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in t)) for t in tokens]


@pytest.mark.parametrize("frequent", [gru_lm.FREQUENT, 1600])
def test_gru_counts_and_scores(spark, docs, odd, frequent, monkeypatch):
    models = []
    fit = gru_lm.fit
    monkeypatch.setattr(gru_lm, "fit", lambda *a: models.append((fit(*a), *a[2:4])) or models[-1][0])
    table = docs.select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id: r for r in gru_lm.score_documents(table, frequent=frequent).collect()}
    n, want = brute_counts(rows)
    for (i, _), (size, sure, base) in zip(rows, want):
        assert (got[i].train_tokens, got[i].n_tokens, got[i].n_known) == (n, size, sure) and got[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
    # The score: the network symbol by symbol, and rare words by their share of all rare words.
    (model, _), known, places = models[0]
    train = [w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in gru_lm.word_hashes(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0].tolist()]
    c = Counter(train)
    rare = {w: m for w, m in c.items() if w not in set(known.tolist())}
    for i, t in rows[:25]:
        raw = (t or "").encode()
        words = gru_lm.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        symbols = [*gru_lm._symbols(words, known, places).tolist(), 0]
        more = sum(math.log10((c[w] + 1) / (sum(rare.values()) + len(rare) + 1)) for w, s in zip(words.tolist(), symbols) if s == 1)
        assert got[i].score == pytest.approx(slow_log10(model, symbols) + more, rel=1e-4)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gru_odd_rows(spark, odd):
    got = gru_lm.score_documents(odd).collect()
    n, want = brute_counts([(x[0], x[1]) for x in ODD])
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == sorted((a, b, round(c, 6)) for a, b, c in want) and {r.train_tokens for r in got} == {n}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert gru_lm.score_documents(odd.limit(0)).count() == 0
    only = gru_lm.score_documents(odd.where("doc_id = 2")).collect()  # one row, an end alone
    assert len(only) == 1 and only[0].n_tokens == 1


def test_gru_gradient():
    r = np.random.default_rng(0)
    model = gru_lm.GatedLM(np.arange(13, 0, -1), hidden=5, seed=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    source, target, h = r.integers(0, 13, (6, 4)), r.integers(0, 13, (6, 4)), r.normal(size=(5, 4))
    _, _, g, rows = model.gradient(source, target, h)
    for name, value in model.p.items():
        full = np.zeros_like(value)
        full[rows.get(name, slice(None))] = g[name]
        for at in r.integers(0, value.size, 25):
            place, losses = np.unravel_index(at, value.shape), []
            for e in (1e-5, -2e-5):
                value[place] += e
                losses.append(model.gradient(source, target, h)[1])
            value[place] += 1e-5
            assert full[place] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_gru_learns():
    model = gru_lm.GatedLM(np.ones(12), hidden=5, seed=3)
    texts = [np.append(np.tile([2, 3, 4, 5], 5), 0) for _ in range(60)]
    before = model.log10s(texts[0], np.array([21]))[0]
    model.train(texts, lanes=4, epochs=6)
    assert model.log10s(texts[0], np.array([21]))[0] > before / 3
    several = [texts[0][-7:], np.array([0]), texts[0], np.array([3, 0])]
    together = model.log10s(np.concatenate(several), np.array([7, 1, 21, 2]))
    assert together == pytest.approx([slow_log10(model, x) for x in several], rel=1e-4)


def test_gru_learns_from_every_document(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARE", 1000)
    rows = [(i, "a b c d" if i % 2 else "b a d c") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    abcd = np.frombuffer(b"a b c d", np.uint8), np.array([0, 7])
    known, mass = np.sort(gru_lm.word_hashes(*abcd)[0]), np.array([3000, 0, 3000, 3000, 3000, 3000])
    model, sizes = gru_lm.fit(table, 15000, known, np.arange(4), mass)
    assert sizes == [15000] * gru_lm.ROUNDS  # few tokens: every document in every round
    monkeypatch.setattr(gru_lm, "FEW", 1)
    model, sizes = gru_lm.fit(table, 15000, known, np.arange(4), mass)
    assert len(sizes) == gru_lm.ROUNDS and min(sizes) > 0 and sum(sizes) == 15000
    seen, odd = gru_lm._symbols(gru_lm.word_hashes(*abcd)[0], known, np.arange(4)), np.array([2, 2, 2, 2])
    assert model.log10s(np.append(seen, 0), np.array([5]))[0] > model.log10s(np.append(odd, 0), np.array([5]))[0]


def test_line_dedup_near_threshold(spark):
    pages = [(s * 10 + k, f"http://h{s}.org/", f"<p>seen {k}</p><p>own {s} {k}</p>") for s in range(12) for k in range(3) if s < 12 - k] + [(900, None, "<p>seen 0</p>"), (901, "http://h1.org", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("lines", F.lit(0))
    got = {r.page_id: r for r in line_dedup.remove_boilerplate(df, line_dedup.page_text(F.col("html")), line_dedup.site_of(F.col("url")), min_sites=11).collect()}
    assert got[0].n_removed == 1 and got[1].n_removed == 1 and got[2].n_removed == 0 and got[900].n_removed == 1 and got[901].n_removed == 0


def test_token_files(spark, docs, odd):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(TOKENIZER), 0
    got = {r.doc_id: r for r in token_output.token_output(docs, TOKENIZER).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    back = token_output.token_output(odd, TOKENIZER).orderBy("start").collect()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t, *_ in order]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in back] == [(i, len(x), zlib.crc32(x.tobytes())) for (i, *_), x in zip(order, want)]
    assert [r.start for r in back] == [sum(len(x) for x in want[:k]) for k in range(len(want))]
    with pytest.raises(ValueError):
        token_output.token_output(odd, public_tokenizers.path("byte_bpe_50k.json"))  # its ids hold white space
    assert token_output.token_output(odd.limit(0), TOKENIZER).count() == 0


def test_coder_round_trip_and_damage():
    r = np.random.default_rng(4)
    sizes = np.array([1, 5000, 1, 300, 2048])
    ids = np.concatenate([r.integers(0, 65536, 3000), np.tile(r.integers(0, 50, 43), 102)[: sizes.sum() - 3000]])
    ((n, segment),) = token_output.pack(np.arange(5), sizes, ids)
    ((doc_ids, counts, back),) = token_output.unpack([segment])
    assert n == len(ids) and back.tolist() == ids.tolist() and counts.tolist() == sizes.tolist() and doc_ids.tolist() == list(range(5))
    broken = bytearray(segment)
    broken[-40] ^= 1
    with pytest.raises(ValueError):
        token_output.unpack([bytes(broken)])


WORDS = ["Word.", "word", "WORD,", "don't", "don't!", "É!", "été", "l'été...", "Straße,", "ÀÖ", "x²", "naïve)", "á.", "İstanbul.", "ﬁne!", "слово.", "<|endoftext|>", "w<|endoftext|>", "end<|", "'s", "it's.", "A'"]
WORDS += ["º", "µm.", "×", "12.", "a1.", "..", "\x00", "a\x00.", "中文。", "ǅ.", "a\xa0b.", "a…", "\x1c.", "ſ.", "ė!", "ΣΑΣ.", "가.", "a\u0301."]


def test_token_ids_of_words_and_marks():
    """A word is encoded once whatever its case and the marks behind it; ids of odd words are those of the library."""
    from tokenizers import Tokenizer

    tokenizer, r = Tokenizer.from_file(TOKENIZER), np.random.default_rng(8)
    known = token_output.Pieces(tokenizer)
    token_output.token_ids(pa.array(["Word, word. WORD\tword", None, "Über ÜBER. über,"]), known)
    assert set(known.known.to_pylist()) - {""} == {",", ".", "word", "über"}
    texts = [" ".join(r.choice(WORDS, 30)) for _ in range(500)] + WORDS + ["", " "]
    assert token_output.splits_words(tokenizer) and not token_output.splits_words(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    sizes, ids = token_output.token_ids(pa.array(texts), known)
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_coder_costs_and_sizes():
    """Two million ids take less than a microsecond each to write and read (1.75 before segments had counts), and little more room than their entropy."""
    import time

    r = np.random.default_rng(9)
    p = 1 / np.arange(1, 2201)
    ids = r.choice(49_000, 2200, replace=False)[r.choice(2200, 2_000_000, p=p / p.sum())]
    sizes = np.full(2000, 1000)

    def slowness():  # of the machine just now, as the check tool takes it
        t = time.thread_time()
        sum(range(50_000))
        return (time.thread_time() - t) * 1000

    slow, began = max(1, np.median([slowness() for _ in range(21)])), time.process_time()
    segments = token_output.pack(np.arange(2000), sizes, ids)
    back = token_output.unpack([s for _, s in segments])
    took = (time.process_time() - began) / slow
    assert np.array_equal(np.concatenate([x for _, _, x in back]), ids)
    assert took < 1.4
    assert sum(len(s) for _, s in segments) < 1.06 * len(ids) * -(p / p.sum() * np.log2(p / p.sum())).sum() / 8


def test_coder_blocks_are_independent_and_odd_ids_come_back():
    r = np.random.default_rng(10)
    shares = [token_output._shares(np.arange(1, 301)), token_output._shares(np.ones(7, np.int64))]
    blocks, owner = [r.integers(0, n, size).astype(np.uint16) for n, size in ((300, 1024), (7, 90), (300, 1), (7, 1024))], np.array([0, 1, 0, 1])
    together = token_output.encode_blocks(blocks, token_output._Order0(shares, owner))
    for k, b in enumerate(blocks):
        alone = token_output._Order0([shares[owner[k]]], np.array([0]))
        assert np.array_equal(token_output.encode_blocks([b], alone)[0], together[k])
        assert np.array_equal(token_output.decode_blocks([together[k]], np.array([len(b)]), alone)[0], b)
    for ids in (np.arange(65536), np.zeros(5000, int), np.tile([7, 8, 9], 3000), np.array([65535]), np.concatenate([np.zeros(100_000, int), np.arange(65536)[::-1]])):
        ((_, segment),) = token_output.pack(np.array([5]), np.array([len(ids)]), ids)
        assert np.array_equal(token_output.unpack([segment])[0][2], ids)


def test_simhash_brute_force(spark, docs, odd):
    for df in (docs, odd):
        marks = {}
        for r in df.collect():
            w = (r.text or "").encode().lower().split()
            s = [b" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
            h = [xxhash.xxh64_intdigest(x, 42) for x in s]
            marks[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        root = {i: i for i in marks if i is not None}
        changed = True
        while changed:
            changed = False
            for a in root:
                for b in root:
                    if root[a] > root[b] and (marks[a] ^ marks[b]).bit_count() <= 3:
                        root[a], changed = root[b], True
        got = simhash.simhash_groups(df).collect()
        assert len(got) == df.count()
        assert all(g.fingerprint == f"{marks[g.doc_id]:016x}" for g in got) and all(g.component_id == root[g.doc_id] for g in got if g.doc_id is not None)
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_trie_pairs_are_all_pairs():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 50, np.uint64)
    near = base[r.integers(0, 50, 400)] ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
    a = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if int(a[i] ^ a[j]).bit_count() <= 3}
    assert {(int(i), int(j)) for x, y in simhash.near_pairs(a, None, 0, 3) for i, j in zip(x, y)} == want


def test_mixing_odd_rows(spark, odd):
    got = mixing.mix(odd, share=1.0, epochs=1).collect()
    assert {r.doc_id for r in got} >= {3, 5, 6} and not {1, 2} & {r.doc_id for r in got}
    assert mixing.mix(odd.limit(0)).count() == 0
    twice = mixing.mix(odd, share=2.0, epochs=2)
    assert twice.where("epoch = 1").count() >= 5


def jaccard(a, b, k=5):
    words = [(t or "").encode().lower().split() for t in (a, b)]
    x, y = ({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set() for w in words)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_pipeline_stages(spark):
    """Each stage's decisions on its own input, row by row."""
    import corpus_pipeline as pipeline

    docs, steps = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), stage(spark, docs.limit(0), DATA).schema)
        steps.append((name, before, docs.collect()))
        assert name == "token_output" or docs.columns == pipeline.COLUMNS
    (_, all_, said), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, tokens) = steps
    assert {r.doc_id for r in all_} - {r.doc_id for r in said} <= {r.doc_id for r in all_ if not any(c.isalpha() for c in r.text or "")} | {r.doc_id for r in all_ if r.lang is None or len((r.text or "").split()) < 4}
    text = {r.doc_id: r.text for r in said}
    kept = sorted(r.doc_id for r in single)
    for gone in set(text) - set(kept):
        assert max(jaccard(text[gone], text[i]) for i in text if i != gone) >= 0.7
    exact: dict = {}
    for i in sorted(text):
        exact.setdefault(" ".join(text[i].lower().split()), i)
    assert set(kept) <= set(exact.values())
    bench = [[w for w in "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in r.text or "").split()] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in bench if w for i in range(max(len(w) - 12, 1))}
    for r in single:
        w = "".join(c.lower() if c.isascii() and c.isupper() else c if not c.isascii() or c.isalnum() else " " for c in r.text or "").split()
        hit = set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        assert (r.doc_id in {x.doc_id for x in clean}) == (not hit or 20 * len(hit) < len(w))
    total = sum(len((r.text or "").split()) for r in clean)
    taken = sum(len((r.text or "").split()) for r in mixed)
    assert 0.4 * total < taken and {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and max(Counter(r.doc_id for r in mixed).values()) <= 2
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)


def test_pipeline_odd_rows(spark, odd):
    import corpus_pipeline as pipeline

    clash = odd.withColumn("n_chars", F.lit(3).cast("long"))
    for _, stage in pipeline.STAGES:
        stage(spark, clash, DATA).collect()
        assert stage(spark, clash.limit(0), DATA).count() == 0
