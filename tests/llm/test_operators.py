"""Edge cases of every operator, and brute force on small tables."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from planwalk.llm import bytetext, chat, decontaminate, encoder, jaccard_join, lang_id, media, mixing, prefix, quality, skew, store, suffix_tree, token_counts, token_store

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ODD = [None, "", " ", "a", "É", "漢字 テスト", "x" * 50_000, "the end " * 30_000, "a <|endoftext|> b.<|endoftext|>!", "don't  stop\n\n 'til\tyou're  done ", "two hard spaces   here", "1 + 1 = 2!", "\x00 nul \x1f"]


def fold(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def docs(spark, texts, **more):
    rows = [(k, x, *(v[k] for v in more.values())) for k, x in enumerate(texts)]
    kinds = ", ".join(f"{k} string" for k in more)
    return spark.createDataFrame(rows, "doc_id long, text string" + (f", {kinds}" if kinds else "")).repartition(3)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "er", "the", "on", "in", "st", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(n)]


@pytest.mark.parametrize("pattern,table", [(SPACED, bytetext.SPACED), (ALNUM, bytetext.ALNUM)])
def test_words_are_those_of_the_pattern(pattern, table, monkeypatch):
    monkeypatch.setattr(bytetext, "PIECE", 64)
    texts = ODD + prose(1, 20)
    data, bounds = bytetext.buffers(pa.array(texts, pa.string()))
    start, end, hashes, rows = bytetext.words(data, bounds, table)
    folded = bytetext.FOLD_BYTES[data].tobytes()
    seen = {}
    for k, x in enumerate(texts):
        want = re.findall(pattern, fold(x))
        got = [folded[a:b].decode() for a, b in zip(start[rows[k] : rows[k + 1]], end[rows[k] : rows[k + 1]])]
        assert got == want
        for w, h in zip(got, hashes[rows[k] : rows[k + 1]].tolist()):
            assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(seen.values()))


def test_encoder_agrees_with_the_library():
    from tokenizers import Tokenizer

    texts = [x or "" for x in ODD] + prose(2, 100)
    want = [x.ids for x in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    data, bounds = bytetext.buffers(pa.array(texts))
    for limit in (1 << 20, 100, 3000):
        coder = encoder.PieceEncoder(BPE, True)
        got = []
        for low, high, lens, ids in coder.encode_groups(data, bounds, limit):
            got += [x.tolist() for x in np.split(ids, np.cumsum(lens)[:-1])]
        assert got == want


def test_token_counts(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(BPE)
    df = docs(spark, ODD, n_tokens=["clash"] * len(ODD))
    rows = {r.doc_id: r for r in token_counts.count_tokens(df.unionByName(df), BPE, batch_bytes=1000).collect()}
    assert len(rows) == len(ODD)
    for k, x in enumerate(ODD):
        n = len(coder.encode(x or "", add_special_tokens=False).ids)
        assert (rows[k].n_bytes, rows[k].n_tokens, rows[k].over_limit) == (len((x or "").encode()), n, n > 512)
    assert token_counts.count_tokens(df.limit(0), BPE).count() == 0


def test_token_counts_of_other_files(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello there, world", "", None, "ünï  codé"]
    piece, word = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), piece).collect()}
    coder = sentencepiece.SentencePieceProcessor(model_file=piece)
    assert got == {k: len(coder.encode(x or "")) for k, x in enumerate(texts)}
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(spark, texts), word).collect()}
    coder = Tokenizer.from_file(word)
    assert got == {k: len(coder.encode(x or "", add_special_tokens=False).ids) for k, x in enumerate(texts)}


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(BPE)
    texts = ODD + prose(3, 40) + [" ".join(prose(4, 300))] * 3
    path = store.new_path(spark, "t")
    token_store.write_store(docs(spark, texts, start=["clash"] * len(texts)), path, BPE)
    want = [[*coder.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    read = {r.doc_id: (r.start, r.ids) for r in token_store.read_documents(spark, path).collect()}
    facts = {r.doc_id: r for r in token_store.verify_store(spark, path).collect()}
    at = 0
    for k, ids in enumerate(want):
        assert read[k] == (at, ids)
        assert (facts[k].start, facts[k].n_tokens, facts[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.count() < spark.read.parquet(f"{path}/recipes").selectExpr("explode(chunks)").count()


def test_token_store_of_nothing_and_of_repeated_ids(spark):
    path = store.new_path(spark, "t")
    token_store.write_store(docs(spark, ["a"]).limit(0), path, BPE)
    assert token_store.verify_store(spark, path).count() == 0
    path = store.new_path(spark, "t")
    token_store.write_store(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (0, None)], "doc_id long, text string"), path, BPE)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_store.verify_store(spark, path).collect())
    assert rows == [(0, None, 2), (2, 0, 1), (3, 1, 3), (6, 1, 3)]


def test_token_store_notices_damage(spark, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 4)
    path = store.new_path(spark, "t")
    root = token_store.write_store(docs(spark, prose(5, 9)), path, BPE)
    tables = {x: spark.read.parquet(f"{path}/{x}") for x in ("chunks", "recipes", "manifest")}
    assert tables["manifest"].agg({"level": "max"}).first()[0] == 1
    assert token_store.verify_store(spark, path, root).count() == 9

    def refused(asked=None, **changed):
        bad = store.new_path(spark, "t")
        for name, table in tables.items():
            changed.get(name, table).coalesce(1).write.parquet(f"{bad}/{name}")
        with pytest.raises(Exception, match="damaged|missing|agree|chunks|asked"):
            token_store.verify_store(spark, bad, asked).collect()

    recipes, manifest = tables["recipes"], tables["manifest"]
    refused(chunks=tables["chunks"].selectExpr("digest", "width", "unhex('0100') AS ids"))
    refused(chunks=tables["chunks"].limit(3))
    for column, value in (("doc_id", "doc_id + 100"), ("start", "start * 2"), ("n_tokens", "n_tokens + 1"), ("root", "unhex('00')"), ("number", "8 - number"), ("chunks", "reverse(array_repeat(chunks[0], 2))")):
        refused(recipes=recipes.selectExpr(*(f"{value} AS {column}" if c == column else c for c in recipes.columns)))
    refused(recipes=recipes.where("number <> 8"))
    refused(recipes=recipes.where("number >= 4"), manifest=manifest.where("NOT (level = 0 AND node = 0)"))
    refused(manifest=manifest.where("NOT (level = 0 AND node = 0)"))
    refused(manifest=manifest.selectExpr("level", "node", "n_docs", "n_tokens", "unhex('00') AS root"))
    refused(manifest=manifest.unionByName(manifest.selectExpr("level", "node + 7 AS node", "n_docs", "n_tokens", "root")))
    refused(asked=b"another")
    refused(asked=root, recipes=recipes.limit(0), manifest=manifest.limit(0))


def test_split_join_is_the_plain_join(spark):
    many = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 20}") for k in range(300)] + [(300, None)], "id long, key string")
    one = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("other", 4)], "key string, v int")
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(one, "key", how).select("id", "key", "v").collect()))
        assert sorted(map(tuple, skew.split_join(many, one, "key", ["id"], how, piece=7).select("id", "key", "v").collect())) == want


def test_language(spark):
    texts = ["the house and the tree"] * 30 + ["la maison et le chat été"] * 30 + [None, "", "123 !", "THE TREE", "x"]
    langs = ["en"] * 30 + ["fr"] * 30 + [None] * 5
    df = docs(spark, texts, lang=langs, score=["clash"] * 65)
    model = lang_id.train(df)
    rows = {r.doc_id: r for r in lang_id.predict(df, model).collect()}
    assert all(rows[k].lang_pred == langs[k] for k in range(60))
    assert [rows[k].lang_pred for k in (60, 61, 62)] == ["und"] * 3 and rows[60].score == 0
    assert rows[63].lang_pred == "en" and 0 <= rows[63].score <= 1
    kept = lang_id.accept(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= set(range(60))
    nothing = lang_id.train(df.limit(0))
    assert {r.lang_pred for r in lang_id.predict(df, nothing).collect()} == {"und"}
    assert lang_id.predict(df.limit(0), model).count() == 0


def test_language_scores_are_those_of_plain_bayes():
    texts = ["abc abd", "Ünder 7 x", "zz"]
    data, bounds = bytetext.buffers(pa.array(texts))
    symbols, rows, found = lang_id.letters(data, bounds)
    assert found.tolist() == [6, 6, 2]
    buckets, owner = lang_id.grams(symbols, rows)
    one = lang_id.grams(*lang_id.letters(*bytetext.buffers(pa.array([texts[1]])))[:2])[0]
    assert sorted(buckets[owner == 1].tolist()) == sorted(one.tolist())


def plain_grams(text):
    """Buckets of a text's n-grams, one by one."""
    symbols = [0]
    for x in text:
        if x.isalpha():
            symbols.append(ord(x.lower()) if len(x.lower()) == 1 else ord(x))
        elif symbols[-1]:
            symbols.append(0)
    out = []
    for size in lang_id.SIZES:
        for k in range(len(symbols) - size + 1):
            gram = symbols[k : k + size]
            if any(gram):
                h = 0
                for x in gram:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ x
                h = h * (2 * size + 1) & 0xFFFFFFFF
                h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                out.append((h ^ h >> 13) & (lang_id.BUCKETS - 1))
    return out


def test_language_scores_are_those_of_counts_by_hand(spark):
    texts = [*prose(61, 12), *(x.upper() + " été" for x in prose(62, 9)), "Ñandú 7 ñ", None, "", "42"]
    langs = ["aa"] * 12 + ["bb"] * 9 + ["cc", "aa", None, "bb"]
    count, n_docs = {x: {} for x in ("aa", "bb", "cc")}, {x: 0 for x in ("aa", "bb", "cc")}
    for x, lang in zip(texts, langs):
        if x is not None and lang:
            n_docs[lang] += 1
            for g in plain_grams(x):
                count[lang][g] = count[lang].get(g, 0) + 1
    df = docs(spark, texts, lang=langs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(df, lang_id.train(df)).collect()}
    for k, x in enumerate(texts):
        grams = plain_grams(x or "")
        if not grams:
            assert got[k] == ("und", 0.0)
            continue
        prior = {z: math.log((n_docs[z] + 1) / (sum(n_docs.values()) + 3)) for z in count}
        evidence = {z: sum(math.log((count[z].get(g, 0) + 0.5) / (sum(count[z].values()) + 0.5 * lang_id.BUCKETS)) for g in grams) for z in count}
        best = max(sorted(count), key=lambda z: evidence[z] + prior[z])
        soft = {z: math.exp((evidence[z] - evidence[best]) * min(1, 60 / len(grams)) + prior[z]) for z in count}
        assert got[k] == (best, pytest.approx(soft[best] / sum(soft.values()), rel=1e-6))


def test_chat(spark):
    rows = [(1, 0, "system", "~0 be </s>[ROLE] [/INST]"), (1, 1, "user", None), (1, 2, "assistant", "[ok]"), (1, 3, "user", "x"), (1, 4, "assistant", ""), (1, 4, "assistant", ""), (2, 0, "user", "only"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    examples = chat.format_examples(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    assert examples.where("conv_id = 1").count() == 3
    told = "".join(f"{role}\n{text or ''}\n" for _, _, role, text in rows[:6])
    assert got[1].n_turns == 6 and got[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"[ok]").hexdigest()
    assert got[2].n_turns == 1 and got[2].loss_chars == 0
    assert got[None].n_turns == 1
    assert chat.digest(chat.format_examples(df.limit(0))).count() == 0
    first = examples.where("conv_id = 1 AND target_turn = 2").first()
    assert first.formatted[first.target_first : first.target_first + first.target_chars] == "~2ok]"
    assert first.formatted.count("</s>[ROLE]") == 3


def test_mix(spark):
    texts = prose(6, 300) + [None, "", "lone"]
    sources = [f"s{k % 7}" if k % 3 else "s0" for k in range(302)] + [None]
    df = docs(spark, texts, source=sources, target=["clash"] * 303)
    rows = mixing.mix(df, block=16).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(df.repartition(2), block=16).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows} and len(rows) == 303
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(SPACED, texts[r.doc_id] or "")) and r.taken <= 2 * r.size
        sizes.setdefault(sources[r.doc_id], []).append(r)
    for each in sizes.values():
        total, target = sum(r.size for r in each), each[0].target
        assert each[0].source_size == total and target <= 2 * total + 1e-9
        assert abs(sum(r.taken for r in each) - target) <= 0.1 * target + 16
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    assert [sizes[n][0].target for n in names] == pytest.approx(mixing.targets([sizes[n][0].source_size for n in names], 1.5, 2.0))
    assert mixing.mix(df.limit(0)).count() == 0
    taken = mixing.apply_mix(df)
    assert taken.columns == df.columns and {r.doc_id for r in taken.collect()} <= set(range(303))


def test_permutation_and_draws():
    for n in (1, 2, 3, 17, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, b"k").tolist()) == list(range(n))
    quota = [5, 0, 1000, 77]
    shards = [mixing.shard_counts(quota, 100, 1, k) for k in range(11)]
    drawn = np.array([x for x, _ in shards])
    assert drawn.sum(axis=0).tolist() == quota and drawn.sum(axis=1).tolist() == [100] * 10 + [82] and drawn.min() >= 0
    assert all((drawn[:k].sum(axis=0) == before).all() for k, (_, before) in enumerate(shards))
    other = np.array([mixing.shard_counts(quota, 100, 2, k)[0] for k in range(11)])
    assert (other != drawn).any()
    many = np.array([mixing.shard_counts([6000, 3000, 1000], 100, 3, k)[0] for k in range(100)])
    assert many.std(axis=0) == pytest.approx([(100 * p * (1 - p)) ** 0.5 for p in (0.6, 0.3, 0.1)], rel=0.35)


def test_running_sum(spark):
    df = store.keep(spark.range(100).selectExpr("100 - id AS k", "id % 7 AS v"), "t")
    total = 0
    for r in sorted(prefix.running_sum(df, ["k"], "v", "before", "t").collect(), key=lambda r: r.k):
        assert r.before == total
        total += r.v


def test_quality(spark):
    good, bad = prose(7, 150), [x.upper().replace(" ", "!! ") for x in prose(8, 150)]
    texts = good + bad + [None, "", "z" * 300_000]
    df = docs(spark, texts, score=["clash"] * 303)
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(0, 300, 2)] + [(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(df, labels)
    rows = {r.doc_id: r for r in quality.predict(df, model).collect()}
    assert len(rows) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    right = sum((rows[k].score > 0.5) == (k < 150) for k in range(1, 300, 2))
    assert right >= 147
    assert rows[300].score == rows[301].score
    assert quality.predict(df.limit(0), model).count() == 0
    blank = quality.train(df, labels.limit(0))
    assert {r.score for r in quality.predict(df, blank).collect()} == {0.5}


def plain_passages(text):
    """A text's passages as strings of bytes, with their words."""
    raw = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    many = max(1, (len(spans) + 32) // 64)
    firsts = [k * len(spans) // many for k in range(many)] + [len(spans)]
    starts = [0, *(spans[k][0] for k in firsts[1:-1]), len(raw)]
    return [(raw[a:b], [raw[x:y] for x, y in spans[p:q]]) for a, b, p, q in zip(starts, starts[1:], firsts, firsts[1:])]


def plain_features(passage, words):
    classes, pairs = np.zeros(quality.CLASSES), np.zeros(quality.PAIRS)
    for x in passage:
        classes[quality._classes[x]] += 1
    for a, b in zip(passage, passage[1:]):
        pairs[((a * 0x9E37 + b * 0x79B9) >> 5) % quality.PAIRS] += 1
    n, size = max(len(words), 1), max(len(passage), 1)
    stats = [len(set(words)) / n, sum(map(len, words)) / n / 10, sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 12 for w in words) / n, sum(6 <= quality._classes[w[-1]] <= 9 for w in words) / n, min(len(words), 64) / 64]
    return np.concatenate([classes / size, stats, 4 * np.sqrt(pairs / size)]).astype(np.float32)


def test_quality_scores_are_those_of_each_text_alone(spark, monkeypatch):
    texts = [*ODD[:7], *prose(31, 40), "ab " * 150_000 + "é" * 400_000, *ODD[7:], *prose(31, 5), ""]
    rng = np.random.default_rng(3)
    sizes = {"W": (quality.FEATURES, 4), "b": 4, "V": (4, 3), "U": (4, 3), "w": 3, "c": 4, "d": 1}
    model = quality.Model(rng.normal(0, 0.1, quality.FEATURES), rng.uniform(1, 3, quality.FEATURES), {k: rng.normal(0, 1, v) for k, v in sizes.items()})

    def plain(text):
        p, e, h = model.parts, [], []
        for passage, words in plain_passages(text):
            h.append(np.tanh((plain_features(passage, words) - model.mean) * model.scale @ p["W"] + p["b"]))
            e.append((np.tanh(h[-1] @ p["V"]) / (1 + np.exp(-(h[-1] @ p["U"])))) @ p["w"])
        a = np.exp(np.array(e) - max(e))
        return 1 / (1 + np.exp(-((a / a.sum()) @ np.array(h) @ p["c"] + p["d"][0])))

    df = docs(spark, texts)
    got = {r.doc_id: r.score for r in quality.predict(df, model).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx([plain(x) for x in texts], abs=2e-6)
    for other in (df.orderBy("doc_id").coalesce(1), df.orderBy(df.doc_id.desc()).coalesce(1), df.repartition(40)):
        assert {r.doc_id: r.score for r in quality.predict(other, model).collect()} == got
    seen = {}
    assert all(seen.setdefault(x or "", got[k]) == got[k] for k, x in enumerate(texts))
    monkeypatch.setattr(bytetext, "PIECE", 1000)
    assert {r.doc_id: r.score for r in quality.predict(df, model).collect()} == got


def test_quality_sample_is_bounded_by_rows_and_passages(spark, monkeypatch):
    held = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: held.append([len(x) for x in bags]))
    df = docs(spark, ["word " * (64 * k) for k in (1, 2, 3, 50)] * 5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    for most, passages in ((100, 1000), (6, 1000), (100, 40), (0, 10)):
        quality.train(df, labels, sample=most, sample_passages=passages)
        assert len(held[-1]) <= most and sum(held[-1]) <= passages
    assert sorted(held[0]) == sorted([1, 2, 3, 50] * 5) and held[2] and 50 not in held[2]


def test_quality_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(6, quality.FEATURES)), np.array([0, 2, 6]), np.array([1.0, 0.0])
    p = {"W": rng.normal(0, 0.1, (quality.FEATURES, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": rng.normal(size=1)}
    loss = lambda p: np.mean(np.log1p(np.exp(-(2 * y - 1) * quality._forward(p, x, first)["logit"])))
    grads = quality._gradients(p, x, first, y, np.ones(2))
    for k, v in p.items():
        place = tuple(0 for _ in v.shape)
        up, down = {a: b.copy() for a, b in p.items()}, {a: b.copy() for a, b in p.items()}
        up[k][place] += 1e-5
        down[k][place] -= 1e-5
        assert grads[k][place] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def plain_png(payload):
    """The stored form, written by the format's description."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    rows = b"".join(b"\0" + payload[k : k + 64] for k in range(0, len(payload), 64))
    header = (64).to_bytes(4, "big") + (len(payload) // 64).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def test_media(spark):
    texts = ODD + ["a", "one\ntwo <b> & three\n\nfour", "é" * 40_000 + "\n" + "q" * 131_072]
    rows = {r.doc_id: r for r in media.text_media(docs(spark, texts, feature=["clash"] * len(texts))).collect()}
    assert len(rows) == len(texts)
    for k, x in enumerate(texts):
        raw = (x or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        form = b"".join(plain_png(payload[at : at + 65_536]) for at in range(0, len(payload), 65_536))
        parts = [sum(v >> 5 == j for v in payload) * 1000 // len(payload) for j in range(8)]
        feature = f"rows={len(payload) // 64};mean={sum(payload) * 1000 // len(payload)};hist={'/'.join(map(str, parts))}"
        assert tuple(rows[k])[1:] == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature)
    assert media.text_media(docs(spark, ["a"]).limit(0)).count() == 0


def test_texts_that_several_tasks_have_give_a_row_each(spark):
    df = docs(spark, ["same", "other", "é" * 40_000, None, ""])
    both = df.unionByName(df).repartition(5).unionByName(df)
    got = sorted(tuple(r) for r in media.text_media(both).collect())
    once = sorted(tuple(r) for r in media.text_media(df).collect())
    assert got == sorted(once * 3)


def test_media_is_stored_once_and_pages_hold_texts_and_figures_in_order(spark, monkeypatch):
    monkeypatch.setattr(media, "FRAME_BYTES", 128)
    texts = ["one\ntwo & 2\n" + "x" * 300 + "\nlast", "same", "same", None]
    df = docs(spark, texts)
    frames = media.text_frames(df.unionByName(df)).collect()
    assert len(frames) == len({r.digest for r in frames}) == 3 + 1 + 1
    pages = media.interleave(media.text_pages(df), "doc_id", "html")
    items = {r.doc_id: [(x.kind, x.text or x.caption) for x in r["items"]] for r in pages.collect()}
    assert items[0] == [("text", "one"), ("media", "bytes 0-128 of 317"), ("text", "two & 2"), ("media", "bytes 128-256 of 317"), ("text", "x" * 300), ("media", "bytes 256-317 of 317"), ("text", "last")]
    held = media.text_frames(df)
    assert media.read_pages(pages, held).count() == 4
    for wrong in ("reverse(items)", "filter(items, x -> x.caption IS NULL OR x.caption NOT LIKE 'bytes 128-%')"):
        with pytest.raises(Exception, match="figures"):
            media.read_pages(pages.selectExpr("doc_id", f"{wrong} AS items"), held).collect()


def test_a_damaged_png_is_noticed(monkeypatch):
    monkeypatch.setattr(media, "CHUNK_BYTES", 100)
    payload = bytes(range(256)) * 2
    form = media.to_png(payload)
    assert form.count(b"IDAT") > 1 and media.from_png(form) == payload
    for bad in (form[:-20] + bytes([form[-20] ^ 1]) + form[-19:], form + b"x", b"no" + form):
        with pytest.raises(ValueError):
            media.from_png(bad)


def test_page_digests(spark):
    html = '<p>One &amp; two</p><script>no()</script><figure><img src="cas:ab"><figcaption>A cap</figcaption></figure>tail'
    df = spark.createDataFrame([(1, html, "x"), (2, None, "x"), (2, "", "x")], "page_id long, html string, n_texts string")
    got = sorted(tuple(r) for r in media.page_digests(df).collect())
    told = "text\nOne & two\n\nmedia\nA cap\nab\ntext\ntail\n\n"
    nothing = (2, 0, 0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert got == [(1, 2, 1, 1, 13, hashlib.sha256(told.encode()).hexdigest()), nothing, nothing]


def test_interleaved_pages(spark):
    html = '<body><p>One &amp; two</p><script>no()</script><figure><img src="cas:ab"><figcaption>A <b>cap</b></figcaption></figure>tail<img src="http://x/y.png" alt="alt"></body>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>broken <img src=")], "page_id long, html string")
    sequences = media.interleave(df, "page_id", "html")
    items = {r.page_id: r["items"] for r in sequences.collect()}
    assert [(x.kind, x.text, x.caption) for x in items[1]] == [("text", "One & two", None), ("media", None, "A cap"), ("text", "tail", None), ("media", None, "alt")]
    assert items[2] == []
    found = media.resolve(sequences, spark.createDataFrame([("ab", 7)], "digest string, payload int"), "page_id").where("page_id = 1").orderBy("pos").collect()
    assert [r.payload for r in found] == [None, 7, None, None]


def brute_components(texts, size, num, den):
    sets = []
    for x in texts:
        w = re.findall(SPACED, fold(x))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    top = list(range(len(texts)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 4, 5), (2, 1, 2)])
def test_jaccard_components_are_those_of_all_pairs(spark, size, num, den):
    rng = random.Random(9)
    texts = [None, "", "a", "A", "a b", "x " * 500]
    for base in prose(10, 12):
        words = (base.split() * 3)[:90]
        chain = words
        for _ in range(rng.randint(1, 12)):
            near = (words if rng.random() < 0.5 else chain)[:]
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice("pqrs") * 3
            chain = near
            texts.append(" ".join(near))
    rng.shuffle(texts)
    members, _ = jaccard_join.link(docs(spark, texts, component_id=["clash"] * len(texts)), size, (num, den))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute_components(texts, size, num, den)


def test_jaccard_keeps_one(spark):
    copies = [prose(11, 1)[0] + " and some more words to tell apart"] * 3
    df = docs(spark, [*copies, "another text altogether here now", None, ""])
    kept = jaccard_join.keep_one(df.unionByName(df.where("doc_id >= 3")))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 5]
    assert jaccard_join.link(df.limit(0))[0].count() == 0
    lost = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard_join.link(lost)[0].collect()), key=str) == [(1, 1), (None, None)]


def test_jaccard_doesnt_depend_on_the_order_of_rows_that_repeat_an_id(spark):
    one, two, three = prose(41, 3)
    one, two, three = (f"{x} {x} and a tail of {k} words" for k, x in enumerate((one, two, three)))
    rows = [(1, one), (2, two), (2, one + " more"), (3, two), (1, three), (4, None), (4, ""), (5, three)]
    for turn in (rows, rows[::-1]):
        df = spark.createDataFrame(turn, "doc_id long, text string").coalesce(1)
        members, _ = jaccard_join.link(df)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in members.collect()) == sorted((i, *brute) for (i, _), brute in zip(rows, brute_rows(rows)))
        kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect()]
        assert sorted((i, x or "") for i, x in kept) == sorted([(1, one), (1, three), (2, two), (4, "")])


def brute_rows(rows):
    """(set size, component) of rows that may repeat an id."""
    groups = brute_components([x for _, x in rows], 5, 4, 5)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[groups[k][1]] = min(i, low.get(groups[k][1], i))
    return [(groups[k][0], low[groups[k][1]]) for k in range(len(rows))]


def test_jaccard_pairs_of_a_common_shingle_are_few(spark, monkeypatch):
    """Documents that share one early shingle and nothing else are many components in one group."""
    tried = []
    plain = jaccard_join._suffix_filter
    monkeypatch.setattr(jaccard_join, "_suffix_filter", lambda pairs, *more: tried.append(pairs.count()) or plain(pairs, *more))
    monkeypatch.setattr(jaccard_join, "slot_counts", lambda texts, size: np.zeros(1 << 20, np.uint32))  # no order of rarity
    common = "aa bb cc dd ee ff gg hh ii jj"
    texts = [f"{common} {' '.join(f'w{k}x{j}' for j in range(30))}" for k in range(120)] + [f"{common} {' '.join(f'w{k}x{j}' for j in range(29))} z" for k in range(3)]
    members, _ = jaccard_join.link(docs(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()} == brute_components(texts, 5, 4, 5)
    assert sum(tried) < 40 * len(texts)


@pytest.mark.parametrize("few,short", [(32, 16), (0, 1), (0, 10**6)])
def test_jaccard_pairs_that_share_long_prefixes_meet_once(spark, monkeypatch, few, short):
    """Long documents that share most of their text and just don't link, and some that do, by each way to meet."""
    met, plain = [], jaccard_join._of_different
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "_of_different", lambda *more: met.append(plain(*more).count()) or plain(*more))
    size, many = (2000, 120) if short == 16 else (150, 40)
    base = [f"w{j}" for j in range(size - size * 56 // 1000)]
    texts = [" ".join([*base, *(f"k{k}x{j}" for j in range(size - len(base)))]) for k in range(many)]
    texts += [f"{texts[k]} and one" for k in (3, 3, 5)] + [f"{base[0]} {texts[7]}"]
    members, _ = jaccard_join.link(docs(spark, texts), 3, (90, 100))
    got = {r.doc_id: r.component_id for r in members.collect()}
    assert got == {k: {many: 3, many + 1: 3, many + 2: 5, many + 3: 7}.get(k, k) for k in range(many + 4)}
    if short == 16:
        assert sum(met) < 20_000


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {r.component for r in jaccard_join.components(edges, "t").collect()} == {0}


def brute_hits(texts, items, window):
    found = []
    for x in texts:
        w = re.findall(ALNUM, fold(x))
        hit, names = [False] * len(w), set()
        for name, item in items:
            v = re.findall(ALNUM, fold(item))
            k = min(window, len(v))
            for j in range(len(v) - k + 1 if k else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[j : j + k]:
                        hit[s : s + k] = [True] * k
                        names.add(str(name) if name is not None else "")
        found.append((len(w), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)))
    return found


@pytest.mark.parametrize("block", [100_000, 60])
def test_decontamination_is_that_of_all_windows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 2000)
    items = [(k, x) for k, x in enumerate(prose(12, 8, 60))] + [(8, "short one"), (9, ""), (10, None), (None, "x7, y8"), (8, "short one"), (11, "go go go go go go go go go go go go")]
    pool = prose(13, 30, 60)
    texts = [f"{a} {b[1] or ''} {a}" if k % 2 else a for k, (a, b) in enumerate(zip(pool, itertools.cycle(items)))] + [None, "", "short, ONE X7 y8", "go " * 40, "short", "one"]
    df = docs(spark, texts, items=["clash"] * len(texts))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.report(decontaminate.hits(df, benchmark)).collect()}
    assert got == dict(enumerate(brute_hits(texts, items, 10)))
    kept = decontaminate.clean(df, benchmark)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, x in got.items() if not x[-1]}


def test_decontamination_of_nothing(spark):
    df, none = docs(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated for r in decontaminate.report(decontaminate.hits(df, none)).collect())
    assert decontaminate.hits(df.limit(0), none).count() == 0


def test_proximity(spark):
    index = decontaminate.build_index(docs(spark, ["red and blue", "blue x y z w red", "red", "blue", "red red q blue"]))
    got = {(r.doc_id, r.first, r.last) for r in decontaminate.proximity(index, {"p": "Red blue", "q": ""}, 3).collect()}
    assert got == {(0, 0, 3), (4, 1, 4)}


def test_index_holds_every_position_of_every_term(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 3000)
    texts = ODD + prose(51, 30)
    held = {}
    for row in decontaminate.build_index(docs(spark, texts)).collect():
        seg = decontaminate.Segment.open(row.asDict())
        firsts = seg.doc_starts()
        for k, term in enumerate(seg.terms.tolist()):
            for p in seg.positions[seg.bounds[k] : seg.bounds[k + 1]].tolist():
                d = int(np.searchsorted(firsts, p, side="right")) - 1
                held.setdefault(seg.doc_ids[d], {})[p - int(firsts[d])] = term
    names = {}
    for k, x in enumerate(texts):
        words = re.findall(ALNUM, fold(x))
        assert sorted(held.get(k, {})) == list(range(len(words)))
        assert all(names.setdefault(w, held[k][j]) == held[k][j] for j, w in enumerate(words))
    assert len(set(names.values())) == len(names)


def test_suffix_tree(spark):
    texts = prose(14, 120) + [None, "", "UNSEEN w" + "o" * 3000]
    df = docs(spark, texts, score=["clash"] * 123)
    rows = {r.doc_id: r for r in suffix_tree.score(df, lang_id.held_out("doc_id", 7, 2)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(123)}
    words = {k: re.findall(SPACED, fold(x)) for k, x in enumerate(texts)}
    count, n_docs = {}, sum(not x for x in held.values())
    for k, w in words.items():
        for x in w if not held[k] else []:
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()) + n_docs, len(count) + 1
    for k, w in words.items():
        base = math.log10((n_docs + 1) / (n + v + 1)) + sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w)
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w) + 1, 1 + sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(base)
        assert r.score < 0
    assert suffix_tree.score(df.limit(0), lang_id.held_out("doc_id", 7, 2)).count() == 0
    alone = suffix_tree.score(df, lang_id.held_out("doc_id", 1, 0)).collect()
    assert {r.train_tokens for r in alone} == {0} and len(alone) == 123


def test_suffix_tree_is_a_distribution():
    count = np.array([6, 4, 8, 2, 1, 0])  # the last stands for all unknown words
    p = suffix_tree.root(count, int(count.sum()), 1)
    assert p.sum() == pytest.approx(1.0)
    for seen in ([6, 0, 3, 0, 0, 0], [1, 1, 1, 1, 1, 0]):
        seen = np.array(seen)
        p = suffix_tree.refine(p, seen, seen.sum(), (seen > 0).sum())
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_packed_numbers():
    every = [np.array(x, np.int64) for x in ([], [0], [5, -3, 2**40, -(2**40)], range(5000), [255, 256], [2**63 - 1])]
    assert [x.tolist() for x in suffix_tree.unpack(suffix_tree.pack(*every))] == [x.tolist() for x in every]
    assert suffix_tree.unpack(suffix_tree.pack()) == []


def test_suffix_tree_learns_contexts(spark):
    rng = random.Random(1)
    texts = [" ".join(f"{k} {rng.choice(['x', 'y'])}{k}" for k in (rng.choice("ab") for _ in range(40))) for _ in range(200)]
    rows = suffix_tree.score(docs(spark, texts), lang_id.held_out("doc_id", 7, 2)).collect()
    assert sum(r.score for r in rows if r.held_out) > 0.75 * sum(r.base_score for r in rows if r.held_out)


def brute_tree_scores(texts, held):
    """Scores by the definition, with plain dictionaries over all contexts."""
    end, most = None, suffix_tree.DEPTH
    words = [[*re.findall(SPACED, fold(x)), end] for x in texts]
    after = {}
    for w, out in zip(words, held):
        for i, x in enumerate(w if not out else []):
            for d in range(min(most, i) + 1):
                seen = after.setdefault(tuple(w[i - d : i]), {})
                seen[x] = seen.get(x, 0) + 1
    total = {s: sum(x.values()) for s, x in after.items()}
    tree = set()
    for s, x in after.items():
        if s and total[s] >= 20:
            nats = sum(n * math.log(n / total[s] / (after[s[1:]][y] / total[s[1:]])) for y, n in x.items())
            if 2 * nats >= suffix_tree.G_LEAST * len(x) and nats / math.log(2) >= suffix_tree.GAIN_BITS * total[s]:
                tree |= {s[k:] for k in range(len(s))}
    n, unknown = total[()], sum(c == 1 for c in after[()].values()) / total[()]
    scores = []
    for w in words:
        value = 0.0
        for i, x in enumerate(w):
            p = (1 - unknown) * after[()][x] / n if x in after[()] else unknown
            for d in range(1, min(most, i) + 1):
                if (s := tuple(w[i - d : i])) in tree:
                    p = (after[s].get(x, 0) + len(after[s]) * p) / (total[s] + len(after[s]))
            value += math.log10(p)
        scores.append(value)
    return scores, tree, total


@pytest.mark.parametrize("split,segment", [(100_000, 1 << 22), (200, 3000)])
def test_suffix_tree_scores_are_those_of_all_counted_contexts(spark, monkeypatch, split, segment):
    monkeypatch.setattr(suffix_tree, "SPLIT_LEAST", split)
    monkeypatch.setattr(suffix_tree, "SPLIT_MOST", 10**9)
    monkeypatch.setattr(suffix_tree, "SEGMENT_BYTES", segment)
    rng = random.Random(21)
    texts = [None, "", "once only"]
    for x in prose(22, 400, 700):
        w = x.split()
        for _ in range(2):
            w[(k := rng.randrange(len(w))) : k] = rng.choice(["u v w x", "v v w y", "u u w z", "q v w q"]).split()
        texts.append(" ".join(w))
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    want, tree, total = brute_tree_scores(texts, held)
    rare = {len(s) for s in tree if total[s] < 3e-3 * total[()]}
    assert {len(s) for s in tree} == {1, 2, 3} and 1 in rare
    got = {r.doc_id: r.score for r in suffix_tree.score(docs(spark, texts), lang_id.held_out("doc_id", 7, 2)).collect()}
    assert [got[k] for k in range(len(texts))] == pytest.approx(want, rel=1e-9)


def test_suffix_tree_gives_counts_back_by_number_in_few_bytes():
    rng, buckets, bucket = np.random.default_rng(5), 64, 9
    count = np.sort(rng.zipf(1.3, 5000) % 10**6)[::-1].astype(np.int64)
    number = np.where(count >= 20, 1 + np.arange(5000) * buckets + bucket, 0)
    own = rng.permutation(5000)[:2000]
    sent = suffix_tree.pack_counts(number[own], count[own], buckets, bucket, np.arange(3))
    assert [x.tolist() for x in suffix_tree.unpack_counts(sent, buckets, bucket)] == [count[own].tolist(), number[own].tolist(), [0, 1, 2]]
    assert len(sent) < 0.8 * len(suffix_tree.pack(count[own], number[own], np.arange(3)))


def test_suffix_tree_stores_its_segments_without_moving_them(spark, monkeypatch):
    plans, plain = {}, store.keep_by
    monkeypatch.setattr(store, "keep_by", lambda df, name, *more, **kind: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or plain(df, name, *more, **kind))
    suffix_tree.score(spark.createDataFrame([(k, "a b") for k in range(9)], "doc_id long, text string"), lang_id.held_out("doc_id", 7, 2))
    assert "Exchange" not in plans["lm-stage"] and "Exchange" not in plans["lm-frame"]


def test_suffix_tree_sends_what_is_expected_by_context_not_by_run():
    some = [np.array(x) for x in ([0, 1, 2], [0, 1, 2], [7, 7, 9], [1, 2, 1], [30, 30, 40], [100] * 3, [50, 25, 50], [4, 2, 0])]
    level = suffix_tree.Level(*some, np.zeros(3, np.int32))
    (sent,) = level.send(5).column("sent").to_pylist()
    context, runs, total, expected, steps, n = suffix_tree.unpack(sent)
    assert (np.cumsum(context).tolist(), runs.tolist(), total.tolist(), n.tolist()) == ([7, 9], [2, 1], [30, 40], [4, 2, 0])
    assert expected.tolist() == [4 * round(math.log(2) * suffix_tree.UNIT) + 2 * round(math.log(4) * suffix_tree.UNIT), 0]
