"""Brute force, edge cases and planted cases of operators 11 to 13."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from planwalk.llm import imatch, repair, spelling

LETTERS = r"[A-Za-zÀ-ÿ]+"


def fold(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x)


# spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got_variants(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelled(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(4, 9))) for _ in range(30)]

    def bad(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abcé") + w[k + 1 :]])

    pool = base * 6 + [bad(w) for w in base for _ in range(6)] + [bad(bad(w)) for w in base for _ in range(3)]
    return [" ".join(rng.choice(pool).capitalize() + rng.choice(["", ",", "1"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("tile,piece", [(256, 1 << 20), (4, 50)])
def test_variants_are_those_of_brute_force(spark, monkeypatch, tile, piece):
    monkeypatch.setattr(spelling, "TILE", tile)
    monkeypatch.setattr(spelling, "PIECE", piece)
    texts = misspelled(1, 120) + [None, "", "123 ,", "Ààààà ÀÀÀÀÀ ààààà " * 3, "aaaaa aaaaaa aaaaaaa " * 9]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3])]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, word string").repartition(3)
    want = brute_variants(rows)
    assert got_variants(df) == want
    assert any(w[2] != w[0] and w[2] != w[1] for w in want)
    assert got_variants(df.limit(0)) == []


def test_groups_larger_than_a_tile(monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 8)
    rng = random.Random(2)
    words = sorted({"".join(x) for x in itertools.product("abcde", repeat=2)} | {"a", "b"})
    rng.shuffle(words)
    words = ["word" + w for w in words]
    tiles = spelling.Tiles(words, np.full(len(words), 6), np.full(len(words), 2))
    got = [(words[i], words[j]) for a, b in tiles.pairs(np.array([0, len(words)])) for i, j in zip(a, b)]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if one_edit(*p) and max(map(len, p)) == 6 and min(len(str_prefix(*p)), 5) // 2 == 2}
    assert len(got) == len(set(map(frozenset, got))) and set(map(frozenset, got)) == want


def str_prefix(a, b):
    return "".join(x for x, _ in itertools.takewhile(lambda p: p[0] == p[1], zip(a, b)))


def test_a_hot_prefix_stays_in_small_groups(spark):
    words = ["commonstem" + "".join(x) for x in itertools.product("abcdefghij", repeat=3)]
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")
    got = spelling.near_pairs(df).count()
    assert got == len(words) * 27


# fingerprints


def brute_terms(text):
    return set(re.findall(r"[^\x20\x09-\x0D]+", fold(text)))


def brute_fingerprint(text, lexicon):
    found = brute_terms(text)
    level = max(0, int(math.log2(len(found))) - 1) if found else 0
    entries = []
    for v in range(level, level + 3):
        for k in range(8):
            own = sorted(t for t in found & lexicon if int(hashlib.md5(t.encode()).hexdigest()[:8], 16) * 2**v // 2**32 == k)
            if own:
                entries.append(f"{v}.{k}={hashlib.md5(' '.join(own).encode()).hexdigest()[:12]}")
    return f"{level}|{' '.join(entries)}" if entries else "=" + hashlib.sha256(text.encode()).hexdigest()


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if "=" in (a[0], b[0]):
        return 0.0
    x, y = ({e.split("=")[0]: e.split("=")[1] for e in f.split("|")[1].split(" ")} for f in (a, b))
    levels = set(range(int(a.split("|")[0]), int(a.split("|")[0]) + 3)) & set(range(int(b.split("|")[0]), int(b.split("|")[0]) + 3))
    x, y = ({k: v for k, v in f.items() if int(k.split(".")[0]) in levels} for f in (x, y))
    slots = x.keys() | y.keys()
    return sum(x.get(k) == y.get(k) for k in slots) / len(slots) if slots else 0.0


def brute_compared(rows, least, share):
    rows = sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    df = Counter(t for _, x in rows for t in brute_terms(x))
    lexicon = {t for t, n in df.items() if least <= n <= share * len(rows)}
    out = []
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        mine, its, theirs = (brute_fingerprint(x, lexicon) for x in (text, changed, other))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mine, its, brute_likeness(mine, its), brute_likeness(mine, theirs)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("parts", ["1", "4"])
def test_fingerprints_are_those_of_brute_force(spark, parts):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 6))).title() for _ in range(900)] + ["漢字", "é", "ÉÉ", "."]
    texts = [" ".join(rng.choice(words) for _ in range(int(rng.choice([1, 3, 20, 150, 700])))) for _ in range(60)]
    texts += [None, "", " ", "x", "漢", texts[3], texts[3] + " end", "one " * 30_000, "y" * 100_001]
    rows = [(7 * k - 40, x) for k, x in enumerate(texts)] + [(None, "last of all"), (2**60, texts[5])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, h int").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = imatch.compare_edited(df, most_share=0.5)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_compared(rows, 2, 0.5), key=key)
        assert imatch.compare_edited(df.limit(0)).count() == 0
        only = imatch.compare_edited(df.where("doc_id = 2")).collect()
        assert len(only) == 1 and only[0].near_next == 1.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_ids_and_copies_have_equal_fingerprints(spark):
    texts = ["a b c d e"] * 50 + ["f g h"] * 50 + ["", None]
    df = spark.createDataFrame([(k % 9, x) for k, x in enumerate(texts)], "doc_id long, text string").repartition(4)
    rows = imatch.compare_edited(df).collect()
    assert len(rows) == len(texts)
    assert len({r.fingerprint for r in rows}) == 3


def test_near_copies_stay_alike(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("aeinrst") for _ in range(5)) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(300)] for _ in range(80)]
    near = [[w if rng.random() > 0.02 else rng.choice(words) for w in x] for x in base]
    rows = [(2 * k, " ".join(x)) for k, x in enumerate(base)] + [(2 * k + 1, " ".join(x)) for k, x in enumerate(near)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in imatch.compare_edited(df, most_share=0.5).collect()}
    alike = [found[k].near_next for k in range(1, 160, 2)]
    apart = [found[k].near_next for k in range(2, 160, 2)]
    halves = [r.near_edited for r in found.values()]
    assert min(alike) > max(apart) and sum(alike) / 80 > 0.8
    assert sum(apart) / 79 < 0.05 < sum(halves) / 160


# repair


def brute_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (1 + (kind == 3))
    return out


def plans_of(symbols):
    """Least cost and ASCII-least letters over all plans, by a search of its own over (place, state) from the end."""
    n = len(symbols)
    due = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {}
    # (cost, letters) of each place and state; inserts settle by repeated passes
    for i in range(n, -1, -1):
        now = {q: (0, "") if i == n and q in (0, 3) else (math.inf, "") for q in range(4)}
        if i < n:
            initial, cut, gone = symbols[i]
            for q in range(4):
                options = [(2, "D", q)]
                if not gone:
                    if initial == due[q]:
                        options.append((5 * cut, "K", to[q]))
                    if initial == "s" and q == 0:
                        options.append((5 * cut, "K", 1))
                    options.append((1 + 5 * cut, "R", to[q]))
                now[q] = min((c + best[i + 1, s][0], x + best[i + 1, s][1]) for c, x, s in options)
        for _ in range(4):
            now = {q: min(now[q], (5 + now[to[q]][0], "I" + now[to[q]][1])) for q in range(4)}
        best |= {(i, q): v for q, v in now.items()}
    return best[0, 0]


def brute_repair(rows):
    out = []
    damaged = brute_rows(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        faults, seen, symbols = [], set(), []
        for _, _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            symbols.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        turns = {r[1] for r in own} - {None}
        cost, letters = plans_of(symbols)
        state, lines, place = 0, [], 0
        for x in letters:
            name = "assistant" if state == 2 else "user"
            if x == "I":
                lines.append(f"{name}:")
            else:
                role, text = own[place][2:]
                place += 1
                if x == "D":
                    continue
                lines.append(f"{name if x == 'R' else role}:{text}")
                if x == "K" and state == 0 and role[:1] == "s":
                    state = 1
                    continue
            state = 3 if state == 2 else 2
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def talk(seed, convs, most=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant"] if rng.random() < 0.2 else [["user", "assistant"][turn % 2]]) if rng.random() < 0.9 else rng.choice(["system", "tool", "sys", ""])
            text = rng.choice(["Yes.", "No!", "And then?", "it ends", " ", "", "word. \n", f"text {rng.random()}.", f"cut {rng.random()}"])
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, text))
    kept = {}
    for r in rows:
        kept.setdefault(r[:2], r)  # rows of one turn that differ have no order
    return list(kept.values())


@pytest.mark.parametrize("chunk", [4096, 2, 5])
def test_repair_is_that_of_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rows = talk(chunk, 150) + talk(chunk + 1, 1, 120)[:0]
    rows += [(500, k, ["user", "assistant"][k % 2], f"turn {k}.") for k in range(90)]
    rows += [(501, None, "user", "Hello."), (None, 1, "user", None), (None, 2, None, "Text."), (None, None, "assistant", "Yes.")]
    rows += [(502, k, "user", "Same.") for k in range(40)] + [(502, 3, "user", "Same.")] * 3
    rows += [(503, k, "tool", None) for k in range(6)] + [(504, 1, "assistant", "x" * 200_000 + "."), (504, 2, "system", "漢字。")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(4)
    got = sorted((tuple(r) for r in repair.repair(df).collect()), key=key)
    assert got == sorted(brute_repair(rows), key=key)
    assert repair.repair(df.limit(0)).count() == 0


def test_every_short_conversation_by_the_tables():
    t = repair.tables()
    kinds = [(r, c, False) for r in "suao" for c in (False, True)] + [("u", False, True)]
    for n in range(5):
        for own in itertools.product(range(9), repeat=n):
            if n == 4 and sum(own) % 5:
                continue
            letters, state, cost = t.plan(np.array(own, np.int64))
            assert (cost, letters + repair._LAST[state]) == plans_of([kinds[k] for k in own])


def test_dropped_conversations_stay(spark):
    gone = [k for k in range(400) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    df = spark.createDataFrame([(k, 0, "user", "Hi.") for k in gone], "conv_id long, turn long, role string, text string")
    rows = repair.repair(df).collect()
    assert sorted(r.conv_id for r in rows) == gone
    assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
