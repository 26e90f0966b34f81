"""The pipeline against plain Python on a small corpus."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from planwalk.llm import mixing

from .test_operators import BPE, SPACED, brute_components, brute_hits, fold, prose


def brute_mix(rows, share=1.5, most=2.0, seed=0):
    """Words that the mix takes of each row (id, text, source), slot by slot and word by word."""
    names = sorted({s for *_, s in rows}, key=lambda x: (x is None, x or ""))
    streams = {s: [i for i, x, z in sorted(rows) if z == s for _ in re.findall(SPACED, x or "")] for s in names}
    sizes = [len(streams[s]) for s in names]
    quota = mixing.quotas(sizes, mixing.targets(sizes, share, most), mixing.BLOCK_WORDS)
    taken = {i: 0 for i, *_ in rows}
    for code, s in enumerate(names):
        blocks = -(-sizes[code] // mixing.BLOCK_WORDS)
        for slot in range(quota[code]):
            turn, place = divmod(slot, blocks)
            k = int(mixing.permuted(np.array([place]), blocks, f"{seed}/{code}/{turn}".encode())[0])
            for i in streams[s][k * mixing.BLOCK_WORDS : (k + 1) * mixing.BLOCK_WORDS]:
                taken[i] += 1
    return taken


def test_pipeline_is_its_stages_done_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    base = [x for x in prose(21, 120) if len(x.split()) >= 20]
    items = prose(22, 4)
    items = [x for x in items if len(re.findall(r"\S+", x)) >= 10]
    texts = base + [base[0], base[1] + " more", base[2] + " " + items[0], None, "", "12 34 !", base[3].upper()]
    rows = [(k, x, "en", f"s{k % 4}", len(x or "")) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    groups = brute_components([r[1] for r in left], 5, 4, 5)
    left = [r for k, r in enumerate(left) if groups[k][1] == k]
    hits = brute_hits([r[1] for r in left], list(enumerate(items)), 10)
    left = [r for r, h in zip(left, hits) if not h[-1]]
    assert len(rows) - len(left) >= 7
    taken = brute_mix([(r[0], r[1], r[3]) for r in left])
    chance = {r.id: r.c for r in spark.createDataFrame([(r[0],) for r in left], "id long").select("id", (F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1 << 32)) / F.lit(float(1 << 32))).alias("c")).collect()}
    times = {r[0]: int(taken[r[0]] / len(re.findall(SPACED, r[1])) + chance[r[0]]) for r in left}
    coder, want, at = Tokenizer.from_file(BPE), [], 0
    for r in left:
        ids = [*coder.encode(r[1], add_special_tokens=False).ids, 0]
        for _ in range(times[r[0]]):
            want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)
    assert fold(base[3].upper()) == base[3]


def test_mix_is_the_one_done_word_by_word(spark):
    texts = prose(23, 60)
    rows = [(k, x, None if k % 5 == 0 else f"s{k % 3}") for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect()} == brute_mix(rows)


def test_the_last_stage_of_nothing(spark, tmp_path):
    out = corpus_pipeline.STAGES[4][1](spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0


def test_pipeline_with_null_ids_and_clashing_columns(spark, tmp_path):
    base = [x for x in prose(25, 40) if len(x.split()) >= 20]
    rows = [(k, x, "en", f"s{k % 2}", 1, "a", 2, "b") for k, x in enumerate(base)] + [(None, base[0] + " tail of its own here", "en", None, 1, "a", 2, "b"), (None, None, None, None, None, None, None, None), (3, base[3], "en", "s1", 1, "a", 2, "b")]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, node long, start string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (1, "no such passage in any of the documents at all here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == [x.split()[0] for x in kinds.split(", ")]
    ids = {r.doc_id for r in held.collect()}
    assert ids <= {None, *range(len(base))} and len(ids) > len(base) // 2
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == held.count()


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_the_columns_and_survive_nothing(spark, tmp_path, stage):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame([], kinds), str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == 0


def test_mix_shards_hold_the_blocks_that_slots_draw(spark):
    texts = prose(24, 80)
    rows = [(k % 70, x, None if k % 5 == 0 else f"s{k % 3}") for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, block = mixing.mix_shards(df, block=16, shard_slots=50).collect(), 16
    names = sorted({s for *_, s in rows}, key=lambda x: (x is None, x or ""))
    sizes = [sum(len(re.findall(SPACED, x)) for _, x, z in rows if z == s) for s in names]
    quota = mixing.quotas(sizes, mixing.targets(sizes, 1.5, 2.0), block)
    drawn = [mixing.shard_counts(quota, 50, 0, k)[0] for k in range(-(-sum(quota) // 50))]
    assert len(drawn) > 3
    for shard, counts in enumerate(drawn):
        here = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in here) == list(range(int(counts.sum())))
        assert [sum(r.source == s for r in here) for s in names] == counts.tolist()
    assert len(got) == sum(quota)
    for code, s in enumerate(names):
        blocks = {r["index"]: [tuple(x) for x in r.spans] for r in got if r.source == s}
        last = -(-sizes[code] // block) - 1
        for index, spans in blocks.items():
            assert sum(n for *_, n in spans) == (block if index < last else sizes[code] - last * block)
            assert all(first == 0 for _, _, first, _ in spans[1:])
    taken = {}
    for r in got:
        for x in r.spans:
            taken[x.doc_id] = taken.get(x.doc_id, 0) + x.n
    want = {}
    for r in mixing.mix(df, block=16).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert taken == {k: n for k, n in want.items() if n}
