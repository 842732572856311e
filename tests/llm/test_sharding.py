"""Jump hashing against the textbook loop, and the laws of the result."""

import zlib
from collections import Counter, defaultdict

import numpy as np

from factloom.llm.sharding import assign_shards, jump_hash, write_shards


def plain(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_matches_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    now, grown = jump_hash(keys, 16), jump_hash(keys, 17)
    assert now.tolist() == [plain(int(k), 16) for k in keys]
    assert set(grown[now != grown]) == {16}
    assert abs((now != grown).mean() - 1 / 17) < 0.02
    assert jump_hash(keys, 1).max() == 0


def test_slots_sizes_and_checksums(spark):
    texts = ["", None, "é" * 10, "a", "a", "x" * 50_000]
    rows = [(k, texts[k % len(texts)], "slot") for k in range(400)] + [(7, "again", "s"), (None, "n", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    got = assign_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots, place = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        place[r.doc_id].add((r.shard, r.grown_shard, r.law))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
    assert all(len(p) == 1 for p in place.values())
    assert all(g in (s, 16) for p in place.values() for s, g, _ in p)
    assert assign_shards(docs.limit(0)).count() == 0


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "doc_id long, text string")
    write_shards(docs, str(tmp_path / "out"), 4)
    want = {r.doc_id: r.shard for r in assign_shards(docs, 4).collect()}
    assert {r.doc_id: r.shard for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_written_shards_of_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, 5), (None, "x", 6)], "doc_id long, text string, hash int")
    write_shards(docs, str(tmp_path / "odd"), 3)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert sorted(r.hash for r in back.collect()) == [5, 6] and set(back.columns) == {*docs.columns, "shard"}
    write_shards(docs.limit(0), str(tmp_path / "none"), 3)
