import random
import zlib
from collections import Counter, defaultdict

from cohortframe.llm import sharding


def brute(sizes, capacity):
    """Best fit decreasing, one group at a time over a plain list."""
    bins, out = [], []
    for size in sizes:
        fits = [k for k, room in enumerate(bins) if room >= size]
        if size > capacity or not fits:
            bins.append(max(0, capacity - size))
            out.append(len(bins) - 1)
        else:
            k = min(fits, key=lambda k: (bins[k], k))
            bins[k] -= size
            out.append(k)
    return out


def test_runs_pack_like_single_groups():
    rng = random.Random(1)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 60))), reverse=True)
        capacity = rng.randint(1, 60)
        stretches = sharding.best_fit(sorted(Counter(sizes).items(), reverse=True), capacity)
        got = [b for n, b in stretches for _ in range(n)]
        want = brute(sizes, capacity)
        kept = [i for i, s in enumerate(sizes) if s <= capacity]
        assert [got[i] for i in kept] == [want[i] for i in kept] and len(got) == len(want)


def test_tree_stays_balanced_and_ordered():
    rooms, keys = sharding.Rooms(), set()
    rng = random.Random(2)
    for _ in range(3000):
        if keys and rng.random() < 0.4:
            size = rng.randint(0, 500)
            want = min((k for k in keys if k[0] >= size), default=None)
            assert rooms.tightest(size) == want
            keys.discard(want)
        else:
            key = (rng.randint(0, 500), rng.randint(0, 10**9))
            if key not in keys:
                keys.add(key)
                rooms.add(key)
    assert rooms._height(rooms.root) <= 1.45 * len(keys).bit_length() + 2


def test_documents(spark, documents):
    rows = sharding.shard_documents(documents, 7).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    load, slots, places = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[texts[r.doc_id]].add(r.shard)
    assert len(rows) == len(texts) and set(load) == set(range(7))
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values()) / 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())


def test_edges(edge, empty):
    rows = sharding.shard_documents(edge, 3).collect()
    assert len(rows) == edge.count()
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.size, r.text_crc32, r.shard))
    assert len(by_id[5]) == 1 and {x[:2] for x in by_id[1] | by_id[2]} == {(16, 0)} and by_id[1] == by_id[2]
    assert sharding.shard_documents(empty, 3).count() == 0


def test_a_group_above_an_even_share_is_alone():
    stretches = sharding.into_shards([(1000, 1), (10, 50)], 6)
    assert stretches[0] == (1, 0) and max(b for _, b in stretches) <= 5
    load = Counter()
    for n, b in stretches[1:]:
        load[b] += 10 * n
    assert set(load.values()) == {100}
