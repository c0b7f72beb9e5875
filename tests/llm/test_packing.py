import random

import pytest

from seqspark.llm.packing import encoder, pack, pack_counts, pack_documents, step_groups, TOKENIZER


def test_pack_keeps_every_token():
    rng = random.Random(5)
    caps = [64, 256, 1024]
    items = [(min(5000, int(rng.lognormvariate(4, 1.2)) + 1), i) for i in range(3000)]
    made = pack(items, caps)
    seen = {}
    for k, held in made:
        assert sum(x[3] for x in held) <= caps[k]
        for item, piece, first, n in held:
            seen.setdefault(item, []).append((piece, first, n))
    for n, i in items:
        pieces = sorted(seen[i])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == n
        assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:])) and pieces[0][1] == 0
        assert len(pieces) == 1 or n > caps[-1]
    used = sum(n for n, _ in items)
    assert used / sum(caps[k] for k, _ in made) > 0.98


def test_pack_edges():
    assert pack([], [8]) == []
    assert pack([(8, "a"), (1, "b")], [8]) == [(0, [("a", 0, 0, 8)]), (0, [("b", 0, 0, 1)])]
    assert pack([(17, "a")], [8]) == [(0, [("a", 0, 0, 8)]), (0, [("a", 1, 8, 8)]), (0, [("a", 2, 16, 1)])]


def test_step_groups():
    loads = [100, 1, 50, 51, 99, 2]
    g = step_groups(loads, 2)
    assert sorted(g) == [0, 0, 1, 1, 2, 2]
    sums = [sum(x for x, k in zip(loads, g) if k == i) for i in range(3)]
    assert max(sums) - min(sums) <= 2
    assert step_groups([], 4) == []


def test_documents(spark):
    texts = {1: "hello world " * 30, 2: "", 3: None, 4: "x y z " * 4000, 5: "short", 6: "short", None: "no id here", 7: "word " * 200}
    df = spark.createDataFrame([(k, v, 1) for k, v in texts.items()] + [(5, "short", 1)], "doc_id bigint, text string, tokens int")
    sizes = spark.createDataFrame([("s", 64), ("m", 512), ("l", 2048), ("bad", None), ("zero", 0)], "pack_kind string, capacity_tokens int")
    packed = pack_documents(df, sizes)
    rows = packed.collect()
    encode = encoder(TOKENIZER).encode_ordinary
    want = {}
    for k, v in [*texts.items(), (5, "short")]:
        if v:
            want[k] = want.get(k, 0) + len(encode(v))
    got, load = {}, {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["tokens"]
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        assert load[r["container"]] <= r["capacity_tokens"]
    assert got == want
    s = pack_counts(packed).collect()
    assert sum(r["tokens"] for r in s) == sum(want.values()) and sum(r["messages"] for r in s) == 7
    assert pack_documents(df.limit(0), sizes).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, sizes.filter("capacity_tokens = 0"))
