import json

from seqspark.operators.nested import identify, merkle_tables, parse_deep, read_json, task_children


def rebuild(tables):
    edges = {}
    for r in tables.edges.collect():
        edges.setdefault(bytes(r["parent_id"]), []).append(r)
    kinds = {bytes(r["node_id"]): r["kind"] for r in tables.nodes.collect()}

    def value(kind, child, text):
        if child is None:
            return [] if kind == "array" else text if kind == "string" else json.loads({"null": "null"}.get(kind, text))
        child = bytes(child)
        made = {} if kinds[child] == "object" else {None: []}
        for r in sorted(edges.get(child, []), key=lambda r: r["ordinal"]):
            path = [r["name"], *r["at"]]
            holder = made
            for step, after in zip(path, path[1:]):
                if isinstance(holder, dict):
                    holder = holder.setdefault(step, [])
                else:
                    if step == len(holder):
                        holder.append([])
                    holder = holder[step]
            v = value(r["kind"], r["child_id"], r["value"])
            if isinstance(holder, dict):
                holder[path[-1]] = v
            else:
                assert len(holder) == path[-1]
                holder.append(v)
        return made if kinds[child] == "object" else made[None]

    return {r["rec"]: value(r["kind"], r["node_id"], r["value"]) for r in tables.roots.collect() if r["error"] is None}


def test_round_trip_and_sharing(spark):
    docs = [{"a": [1, 2.5, True, None, "x", {"b": []}], "c": {}}, {"c": {}, "a": []}, [[], [[]], {"k": {"k": {"k": 1}}}], 5, "text", None, {"same": [{"x": 1, "y": 2}, {"y": 2, "x": 1}]}]
    df = spark.createDataFrame([(i, json.dumps(d), 1) for i, d in enumerate(docs)] + [(90, None, 1), (91, "{broken", 1)], "rec int, doc string, value int")
    t = merkle_tables(df, "rec", "doc")
    assert rebuild(t) == dict(enumerate(docs))
    assert {r["rec"]: r["error"] for r in t.roots.filter("error is not null").collect()} == {90: "null", 91: "invalid"}
    same = t.edges.filter("kind = 'object' and name = 'same'").groupBy("child_id").count().filter("count > 1")
    assert same.count() >= 1  # two spellings of one object share an identity
    assert t.nodes.count() == t.nodes.select("node_id").distinct().count()


def test_key_order_and_depth():
    ids = [identify(json.loads(s), lambda *a: None) for s in ('{"a":1,"b":[1]}', ' { "b" : [1],"a":1}', '{"a":1,"b":["1"]}', '{"a":"1","b":[1]}')]
    assert ids[0] == ids[1] and len(set(ids)) == 3
    deep = "[" * 50_000 + "]" * 50_000
    identify(parse_deep(deep), lambda *a: None)
    for s in ('{"a":[1,{"b":"x\\n"}],"c":null}', "[]", '"s"', "-1.5e3"):
        assert parse_deep(s) == read_json(s)


def test_numbers_keep_their_digits(spark):
    docs = ["1.10", "1e2", "-0", "123456789012345678901234567890.5", "1.0", "1.00"]
    df = spark.createDataFrame([(i, f'{{"n":[{d}]}}') for i, d in enumerate(docs)], "rec int, doc string")
    t = merkle_tables(df, "rec", "doc")
    held = {bytes(r["parent_id"]): r["value"] for r in t.edges.collect()}
    assert {r["rec"]: held[bytes(r["node_id"])] for r in t.roots.collect()} == dict(enumerate(docs)) and len(held) == len(docs)


def test_deep_document_in_table(spark):
    n = 20_000
    df = spark.createDataFrame([(1, '{"tasks":' + "[" * n + "]" * n + "}"), (2, '{"options":"a"}')], "rec int, doc string")
    t = merkle_tables(df, "rec", "doc")
    assert t.nodes.count() == 2 and max(len(r["at"]) for r in t.edges.collect()) == n - 1
    assert task_children(t, "rec").count() == 1


def test_children(spark):
    docs = {
        1: {"options": [{"opt": "-a", "name": "A"}, {"opt": None, "name": "B"}, {"opt": "", "name": "C"}, {"x": 1}, "bare", "", None], "see_also": "t1", "requires": {"perl_lib": ["L1", "L2"]}},
        2: {"tasks": [{"options": {"name": "one"}}, None, {"see_also": ["x", None, "y", "x"], "requires": [{"ruby": "z"}, {"perl_lib": "P"}, {"perl_lib": None}]}], "options": ["not a task's"]},
        3: {"tasks": {"options": "solo"}},
        4: {"tasks": []},
        5: {"options": None, "see_also": "", "requires": []},
        6: {"tasks": [{"options": [{"inner": {"options": ["no"]}}]}]},
        7: [1],
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [(1, json.dumps(docs[1])), (None, '{"options":"n"}')], "rec int, doc string")
    got = sorted(map(tuple, task_children(merkle_tables(df, "rec", "doc"), "rec").collect()), key=str)
    one = [(1, 0, "options", 0, "-a"), (1, 0, "options", 1, "B"), (1, 0, "options", 2, "C"), (1, 0, "options", 4, "bare"), (1, 0, "see_also", 0, "t1"), (1, 0, "perl_lib", 0, "L1"), (1, 0, "perl_lib", 0, "L2")]
    rest = [(2, 0, "options", 0, "one"), (2, 2, "see_also", 0, "x"), (2, 2, "see_also", 2, "y"), (2, 2, "see_also", 3, "x"), (2, 2, "perl_lib", 1, "P"), (3, 0, "options", 0, "solo"), (None, 0, "options", 0, "n")]
    assert got == sorted(one * 2 + rest, key=str)


def test_empty(spark):
    t = merkle_tables(spark.createDataFrame([], "rec int, doc string"), "rec", "doc")
    assert t.roots.count() == t.nodes.count() == t.edges.count() == task_children(t, "rec").count() == 0
