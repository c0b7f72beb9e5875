"""Deeply nested records as flat tables: every distinct object is stored once under the hash of its content (a Merkle identity)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import store

#: Rows that one task remembers to not emit twice; only repeats that reach the shuffle depend on it.
SEEN = 200_000
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_BARE = re.compile(r"[-+0-9.eE]+|true|false|null")


class Number(str):
    """A JSON number in its own digits, so that none is lost or changed."""

    __slots__ = ()


def read_json(text: str) -> object:
    return json.loads(text, parse_float=Number, parse_int=Number, parse_constant=Number)


def parse_deep(text: str) -> object:
    """JSON of any depth, without recursion; used where the usual parser runs out of stack."""
    stack: list = [[]]
    keys: list = [None]
    i, n = 0, len(text)

    def put(v: object) -> None:
        if isinstance(stack[-1], dict):
            if keys[-1] is None:
                if not isinstance(v, str) or isinstance(v, Number):
                    raise ValueError("a key is no string")
                keys[-1] = v
            else:
                stack[-1][keys[-1]] = v
                keys[-1] = None
        else:
            stack[-1].append(v)

    while i < n:
        c = text[i]
        if c in " \t\r\n,:":
            i += 1
        elif c in "{[":
            v: object = {} if c == "{" else []
            put(v)
            stack.append(v)
            keys.append(None)
            i += 1
        elif c in "}]":
            if len(stack) == 1 or keys[-1] is not None or isinstance(stack[-1], dict) != (c == "}"):
                raise ValueError("brackets do not match")
            stack.pop()
            keys.pop()
            i += 1
        elif m := (_STRING if c == '"' else _BARE).match(text, i):
            put(read_json(m[0]))
            i = m.end()
        else:
            raise ValueError(f"unexpected {c!r}")
    if len(stack) != 1 or len(stack[0]) != 1:
        raise ValueError("no single value")
    return stack[0][0]


def _clean(s: str) -> str:
    return s if s.isascii() else s.encode("utf-8", "replace").decode("utf-8")


def scalar(v: object) -> tuple[str, str | None] | None:
    """Kind and text of a scalar; None for an object or array."""
    if isinstance(v, Number):
        return "number", str(v)
    if isinstance(v, str):
        return "string", _clean(v)
    if v is None:
        return "null", None
    if isinstance(v, bool):
        return "boolean", "true" if v else "false"
    if isinstance(v, (int, float)):
        return "number", json.dumps(v)
    return None


def _below(v: object) -> list[dict]:
    """Objects directly below a value, through arrays of any depth."""
    found, walk = [], list(v.values()) if isinstance(v, dict) else list(v)
    while walk:
        x = walk.pop()
        if isinstance(x, dict):
            found.append(x)
        elif isinstance(x, list):
            walk += x
    return found


def identify(root: dict | list, emit: Callable[[bytes, bool, list], None]) -> bytes:
    """Hash of a record, bottom-up and without recursion; ``emit(digest, is_object, children)`` is called for it and each object below.

    The canonical form orders an object's keys, so that key order and layout make no difference; an array's order counts. Children are
    (name, at, kind, digest of an object, text of a scalar) in canonical order, with ``at`` the positions in the arrays that lead there.
    """
    todo: list = [(root, False)]
    made: dict[int, bytes] = {}
    while todo:
        v, ready = todo.pop()
        if not ready:
            todo.append((v, True))
            todo += [(x, False) for x in _below(v)]
            continue
        is_object = isinstance(v, dict)
        form = [b"o" if is_object else b"a"]
        children: list[tuple] = []

        def leaf(key: str | None, at: list[int], x: object) -> None:
            if isinstance(x, str):
                t = x.encode("utf-8", "surrogatepass")
                kind = "number" if type(x) is Number else "string"
                form.append(b"%s%d:%s" % (b"nu" if kind == "number" else b"st", len(t), t))
                children.append((key, at, kind, None, x if len(t) == len(x) else _clean(x)))
            elif (s := scalar(x)) is None:
                d = made[id(x)]
                form.append(b"O" + d)
                children.append((key, at, "object", d, None))
            else:
                t = (s[1] or "").encode()
                form.append(b"%s%d:%s" % (s[0][:2].encode(), len(t), t))
                children.append((key, at, s[0], None, s[1]))

        for key, x in sorted(v.items()) if is_object else [(None, v)]:
            name = None
            if key is not None:
                k = key.encode("utf-8", "surrogatepass")
                form.append(b"k%d:%s" % (len(k), k))
                name = key if len(k) == len(key) else _clean(key)
            if not isinstance(x, list):
                leaf(name, [], x)
                continue
            form.append(b"[")
            if not x:
                children.append((name, [], "array", None, None))
            open_: list[list] = [[x, 0]]
            while open_:
                array, i = open_[-1]
                if i == len(array):
                    form.append(b"]")
                    open_.pop()
                    continue
                open_[-1][1] += 1
                if not isinstance(array[i], list):
                    leaf(name, [o[1] - 1 for o in open_], array[i])
                    continue
                form.append(b"[")
                if not array[i]:
                    children.append((name, [o[1] - 1 for o in open_], "array", None, None))
                open_.append([array[i], 0])
        made[id(v)] = d = blake2b(b"".join(form), digest_size=16).digest()
        emit(d, is_object, children)
    return made[id(root)]


@dataclass(frozen=True)
class MerkleTables:
    """``roots`` (id, kind, node_id, value, error): one row per record. ``held`` (node_id, kind, children): objects with all they hold, as
    parsed: some come twice."""

    roots: DataFrame
    held: DataFrame

    @property
    def objects(self) -> DataFrame:
        """(node_id, kind, children): each distinct object (or array that is a whole record) once, with all it holds."""
        return self.held.groupBy("node_id").agg(F.first("kind").alias("kind"), F.first("children").alias("children"))

    @property
    def nodes(self) -> DataFrame:
        """(node_id, kind, children): each distinct object once, with the number of its children."""
        return self.held.select("node_id", "kind", F.size("children").alias("children")).distinct()

    @property
    def edges(self) -> DataFrame:
        """(parent_id, ordinal, name, at, kind, child_id, value), the bridge: what each object holds, in order. ``at`` holds the positions
        in the arrays between the two, outermost first. Scalars stand in ``value``; an array without elements has kind ``array``."""
        return self.objects.select(F.col("node_id").alias("parent_id"), F.posexplode("children").alias("ordinal", "x")).select("parent_id", "ordinal", "x.name", "x.at", "x.kind", "x.child_id", "x.value")


def merkle_tables(df: DataFrame, record: str, document: str) -> MerkleTables:
    """Turn JSON documents into related flat tables that keep every parent-child link.

    Each object gets the hash of its canonical content, built bottom-up; identical ones are stored once, and every occurrence is kept by
    the bridge rows that lead to it, with its positions in arrays, and by the row of its record. Numbers keep their digits. Parsing is one
    Arrow pass over the rows, written to the shared folder; repeats are dropped within a task before the shuffle. A null document has error
    ``null``, one that is no JSON ``invalid``; both have a row in ``roots`` only. Repeated records have a row each. Of a key that occurs
    twice in one object the last value counts. Other columns are ignored.
    """
    kind = df.schema[record].dataType
    edge = T.StructType([T.StructField("name", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("kind", T.StringType()), T.StructField("child_id", T.BinaryType()), T.StructField("value", T.StringType())])
    raw = T.StructType([T.StructField("t", T.StringType()), T.StructField("rec", kind), T.StructField("id", T.BinaryType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("children", T.ArrayType(edge))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(raw)
        inner = schema[5].type.value_type
        seen: set[bytes] = set()
        rows: list[tuple] = []
        inside: list[tuple] = []
        ends: list[int] = [0]

        def emit(d: bytes, is_object: bool, children: list) -> None:
            if d not in seen:
                seen.add(d)
                rows.append(("n", None, d, "object" if is_object else "array", None))
                inside.extend(children)
                ends.append(len(inside))

        def other(*row: object) -> None:
            rows.append(row)
            ends.append(len(inside))

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                fields = [inner[i] for i in range(inner.num_fields)]
                parts = [pa.array(c, f.type) for c, f in zip(zip(*inside) if inside else [[]] * len(fields), fields)]
                held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=fields))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*rows), schema)), held], schema=schema)
                rows.clear()
                inside.clear()
                del ends[1:]

        for b in batches:
            for rec, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v, error = None, None
                try:
                    v = read_json(text) if text is not None else None
                    error = "null" if text is None else None
                except RecursionError:
                    try:
                        v = parse_deep(text)
                    except ValueError:
                        error = "invalid"
                except ValueError:
                    error = "invalid"
                if error or (s := scalar(v)) is not None:
                    k, val = (None, error) if error else s
                    other("x" if error else "r", rec, None, k, val)
                else:
                    other("r", rec, identify(v, emit), "object" if isinstance(v, dict) else "array", None)
                if len(seen) > SEEN:
                    seen.clear()
                if len(rows) > 10_000 or len(inside) > 100_000:
                    yield from flush()
            yield from flush()

    made = store(df.select(F.col(f"`{record}`").alias("rec"), F.col(f"`{document}`").cast("string").alias("doc")).mapInArrow(build, raw), "merkle")
    bad = F.col("t") == "x"
    roots = made.filter(F.col("t").isin("r", "x")).select(F.col("rec").alias(record), "kind", F.col("id").alias("node_id"), F.when(~bad, F.col("value")).alias("value"), F.when(bad, F.col("value")).alias("error"))
    return MerkleTables(roots, made.filter("t = 'n'").select(F.col("id").alias("node_id"), "kind", "children"))


def _of(*names: str) -> Column:
    """The children of these names, those within arrays of arrays left out."""
    return F.filter("children", lambda x: x["name"].isin(*names) & (F.size(x["at"]) <= 1) & ~x["kind"].isin("null", "array"))


def _pos(x: Column) -> Column:
    return F.coalesce(F.try_element_at(x["at"], F.lit(1)), F.lit(0))


def task_children(tables: MerkleTables, record: str) -> DataFrame:
    """(record, task_pos, field, pos, val): the options, required Perl libraries and related tasks of every task, as child rows.

    Children are worked out once for each distinct task and then joined with the occurrences of that task. ``pos`` is the position in the
    field's array; a value that is no array counts as an array of one. Null or empty values, options with neither ``opt`` nor ``name`` and
    elements of other types than named give no row. A library list inside one ``requires`` element gives rows of the same ``pos``.

    An object's children travel in its row, so each of three joins looks up an object once: the tasks of a record, what the elements of a
    task's fields hold, and the children of an occurrence. Objects are cut down to the children asked for before they cross the network.
    """
    text = lambda x: x["value"].isNotNull() & (x["value"] != "")
    roots = tables.roots.filter("kind = 'object'").select(record, "node_id")
    has_tasks = F.exists("children", lambda x: x["name"] == "tasks")
    # a null or empty list of tasks is one, without a task; a record without the field is itself a task
    listed = tables.held.filter(has_tasks).select("node_id", F.transform(F.filter(_of("tasks"), lambda x: x["kind"] == "object"), lambda x: F.struct(_pos(x).alias("task_pos"), x["child_id"].alias("task_id"))).alias("l")).repartition("node_id").distinct()
    alone = F.array(F.struct(F.lit(0).alias("task_pos"), F.col("node_id").alias("task_id")))
    occurrences = roots.join(listed, "node_id", "left").select(record, F.explode(F.coalesce("l", alone)).alias("x")).select(record, "x.task_pos", "x.task_id")

    fields = tables.held.select(F.col("node_id").alias("task_id"), _of("options", "requires", "see_also").alias("c")).filter(F.size("c") > 0).repartition("task_id").distinct()
    elements = fields.select("task_id", F.explode("c").alias("x")).select("task_id", F.col("x.name").alias("field"), _pos(F.col("x")).alias("pos"), "x.kind", "x.child_id", "x.value")
    bare = elements.filter((F.col("field") != "requires") & (F.col("kind") == "string") & (F.col("value") != "")).select("task_id", "field", "pos", F.col("value").alias("val"))
    first = lambda name: F.try_element_at(F.filter("children", lambda x: (x["name"] == name) & (F.size(x["at"]) == 0) & text(x)), F.lit(1))["value"]
    libraries = F.transform(F.filter(_of("perl_lib"), lambda x: (x["kind"] != "object") & text(x)), lambda x: x["value"])
    told = tables.held.select(F.col("node_id").alias("child_id"), F.coalesce(first("opt"), first("name")).alias("name"), libraries.alias("libs")).filter(F.col("name").isNotNull() | (F.size("libs") > 0)).repartition("child_id").distinct()
    inside = elements.filter((F.col("field") != "see_also") & (F.col("kind") == "object")).select("task_id", "field", "pos", "child_id").join(told, "child_id")
    vals = F.when(F.col("field") == "requires", F.col("libs")).otherwise(F.array("name"))
    inside = inside.select("task_id", F.when(F.col("field") == "requires", "perl_lib").otherwise(F.col("field")).alias("field"), "pos", F.explode(vals).alias("val")).filter("val is not null")
    return occurrences.join(bare.unionByName(inside), "task_id").select(record, "task_pos", "field", "pos", "val")
