"""Trees, placements on trees, dichotomous keys and taxonomies. A tree is a table (node, parent, name, length, label, path)."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import store

TREE = "node int, parent int, name string, length double, label string, edge int, depth double, path array<int>"
_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(\[[^\]]*\])|(\{\d+\})|([(),:;])|([^\s(),:;\[\]{}']+))")


def parse_newick(text: str) -> list[tuple]:
    """Rows of a tree in the order of its text. Names may be quoted; ``{n}`` numbers an edge; ``[...]`` is a label. No recursion."""
    nodes: list[dict] = []
    at, stack, after_colon = 0, [], False

    def new(parent: int | None) -> int:
        nodes.append({"parent": parent, "name": None, "length": None, "label": None, "edge": None})
        return len(nodes) - 1

    cur = new(None)
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            break
        at = m.end()
        quoted, label, edge, mark, word = m.groups()
        if mark == "(":
            stack.append(cur)
            cur = new(cur)
        elif mark == ",":
            if not stack:
                raise ValueError("a comma outside brackets")
            cur, after_colon = new(stack[-1]), False
        elif mark == ")":
            if not stack:
                raise ValueError("brackets do not match")
            cur, after_colon = stack.pop(), False
        elif mark == ":":
            after_colon = True
        elif mark == ";":
            break
        elif label:
            nodes[cur]["label"] = label[1:-1]
        elif edge:
            nodes[cur]["edge"] = int(edge[1:-1])
        elif after_colon and word:
            nodes[cur]["length"], after_colon = float(word), False
        else:
            nodes[cur]["name"] = quoted[1:-1].replace("''", "'") if quoted else word
    if stack:
        raise ValueError("brackets do not match")
    out, depth, path = [], [], []
    for i, n in enumerate(nodes):
        p = n["parent"]
        depth.append((depth[p] if p is not None else 0.0) + (n["length"] or 0.0))
        path.append((path[p] if p is not None else []) + [i])
        out.append((i, p, n["name"], n["length"], n["label"], n["edge"], depth[i], path[i]))
    return out


def tree_table(spark: SparkSession, newick: str) -> DataFrame:
    return spark.createDataFrame(parse_newick(newick), TREE)


def to_newick(tree: list[tuple]) -> str:
    """Newick text of a tree's rows."""
    kids: dict[int | None, list] = {}
    for r in tree:
        kids.setdefault(r[1], []).append(r)
    done: dict[int, str] = {}
    for r in sorted(tree, key=lambda r: -r[0]):
        inner = "(" + ",".join(done[k[0]] for k in kids[r[0]]) + ")" if r[0] in kids else ""
        done[r[0]] = inner + (r[2] or "") + (f":{r[3]:g}" if r[3] is not None else "")
    return done[kids[None][0][0]] + ";"


def node_distances(pairs: DataFrame, tree: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b, ancestor, d): lowest common ancestor and path length of listed pairs of nodes, from the nodes' paths."""
    t = lambda n: tree.select(F.col("node").alias(n), F.col("path").alias(f"__p{n}"), F.col("depth").alias(f"__d{n}"))
    j = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).join(t("a"), "a").join(t("b"), "b")
    j = j.withColumn("ancestor", F.element_at(F.array_intersect("__pa", "__pb"), -1))
    up = tree.select(F.col("node").alias("ancestor"), F.col("depth").alias("__up"))
    return j.join(up, "ancestor").select("a", "b", "ancestor", (F.col("__da") + F.col("__db") - 2 * F.col("__up")).alias("d"))


def placement_distances(placements: DataFrame, tree: DataFrame, target: int) -> DataFrame:
    """(read, d): distance of each read's placement (read, edge_num, distal, pendant) to the node of edge ``target``: path between the nodes
    plus the pendant length, plus the distal length if the target lies above the placement's node, else minus it."""
    p = placements.join(tree.select(F.col("edge").alias("edge_num"), F.col("node").alias("a")), "edge_num")
    t = F.broadcast(tree.filter(F.col("edge") == target).select(F.col("node").alias("b"), F.col("path").alias("__pb"), F.col("depth").alias("__db")))  # one node
    j = p.crossJoin(t).join(tree.select(F.col("node").alias("a"), F.col("path").alias("__pa"), F.col("depth").alias("__da")), "a")
    j = j.withColumn("__c", F.element_at(F.array_intersect("__pa", "__pb"), -1)).join(tree.select(F.col("node").alias("__c"), F.col("depth").alias("__dc")), "__c")
    below = F.array_contains("__pb", F.col("a")) & (F.col("a") != F.col("b"))
    sign = F.when(below, -1).otherwise(1)
    return j.select("read", (F.col("__da") + F.col("__db") - 2 * F.col("__dc") + F.col("pendant") + sign * F.col("distal")).alias("d"))


def placement_counts(placements: DataFrame, dataset: str = r"^([^.]+)", normalise: str = "none", sizes: DataFrame | None = None) -> DataFrame:
    """(edge_num, dataset, n): placed reads of each edge and data set (first group of a pattern on the read); ``counts`` divides by the data
    set's sum, ``size`` by its size (dataset, size), ``norm`` by the mean over data sets of an edge."""
    n = F.sum(F.coalesce("multiplicity", F.lit(1.0))) if "multiplicity" in placements.columns else F.count(F.lit(1)).cast("double")
    c = placements.groupBy("edge_num", F.regexp_extract("read", dataset, 1).alias("dataset")).agg(n.alias("n"))
    if normalise == "counts":
        c = c.withColumn("n", F.col("n") / F.sum("n").over(Window.partitionBy("dataset")))
    elif normalise == "size":
        c = c.join(sizes, "dataset").withColumn("n", F.col("n") / F.col("size")).drop("size")
    elif normalise == "norm":
        c = c.withColumn("n", F.col("n") / F.avg("n").over(Window.partitionBy("edge_num")))
    return c


def collapse_counts(counts: DataFrame, tree: DataFrame, nodes: list[int]) -> DataFrame:
    """Counts with those of edges below a collapsed node (by edge number) given to that node; the highest one wins."""
    top = tree.filter(F.col("edge").isin(nodes)).select(F.col("node").alias("__c"), F.col("edge").alias("__e"))
    under = tree.select("edge", F.explode("path").alias("__c"), "path").join(F.broadcast(top), "__c")  # as many as nodes given
    first = under.groupBy("edge").agg(F.min_by("__e", F.array_position("path", F.col("__c"))).alias("__to"))
    return counts.join(first.withColumnRenamed("edge", "edge_num"), "edge_num", "left").groupBy(F.coalesce("__to", "edge_num").alias("edge_num"), "dataset").agg(F.sum("n").alias("n"))


def itol_lines(counts: DataFrame, names: DataFrame, datasets: list[str], colours: list[str], area: bool = False, largest: float = 1.0, old: bool = False) -> DataFrame:
    """(rank, value): lines of a pie-chart file for a tree viewer: a head, then for each edge with counts (edge_num, dataset, n) its name in
    ``names`` (edge_num, name), the radius and a count for each data set. The radius is the sum, or with ``area`` such that areas are in
    proportion, times the largest norm, cut to a whole number."""
    wide = counts.groupBy("edge_num").pivot("dataset", datasets).agg(F.sum("n"))
    cells = [F.coalesce(F.col(f"`{d}`"), F.lit(0.0)) for d in datasets]
    total = sum(cells[1:], cells[0])
    radius = ((2 * F.sqrt(total / F.lit(3.141592653589793)) if area else total) * largest).cast("long").cast("string")
    name = F.coalesce("name", F.col("edge_num").cast("string"))
    row = F.concat_ws("\t", name, F.concat(F.lit("R"), radius) if old else F.concat(F.lit("0.5\t"), radius), *[c.cast("string") for c in cells])
    rows = wide.join(names.select("edge_num", "name"), "edge_num", "left").select((F.col("edge_num").cast("long") + 100).alias("rank"), row.alias("value"))
    labels, tints = "\t".join(datasets), "\t".join(colours)
    head = ["LABELS\t" + labels, "COLORS\t" + tints] if old else ["DATASET_PIECHART", "SEPARATOR TAB", "DATASET_LABEL\tReadPlacement", "COLOR\t#1f2122", "FIELD_LABELS\t" + labels, "FIELD_COLORS\t" + tints, "DATA"]
    return counts.sparkSession.createDataFrame(list(enumerate(head)), "rank long, value string").unionByName(rows)


def key_newick(key: DataFrame, first: str = "1") -> str:
    """Newick text of a dichotomous key (a document): steps are inner nodes, conclusions tips. A key that runs in a circle raises ValueError."""
    steps: dict[str, list] = {}
    for r in key.select("step", "next", "terminal").collect():
        steps.setdefault(r["step"], []).append((r["next"], r["terminal"]))
    quoted = lambda n: "'" + n.replace("'", "''") + "'"
    done: dict[str, str] = {}
    todo: list[tuple[str, tuple]] = [(first, ())]
    while todo:
        step, above = todo.pop()
        if step in above:
            raise ValueError(f"the key runs in a circle at step {step}")
        below = [n for n, end in steps.get(step, []) if not end and n not in done]
        if below:
            todo += [(step, above), *((n, (*above, step)) for n in below)]
        else:
            done[step] = "(" + ",".join(quoted(n) if end else done[n] for n, end in steps.get(step, [])) + ")" + quoted(step)
    return done[first] + ";"


def classify(characters: DataFrame, key: DataFrame, first: str = "1", most_branches: int = 10_000) -> DataFrame:
    """(object, class): objects (object, character, state) led through a dichotomous key (step, character, state, next, terminal); ``*``
    matches any state, after the named ones. An object that no branch fits has a null class; so has one with a null state where asked.

    The key, a document of at most ``most_branches`` rows, is read by the driver, which finds its depth; one that runs in a circle raises
    ValueError. An object's characters are put together once; each level of the key is then a look-up without a shuffle."""
    rows = key.select("step", "character", "state", "next", "terminal").limit(most_branches + 1).collect()
    if len(rows) > most_branches:
        raise ValueError("a key of more branches than allowed")
    depth: dict[str, int] = {}
    todo: list[tuple[str, tuple[str, ...]]] = [(first, ())]
    while todo:
        step, above = todo.pop()
        if step in above:
            raise ValueError(f"the key runs in a circle at step {step}")
        if depth.get(step, -1) < len(above):
            depth[step] = len(above)
            todo += [(r["next"], (*above, step)) for r in rows if r["step"] == step and not r["terminal"]]
    spark = characters.sparkSession
    branches: dict[tuple[str, str], dict[str, tuple[str, bool]]] = {}
    for r in rows:
        if any(s == r["step"] and c != r["character"] for s, c in branches):
            raise ValueError(f"step {r['step']} asks for two characters")
        branches.setdefault((r["step"], r["character"]), {}).setdefault(r["state"], (r["next"], bool(r["terminal"])))
    flat = [(s, c, {k: {"next": n, "end": t} for k, (n, t) in b.items()}) for (s, c), b in branches.items()]
    table = F.broadcast(spark.createDataFrame(flat, "step string, c string, go map<string, struct<next: string, end: boolean>>"))
    one = characters.groupBy("object", "character").agg(F.min("state").alias("state"))
    at = one.groupBy("object").agg(F.map_from_entries(F.collect_list(F.struct("character", "state"))).alias("has"))  # as long as there are characters
    at = at.withColumn("step", F.lit(first)).withColumn("class", F.lit(None).cast("string"))
    for _ in range(max(depth.values(), default=0) + 1):
        j = at.join(table, "step", "left")
        state = F.try_element_at("has", F.col("c"))
        x = F.coalesce(F.try_element_at("go", state), F.when(state.isNotNull(), F.try_element_at("go", F.lit("*"))))
        at = j.select("object", "has", F.when(~x["end"], x["next"]).alias("step"), F.coalesce("class", F.when(x["end"], x["next"])).alias("class"))
    return at.select("object", "class")


def prune_close_tips(tree: list[tuple], least: float | None = None, quantile: float = 0.25, most_exact: int = 40_000, seed: int = 1) -> list[str]:
    """Names of the tips left once no two tips are closer than ``least`` (default: a quantile of the edge lengths). Of two close tips the one
    with the shorter edge goes. Above ``most_exact`` tips one of each pair of sister tips, drawn at random, is dropped first, until there are
    fewer. Goes on until no two are close, each round dropping one at least.

    A tree is small against the data; this runs on the driver in time linear in the tree for each round: the closest pair under every node
    is found from the nearest tip of its branches."""
    lengths = sorted(r[3] for r in tree if r[3] is not None)
    if least is None:
        at = (len(lengths) - 1) * quantile if lengths else 0
        lo = int(at)
        least = (lengths[lo] + (lengths[min(lo + 1, len(lengths) - 1)] - lengths[lo]) * (at - lo)) if lengths else 0.0
    parents = {r[1] for r in tree}
    alive = {r[0] for r in tree if r[0] not in parents}
    rows = sorted(tree, key=lambda r: -r[0])
    by = {r[0]: r for r in tree}
    rng = random.Random(seed)
    while True:
        near: dict[int, list[tuple[float, int]]] = {}
        drop: set[int] = set()
        used: set[int] = set()
        for r in rows:
            i, p, length = r[0], r[1], r[3] or 0.0
            mine = [(0.0, i)] if i in alive else sorted(near.pop(i, []))[:2]
            if len(mine) == 2 and i not in alive:
                (da, a), (db, b) = mine
                if (da + db < least or len(alive) > most_exact) and not {a, b} & used:
                    lose = rng.choice((a, b)) if len(alive) > most_exact else a if (by[a][3] or 0) <= (by[b][3] or 0) else b
                    drop.add(lose)
                    used |= {a, b}
                    mine = [m for m in mine if m[1] != lose]
            if p is not None:
                near.setdefault(p, []).extend((d + length, t) for d, t in mine)
        if not drop:
            break
        alive -= drop
    return sorted(by[i][2] or str(i) for i in alive)


def taxonomy_from_paths(paths: DataFrame, path: str = "path", rank: str = "rank", separator: str = ";") -> DataFrame:
    """(tax_id, parent_id, name, rank, full): nodes of a taxonomy given as paths of names; ids rise with the full path, the root is 1."""
    parts = F.filter(F.split(F.col(path), separator), lambda x: F.trim(x) != "")
    p = paths.select(parts.alias("a"), F.col(rank).alias("rank")).filter(F.size("a") > 0)
    pre = p.select("a", "rank", F.explode(F.sequence(F.lit(1), F.size("a"))).alias("k"))
    nodes = pre.select(F.array_join(F.slice("a", F.lit(1), F.col("k")), separator).alias("full"), F.when(F.col("k") > 1, F.array_join(F.slice("a", F.lit(1), F.col("k") - 1), separator)).alias("up"), F.element_at("a", F.col("k")).alias("name"), F.when(F.col("k") == F.size("a"), F.col("rank")).alias("rank"))
    nodes = nodes.groupBy("full", "up", "name").agg(F.max("rank").alias("rank"))
    ids = store(nodes.orderBy("full").select("*", F.monotonically_increasing_id().alias("m")), "taxa")
    dense = ids.withColumn("blk", F.shiftright("m", 33))
    offs = dense.groupBy("blk").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    num = dense.join(offs, "blk").select("full", "up", "name", "rank", (F.col("before") + F.col("m").bitwiseAND(2**33 - 1) + 2).alias("tax_id"))
    par = num.select(F.col("full").alias("up"), F.col("tax_id").alias("parent_id"))
    return num.join(par, "up", "left").select("tax_id", F.coalesce("parent_id", F.lit(1)).alias("parent_id"), "name", F.coalesce("rank", F.lit("no rank")).alias("rank"), "full")


#: Ranks of a taxonomy export that are called otherwise there (fixed values).
EXPORTED_RANKS = {"superkingdom": "no rank", "domain": "superkingdom", "major_clade": "no rank"}


def patched_paths(paths: DataFrame, patches: DataFrame, path: str = "path") -> DataFrame:
    """Paths with those listed in ``patches`` (path, instead) replaced."""
    p = patches.select(F.col("path").alias("__p"), F.col("instead").alias("__i")).dropDuplicates(["__p"])
    return paths.join(p, F.col(path) == F.col("__p"), "left").withColumn(path, F.coalesce("__i", path)).drop("__p", "__i")


def taxonomy_files(nodes: DataFrame, leaves: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lines (rank, value) of the files ``names``, ``nodes``, ``merged`` (empty), ``taxfile`` and, for reference sequences (seqname, tax_id),
    ``seqinfo`` of a taxonomy as of :func:`taxonomy_from_paths`, with its root."""
    spark = nodes.sparkSession
    root = spark.createDataFrame([(1, 1, "root", "no rank")], "tax_id long, parent_id long, name string, rank string")
    n = root.unionByName(nodes.select(F.col("tax_id").cast("long"), F.col("parent_id").cast("long").alias("parent_id"), "name", "rank"))
    other = F.create_map(*[F.lit(x) for pair in EXPORTED_RANKS.items() for x in pair])
    exported = F.coalesce(F.try_element_at(other, F.col("rank")), F.col("rank"))
    line = lambda *c: F.concat(F.concat_ws("\t|\t", *c), F.lit("\t|"))
    out = {
        "names": n.select("tax_id", line("tax_id", "name", F.lit(""), F.lit("scientific name")).alias("value")),
        "nodes": n.select("tax_id", line("tax_id", "parent_id", exported, F.lit(""), *[F.lit("0")] * 8, F.lit("")).alias("value")),
        "merged": n.limit(0).select("tax_id", F.lit("").alias("value")),
        "taxfile": n.select("tax_id", F.concat_ws("\t", "tax_id", "parent_id", "rank", "name").alias("value")),
    }
    if leaves is not None:
        quoted = [F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')) for c in ("seqname", "tax_id", "name")]
        out["seqinfo"] = leaves.select("seqname", F.col("tax_id").cast("long").alias("tax_id")).join(n.select("tax_id", "name"), "tax_id").select("tax_id", F.concat_ws(",", *quoted).alias("value"))
    return {k: v.withColumnRenamed("tax_id", "rank") for k, v in out.items()}


def contig_ranks(contigs: DataFrame, rank: str = "genus", lineage: str = "lineage") -> DataFrame:
    """(contig, taxon): a contig's taxon at the rank in ``<rank>name;...``, else ``Unclassified``."""
    name = F.regexp_extract(F.col(lineage), f"<{rank}>([^;]+)", 1)
    return contigs.select("contig", F.when(F.coalesce(name, F.lit("")) != "", name).otherwise("Unclassified").alias("taxon"))


def contigs_of_taxon(contigs: DataFrame, taxon: str, rank: str = r"[^>]+", lineage: str = "lineage") -> DataFrame:
    """Contigs whose lineage holds ``<rank>taxon``; any rank by default."""
    return contigs.filter(F.col(lineage).rlike(f"<{rank}>{re.escape(taxon)}(;|$)"))


def lineage_table(lineages: DataFrame, ranks: list[str], id_col: str = "id") -> DataFrame:
    """One row for each id with a column for each rank, from (id, rank, name)."""
    return lineages.groupBy(id_col).pivot("rank", ranks).agg(F.min("name"))
