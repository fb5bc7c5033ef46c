"""Merkle manifest of a dataset: a hash tree per group of rows and one over the groups.

Leaves of a group ascend by id and are cut into runs of ``ARITY ** HEIGHT`` consecutive ones. A task
builds the tree of one run, so a group of any size is climbed in layers, and only the run's root moves
on to the next layer. Going down, every run gets the way from its root to the root of all. A parent
keeps a copy of its SHA-256 state before each child slot; folding a changed leaf resumes the state
before its slot with the replacement and hashes the siblings right of it only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import stored
from matchlens.operators.ordered import ranked

ARITY, HEIGHT = 2, 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEPS = "array<struct<left:string,right:string>>"


def record_hash(*cols: Column) -> Column:
    """Hex SHA-256 of the values in order: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in cols]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _fold(states: list, right: list[bytes], slot: int, digest: bytes) -> bytes:
    """A parent's digest after a change of one child: the state before its slot, resumed."""
    state = states[slot].copy()
    state.update(digest)
    for sibling in right:
        state.update(sibling)
    return state.hexdigest().encode()


class Run:
    """The tree over consecutive nodes; every parent with its children and the states before their slots."""

    def __init__(self, digests: list[bytes], arity: int, height: int):
        self.arity, self.levels = arity, []
        for _ in range(height):
            parents, above = [], []
            for at in range(0, len(digests), arity):
                children, state, states = digests[at : at + arity], hashlib.sha256(), []
                for child in children:
                    states.append(state.copy())
                    state.update(child)
                parents.append((children, states))
                above.append(state.hexdigest().encode())
            self.levels.append(parents)
            digests = above
        self.root = digests[0]

    def steps(self, i: int) -> list[tuple[bytes, bytes]]:
        """The siblings left and right of node `i` and of its ancestors in the run, from below."""
        out = []
        for level in self.levels:
            i, slot = divmod(i, self.arity)
            children = level[i][0]
            out.append((b"".join(children[:slot]), b"".join(children[slot + 1 :])))
        return out

    def fold(self, i: int, digest: bytes) -> bytes:
        """The run's root with node `i` replaced by `digest`."""
        for level in self.levels:
            i, slot = divmod(i, self.arity)
            children, states = level[i]
            digest = _fold(states, children[slot + 1 :], slot, digest)
        return digest


def _height(n: int, arity: int, height: int) -> int:
    """Levels that a run of a group of `n` nodes climbs: all of them, or as many as leave one node."""
    levels, reach = 0, 1
    while reach < n and levels < height:
        levels, reach = levels + 1, reach * arity
    return levels


def _run_of(nodes: pa.Table, digest: str, arity: int, height: int) -> tuple[pa.Table, Run]:
    nodes = nodes.sort_by("i")
    levels = _height(nodes.column("n")[0].as_py(), arity, height)
    return nodes, Run([d.encode() for d in nodes.column(digest).to_pylist()], arity, levels)


def _climb(nodes: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Layers of (grp, i, n, digest) from `nodes` up to one node in every group; n counts the group's nodes."""
    size, layers = arity**height, [nodes]

    def work(key: tuple, table: pa.Table) -> pa.Table:
        _, run = _run_of(table, "digest", arity, height)
        n = -(-table.column("n")[0].as_py() // size)
        return pa.table({"grp": [key[0].as_py()], "i": [key[1].as_py()], "n": [n], "digest": [run.root.decode()]})

    while (layers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        below = layers[-1].select("grp", "i", "n", "digest", F.floor(F.col("i") / size).alias("run"))
        layers.append(stored(below.groupBy("grp", "run").applyInArrow(work, "grp string, i long, n long, digest string"), "layer"))
    return layers


def _descend(layers: list[DataFrame], ways: DataFrame, arity: int, height: int) -> DataFrame:
    """(grp, i, subroot, root, steps) for the nodes of the lowest of `layers`, given those of the topmost nodes."""
    size = arity**height
    way = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    kinds = pa.schema([("grp", pa.string()), ("i", pa.int64()), ("subroot", pa.string()), ("root", pa.string()), ("steps", way)])

    def work(key: tuple, nodes: pa.Table, way: pa.Table) -> pa.Table:
        nodes, run = _run_of(nodes, "digest", arity, height)
        above, subroot, root = (way.column(c)[0].as_py() for c in ("steps", "subroot", "root"))
        at = nodes.column("i").to_pylist()
        steps = [[{"left": a.decode(), "right": b.decode()} for a, b in run.steps(i % size)] + above for i in at]
        return pa.table(
            {"grp": [key[0].as_py()] * len(at), "i": at, "subroot": [subroot] * len(at), "root": [root] * len(at), "steps": steps},
            schema=kinds,
        )

    for layer in reversed(layers[:-1]):
        nodes = layer.select("grp", "i", "n", "digest", F.floor(F.col("i") / size).alias("run")).groupBy("grp", "run")
        ways = stored(
            nodes.cogroup(ways.groupBy("grp", "i")).applyInArrow(work, f"grp string, i long, subroot string, root string, steps {STEPS}"), "ways"
        )
    return ways


def verify(
    docs: DataFrame, edits: dict[str, Column] | None = None, id_col: str = "doc_id", group: str = "lang", fields: list[str] | None = None,
    arity: int = ARITY, height: int = HEIGHT,
) -> DataFrame:
    """One row per row of `docs`: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``leaf`` is the `record_hash` of `fields`; a group's leaves ascend by id, then by leaf, nulls
    first, and fold `arity` at a time into ``subroot``; groups ascend, the null one first, and fold
    into ``root``. ``folded_root`` climbs from the leaf of the edited row (`edits` names the columns
    that differ) past the original siblings; ``verified`` says whether it is the root.
    ``proof_sha256`` hashes these siblings, level by level, left to right. A group of one row has
    its leaf as subroot; a lone group's subroot is the root; without siblings the proof is the hash
    of nothing. Repeated rows are leaves of their own; null and empty values differ. Other columns
    play no part. An empty table gives an empty one.
    """
    fields = fields or FIELDS
    now = {c: F.col(f"`{c}`") for c in fields}
    leaf = record_hash(*now.values())
    edited = record_hash(*[(edits or {}).get(c, now[c]) for c in fields]) if edits else leaf
    marked = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("")).alias("grp"),  # null first, then bytewise
        leaf.alias("leaf"), edited.alias("edited"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = stored(marked, "leaves")  # with the tie written down, equal rows keep their order in every later job
    placed = ranked(leaves, ["id", "leaf", "tie"], ["grp"], "i", "n").withColumn("i", F.col("i") - 1)
    placed = stored(placed.withColumnRenamed("leaf", "digest").drop("tie"), "placed")

    layers = _climb(placed, arity, height)
    subroots = layers[-1].select(F.lit("all").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("digest"))
    tops = stored(ranked(subroots, ["name"], ["grp"], "i", "n").withColumn("i", F.col("i") - 1), "subroots")
    above = _climb(tops, arity, height)
    none = F.from_json(F.lit("[]"), STEPS)
    root = above[-1].select("grp", "i", F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"), none.alias("steps"))
    ways = _descend(above, root, arity, height)
    ways = tops.join(ways.drop("grp", "subroot"), "i").select(
        F.col("name").alias("grp"), F.lit(0).cast("long").alias("i"), F.col("digest").alias("subroot"), "root", "steps"
    )
    ways = stored(ways, "ways")
    # the leaves' own runs: the way of a run is one row, its leaves fold past it in the same task
    size = arity**height
    runs = _descend(layers[1:], ways, arity, height) if layers[1:] else ways

    def work(key: tuple, table: pa.Table, way: pa.Table) -> pa.Table:
        table, run = _run_of(table, "digest", arity, height)
        subroot, root = way.column("subroot")[0].as_py(), way.column("root")[0].as_py()
        steps = [(s["left"].encode(), s["right"].encode()) for s in way.column("steps")[0].as_py()]
        kept = [hashlib.sha256(left) for left, _ in steps]  # the states before the slots on the way, resumed for every leaf
        proofs, folded = [], []
        for i, new in zip(table.column("i").to_pylist(), table.column("edited").to_pylist(), strict=True):
            proof = hashlib.sha256()
            for left, right in [*run.steps(i % size), *steps]:
                proof.update(left)
                proof.update(right)
            proofs.append(proof.hexdigest())
            digest = reduce(lambda d, s: _fold([s[0]], [s[1][1]], 0, d), zip(kept, steps, strict=True), run.fold(i % size, new.encode()))
            folded.append(digest.decode())
        n = table.num_rows
        return pa.table({
            "id": table.column("id"), "leaf": table.column("digest"), "subroot": [subroot] * n, "root": [root] * n,
            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded],
        })

    kind = leaves.schema["id"].dataType.simpleString()
    rows = placed.withColumn("run", F.floor(F.col("i") / size)).groupBy("grp", "run").cogroup(runs.groupBy("grp", "i"))
    out = rows.applyInArrow(
        work, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )
    return out.withColumnRenamed("id", id_col)
