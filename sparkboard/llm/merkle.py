"""Merkle manifest of a dataset, reduced by superblocks.

Every row is a leaf; a source's leaves, in order of id, form a tree, and the roots of
the trees, in order of source, one more. Leaves are numbered by a distributed sort, and
those of equal ``index // fanout**k`` form a superblock: one group of ``applyInPandas``
collapses k levels of it into one node. The nodes are superblocked again until each
tree is one node. Proofs come back down: a block's own levels are made again beside the
proof that the block above it has, so only nodes and one proof for each block are
shuffled, and no group holds more than ``fanout**k`` rows, whatever source they are of.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import ranked
from .shared import written

FANOUT, LEVELS = 3, 6
HEX = 64
_NODES = "tree long, place long, n long, digest binary"
_PATHS = "tree long, place long, path string, subroot string, root string, above string, source_place long, sources long"


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the value's UTF-8 length, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def collapsed(digests: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of a run of digests at each level, from the digests themselves on."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([_h("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return out


def height(n: int, most: int, fanout: int = FANOUT) -> int:
    """Levels from n nodes to one, ``most`` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // fanout), levels + 1
    return levels


def paths(levels: list[list[str]], above: str, fanout: int = FANOUT) -> list[str]:
    """The proof of each digest of the lowest level: its siblings, level by level, then ``above``."""
    have = [above] * len(levels[-1])
    for nodes in reversed(levels[:-1]):
        down = []
        for i in range(len(nodes)):
            run = i - i % fanout
            down.append("".join(nodes[run:i] + nodes[i + 1 : run + fanout]) + have[i // fanout])
        have = down
    return have


def folded(digest: str, place: int, n: int, path: str, fanout: int = FANOUT) -> str:
    """The root that a digest at ``place`` of ``n`` leads to by its proof."""
    at = 0
    while n > 1:
        own = place % fanout
        size = min(fanout, n - (place - own))
        mid, end = at + HEX * own, at + HEX * (size - 1)
        digest = _h(path[at:mid] + digest + path[mid:end])
        at, place, n = end, place // fanout, -(-n // fanout)
    return digest


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / FANOUT**levels).cast("long").alias("block")


def _hexed(pdf: pd.DataFrame, column: str = "digest") -> list[str]:
    return [bytes(x).hex() for x in pdf[column]]


def _reduce(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes ``levels`` levels up, or the root of a tree that has fewer."""

    def collapse(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        n = int(pdf["n"].iloc[0])
        up = height(n, levels)
        (top,) = collapsed(_hexed(pdf), up)[-1]
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "n": [-(-n // FANOUT**up)], "digest": [bytes.fromhex(top)]})

    return nodes.select("tree", "place", "n", "digest", _block(levels)).groupBy("tree", "block").applyInPandas(collapse, _NODES)


def _built(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """The nodes of each superblock level, the last one a root for each tree."""
    out = [nodes]
    while largest > 1:
        out.append(written(_reduce(out[-1], levels), "merkle"))
        largest = -(-largest // FANOUT**levels)
    return out


def _lowered(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The proof of each of ``nodes``, from the proofs of the nodes that their blocks became."""

    def lower(key: tuple, pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        found = collapsed(_hexed(pdf), height(int(pdf["n"].iloc[0]), levels))
        rest = up.iloc[0]
        out = pd.DataFrame({"tree": key[0], "place": pdf["place"], "path": paths(found, rest["path"])})
        for c in ("subroot", "root", "above", "source_place", "sources"):
            out[c] = rest[c]
        return out

    left = nodes.select("tree", "place", "n", "digest", _block(levels)).groupBy("tree", "block")
    right = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(lower, _PATHS)


def _proved(leaves: DataFrame, above: DataFrame, levels: int, kind: str) -> DataFrame:
    """Of each leaf: what its proof hashes to, and the root that the changed leaf leads to by it."""

    def prove(pdf: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        digests, n, rest = _hexed(pdf), int(pdf["n"].iloc[0]), up.iloc[0]
        proofs = paths(collapsed(digests, height(n, levels)), rest["path"])
        out = []
        for own, changed, place, path in zip(digests, pdf["changed"], pdf["place"].tolist(), proofs, strict=True):
            now = own if changed is None else bytes(changed).hex()
            subroot = folded(now, place, n, path)
            out.append((_h(path + rest["above"]), folded(subroot, int(rest["source_place"]), int(rest["sources"]), rest["above"])))
        proof, root = zip(*out, strict=True)
        frame = {"doc_id": pdf["doc_id"], "leaf": digests, "subroot": rest["subroot"], "root": rest["root"], "proof_sha256": proof, "folded_root": root}
        return pd.DataFrame(frame)

    left = leaves.withColumn("block", _block(levels)).groupBy("tree", "block")
    right = above.withColumnRenamed("place", "block").groupBy("tree", "block")
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return left.cogroup(right).applyInPandas(prove, schema)


def manifest(documents: DataFrame, leaf: Column, changed: Column | None = None, key: str = "doc_id", group: str = "source", levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    ``leaf`` is the digest (hex) that a row goes into the tree with, ``changed`` the one that it
    is found with later (null: the same). Leaves of a group stand in order of ``key``, nulls
    first; rows of the same key in order of both digests, so repeated rows are leaves of
    their own. Groups stand in UTF-8 order, the null group first. A group of one row is its leaf.
    The proof is of the leaf as it was; ``folded_root`` follows it from the leaf as it is.

    Null and empty values and texts of any length only change a digest; other columns play no
    part, whatever their names. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(10 * FANOUT**levels))
    other = F.lit(None).cast("string") if changed is None else changed
    names = [F.col(f"`{key}`").alias("doc_id"), F.col(f"`{group}`").cast("string").alias("source")]
    rows = documents.select(*names, F.unhex(leaf).alias("digest"), F.unhex(other).alias("changed"))
    rows = written(rows.withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed"))), "leaves")
    kind = dict(rows.dtypes)["doc_id"]
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    sources = written(ranked(counts, ["source"], name="tree").withColumnRenamed("source", "source_"), "sources")
    largest, n_sources = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    placed = ranked(rows, ["doc_id", "digest", "changed"], ["source"], name="place").withColumn("place", F.col("place") - 1)
    leaves = placed.join(sources, F.col("source").eqNullSafe(F.col("source_")))
    leaves = written(leaves.select("tree", "place", "n", "digest", "changed", "doc_id"), "leaves")
    trees = _built(leaves, largest, levels)
    last = trees[-1].select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), F.lit(n_sources).cast("long").alias("n"), "digest")
    tops = _built(last, n_sources, levels)
    here = {"text": F.lit(""), "zero": F.lit(0).cast("long"), "sources": F.lit(n_sources).cast("long")}
    start = [here["text"].alias("path"), here["text"].alias("subroot"), F.lower(F.hex("digest")).alias("root"), here["text"].alias("above")]
    up = tops[-1].select("tree", "place", *start, here["zero"].alias("source_place"), here["sources"].alias("sources"))
    for nodes in reversed(tops[:-1]):
        up = _lowered(nodes, up, levels)
    # a source's root starts its own tree's proofs, with what lies above it set apart
    roots = trees[-1].select(F.col("tree").alias("own_tree"), F.lower(F.hex("digest")).alias("own"))
    joined = up.join(roots, F.col("place") + 1 == F.col("own_tree"))
    above = [F.col("own").alias("subroot"), "root", F.col("path").alias("above"), F.col("place").alias("source_place"), "sources"]
    up = written(joined.select(F.col("own_tree").alias("tree"), here["zero"].alias("place"), here["text"].alias("path"), *above), "proofs")
    for nodes in reversed(trees[1:-1]):
        up = _lowered(nodes, up, levels)
    return _proved(leaves, up, levels, kind).withColumn("verified", F.col("folded_root") == F.col("root"))


def documents_manifest(documents: DataFrame) -> DataFrame:
    """The manifest of ``documents``; of every row whose id has an even CRC-32 the line feeds of the text are lost later."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    lost = (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0) & F.contains(text, F.lit("\n"))
    return manifest(documents, leaf_digest(*fields, text), F.when(lost, leaf_digest(*fields, F.replace(text, F.lit("\n"), F.lit("")))))
