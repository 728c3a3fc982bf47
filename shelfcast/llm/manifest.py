"""Merkle manifest of a dataset by cogrouped subtree exchange (operator 11).

Every row is a leaf.  Per group (``lang``) the leaves, in ascending order,
form a tree of runs of 8; the groups' subroots form another one up to the root.

1. Positions without a global sort: leaves are range-partitioned by (group,
   order) and written with their partition number, counts per (group,
   partition) give offsets, rows are ranked inside their partition only.
2. Upwards: ``8 ** SPAN`` consecutive nodes are a *superblock*; a task reduces
   one superblock to one node.  The nodes of all superblocks are the next
   layer, until each group has one node.  Rows shrink 512 times per layer.
3. Downwards, layer by layer: a superblock's nodes are cogrouped with the
   *outer nodes* that it needs (the siblings from its own root up to the root,
   one short row).  The same ``applyInPandas`` call reduces the superblock
   again, joins the inner and outer siblings to a proof and folds each claimed
   leaf up to the root.

No task holds more than one superblock and its outer nodes, whatever share of
the rows one group has.

Edge cases: a null value enters its leaf as ``-``, an empty text as ``0:``;
rows with a null group are a group of their own, the first; a null id sorts
first and is never tampered with; rows with equal ids are ordered by their
leaves, and repeated rows are separate leaves; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import read_table, staged

RUN = 8          # children of a node
SPAN = 3         # levels that a superblock spans: 512 nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.encode(F.concat(*[field(v) for v in values]), "UTF-8"), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (0-based, in ascending ``order``) and ``n`` of each group; no task ranks more than one range.

    ``rows`` has to be read from a table: its last tie-breaker is the row's place in the scan.
    """
    ranges = staged(rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(group, *order, "_place")
                    .withColumn("_part", F.spark_partition_id()), "manifest-ranges")
    by_part = Window.partitionBy(group).orderBy("_part")
    offsets = ranges.groupBy(group, "_part").agg(F.count("*").alias("_rows")).select(
        group, "_part", F.coalesce(F.sum("_rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    inside = Window.partitionBy(group, "_part").orderBy(*order, "_place")
    return (ranges.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, [group, "_part"])
            .select(*rows.columns, (F.col("_before") + F.col("_rank")).cast("long").alias("pos"), F.col("n").cast("long").alias("n")))


def levels_of(nodes: list[str], total: int, span: int) -> list[list[str]]:
    """The levels of one superblock: ``nodes`` and what they reduce to, while several of the ``total`` nodes of a level remain."""
    levels = [nodes]
    while len(levels) <= span and total > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + RUN])) for i in range(0, len(last), RUN)])
        total = -(-total // RUN)
    return levels


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """(nodes before, nodes after) in the run of node ``i``, level by level below the superblock's root."""
    found = []
    for level in levels[:-1]:
        run = i - i % RUN
        found.append(("".join(level[run:i]), "".join(level[i + 1:run + RUN])))
        i //= RUN
    return found


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


def _text(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def _path(text: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


def _blocks(nodes: DataFrame, span: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", 3 * span))


def _reduced(nodes: DataFrame, span: int) -> DataFrame:
    """One node per superblock: the next layer (grp, pos, n, node)."""
    width = RUN ** span

    def reduce(key, rows):
        n = int(rows["n"].iloc[0])
        levels = levels_of(rows.sort_values("pos")["node"].tolist(), n, span)
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "n": [-(-n // width)], "node": [levels[-1][0]]})

    return _blocks(nodes.select("grp", "pos", "n", "node"), span).groupBy("grp", "block").applyInPandas(
        reduce, "grp string, pos long, n long, node string")


def _layers(nodes: DataFrame, span: int) -> list[DataFrame]:
    """The given layer and those above it, until every group has one node."""
    layers = [nodes]
    while (layers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        layers.append(staged(_reduced(layers[-1], span), "manifest-layer"))
    return layers


def _descended(nodes: DataFrame, outer: DataFrame, span: int, schema: str, finish: Callable) -> DataFrame:
    """Cogroup a layer's superblocks with their outer nodes; ``finish(rows, proofs, outer_row)`` makes the result rows."""

    def run(inner, above):
        inner = inner.sort_values("pos")
        above = above.iloc[0]
        levels = levels_of(inner["node"].tolist(), int(inner["n"].iloc[0]), span)
        rest = _path(above["path"])
        return finish(inner, [siblings(levels, i) for i in range(len(inner))], rest, above)

    return (_blocks(nodes, span).groupBy("grp", "block")
            .cogroup(outer.select("grp", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("grp", "block"))
            .applyInPandas(run, schema))


_OUTER = "grp string, pos long, path string, subroot string, root string"


def _outer_rows(inner, proofs, rest, above) -> pd.DataFrame:
    return pd.DataFrame({"grp": inner["grp"].values, "pos": inner["pos"].values, "path": [_text(p + rest) for p in proofs],
                         "subroot": above["subroot"], "root": above["root"]})


def _outer_of(layers: list[DataFrame], top: DataFrame, span: int) -> DataFrame:
    """Outer nodes of every node of ``layers[1]``, from those of the top layer downwards."""
    outer = top
    for layer in layers[-2:0:-1]:
        outer = staged(_descended(layer, outer, span, _OUTER, _outer_rows), "manifest-outer")
    return outer


def manifest(leaves: DataFrame, span: int = SPAN, proofs: bool = False) -> DataFrame:
    """Leaves (id, grp, leaf, claim) with subroot, root, proof digest and the root that the claimed leaf folds to.

    ``id`` is any sortable column and returns as it is, ``grp`` a group name (null: the first group), ``leaf`` the leaf in
    the tree, ``claim`` the leaf to be verified against it.  ``proofs=True`` adds the proof itself: per level the siblings
    before and after the node.
    """
    rows = leaves.select("id", F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")).alias("grp"), F.col("leaf").alias("node"),
                         F.when(F.col("claim") != F.col("leaf"), F.col("claim")).alias("claim"))
    nodes = staged(ranked(staged(rows, "manifest-leaves"), "grp", ["id", "node"]), "manifest-positions")
    layers = _layers(nodes, span)
    # the subroots are the leaves of one more tree, with one group
    subroots = staged(layers[-1].select("grp", "node"), "manifest-subroots")
    tree = staged(ranked(subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "node"), "all", ["name"])
                  .withColumnRenamed("all", "grp"), "manifest-groups")
    upper = _layers(tree, span)
    top = upper[-1].select("grp", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    above = _outer_of(upper, top, span)

    def names(inner, proofs, rest, over):
        return pd.DataFrame({"grp": inner["name"].values, "pos": 0, "path": [_text(p + rest) for p in proofs],
                             "subroot": inner["node"].values, "root": over["root"]})

    per_group = _descended(tree, above, span, _OUTER, names)
    outer = _outer_of(layers, staged(per_group, "manifest-outer"), span)

    def finish(inner, inner_proofs, rest, over):
        folded, outer_siblings = {}, [a + b for a, b in rest]
        hashes, ends, texts = [], [], []
        for node, claim, proof in zip(inner["node"], inner["claim"], inner_proofs):
            hashes.append(digest("".join([a + b for a, b in proof] + outer_siblings)))
            end = fold(claim if isinstance(claim, str) else node, proof)
            if end not in folded:
                folded[end] = fold(end, rest)
            ends.append(folded[end])
            if proofs:
                texts.append(_text(proof + rest))
        out = pd.DataFrame({"pos": inner["pos"].values, "grp": inner["grp"].values, "leaf": inner["node"].values, "subroot": over["subroot"],
                            "root": over["root"], "proof_sha256": hashes, "folded_root": ends, "id": inner["id"].values})
        if proofs:
            out["proof"] = texts
        return out

    kind = leaves.schema["id"].dataType
    # ids travel as text: pandas would turn integers next to a null into floating point
    schema = "pos long, grp string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, id string"
    found = _descended(nodes.withColumn("id", F.col("id").cast("string")), outer, span, schema + ", proof string" * proofs, finish)
    found = found.withColumn("id", F.col("id").cast(kind)).withColumn("verified", F.col("folded_root") == F.col("root"))
    if proofs:
        found = found.withColumn("proof", F.transform(F.filter(F.split("proof", ";"), lambda x: x != ""), lambda x: F.struct(
            F.split(x, ",")[0].alias("before"), F.split(x, ",")[1].alias("after"))))
    return found.withColumn("grp", F.expr("CASE WHEN grp <> '' THEN substr(grp, 2) END"))


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves of ``documents``; where ``tampered`` holds, the claimed leaf is that of the lower-cased text."""
    values = [F.col(c) for c in FIELDS]
    lowered = leaf([*values[:-1], F.translate("text", _UPPER, _UPPER.lower())])
    tampered = F.lit(False) if tampered is None else tampered
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("grp"), leaf(values).alias("leaf"),
                       F.when(tampered, lowered).otherwise(leaf(values)).alias("claim"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    third = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, F.lit(False))
    return manifest(document_leaves(docs, third)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle_sql(levels: int = 8) -> str:
    """DuckDB SQL for groups of up to ``8 ** levels`` rows (one level is one step)."""
    def enc(c):
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    plain = " || ".join(enc(c) for c in FIELDS)
    lower = " || ".join(enc(c if c != "text" else f"translate(text, '{_UPPER}', '{_UPPER.lower()}')") for c in FIELDS)
    # DuckDB has no crc32: it is computed bit by bit over the digits of the id
    crc = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), "
           "lambda i: ascii((doc_id::VARCHAR)[i:i])::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), "
           "lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))")
    parts = [f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({plain}) AS leaf, "
             f"CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN sha256({lower}) ELSE sha256({plain}) END AS claim FROM documents)",
             "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
             "a0 AS (SELECT g, pos, leaf AS h FROM p)"]

    def climb(prefix, steps):
        for k in range(steps):
            parts.append(f"""{prefix}s{k} AS (SELECT g, pos, h, count(*) OVER (PARTITION BY g) AS n,
              coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
              coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f
              FROM {prefix}{k})""")
            parts.append(f"""{prefix}{k + 1} AS (SELECT g, pos // 8 AS pos,
              CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h
              FROM {prefix}s{k} GROUP BY g, pos // 8)""")

    def up(prefix, steps, start, source, at, group):
        for k in range(steps):
            parts.append(f"""{start}{k + 1} AS (SELECT x.* REPLACE (
              CASE WHEN s.n > 1 THEN proof || s.b || s.f ELSE proof END AS proof,
              CASE WHEN s.n > 1 THEN sha256(s.b || node || s.f) ELSE node END AS node)
              FROM {source if k == 0 else start + str(k)} x JOIN {prefix}s{k} s ON s.g = x.{group} AND s.pos = x.{at} // {8 ** k})""")

    climb("a", levels)
    parts.append(f"r AS (SELECT g AS name, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS gpos FROM a{levels})")
    parts.append("b0 AS (SELECT '' AS g, gpos AS pos, subroot AS h FROM r)")
    climb("b", 3)
    parts.append("u AS (SELECT p.*, r.subroot, r.gpos, '' AS allg, '' AS proof, p.claim AS node FROM p JOIN r ON r.name = p.g)")
    up("a", levels, "v", "u", "pos", "g")
    up("b", 3, "w", f"v{levels}", "gpos", "allg")
    return ("WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, (SELECT h FROM b3) AS root, sha256(proof) AS proof_sha256, "
            "node AS folded_root, node = (SELECT h FROM b3) AS verified FROM w3")


ORACLE_SQL = oracle_sql()
