"""Merkle manifest of a dataset, with the proof of every row.

Leaves are ranked inside their partition (``lang``) without any window over it. A node of the
tree is labelled by the interval [lo, hi] of the leaf ranks that it covers; level ``k`` is
bucketed by ``lo div fanout^k``, so a child meets its parent by an equi-join on partition, level and
bucket that is checked by containment. Within a parent, the children that lie in the
parent's interval less the own one are the siblings: those before are the left part of a
proof, those after the right part.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscope.operators.ranks import with_positions
from corpuscope.session import cut_lineage

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated strings."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(fields: dict[str, Column] | None = None) -> Column:
    own = fields or {}
    return digest(*(encoded(own.get(f, F.col(f))) for f in FIELDS))


def tampered_text() -> Column:
    """A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", ascii_uppercase, ascii_lowercase)).otherwise(F.col("text"))


def climb(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels above ``leaves`` (``grp, n, lo, hi, digest``), lowest first: the same columns, ``bucket`` and the children ``kids``.

    A group of ``n`` leaves ends at the first level where one node covers it; one with a single leaf has no level.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, current, width = [], leaves, 1
    while width < most:
        below, width = width, width * fanout
        current = cut_lineage(
            current.where(F.col("n") > below).groupBy("grp", "n", F.floor(F.col("lo") / width).alias("bucket"))
            .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("kids"))
            .withColumn("digest", F.sha2(F.array_join(F.col("kids.digest"), ""), 256)))
        levels.append(current)
    return levels


def roots(leaves: DataFrame, levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """``grp, digest`` of each group's only top node."""
    found = leaves.where("n = 1").select("grp", "digest")
    for k, level in enumerate(levels):
        found = found.unionByName(level.where(F.col("n") <= fanout ** (k + 1)).select("grp", "digest"))
    return found


def descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``leaves`` with the columns of ``above`` (``grp, path, ...``: what stands over each group's root), ``path`` grown
    to one (before, after) pair of sibling digests a level, lowest level first."""
    carried = [c for c in above.columns if c not in ("grp", "path")]
    parents = None
    for k in range(len(levels), -1, -1):
        nodes = levels[k - 1] if k else leaves
        tops = nodes.where((F.col("n") <= fanout ** k) & (F.col("n") > (fanout ** (k - 1) if k else 0)))
        out = tops.join(above, "grp")
        if parents is not None:
            width = fanout ** (k + 1)
            up = parents.select(F.col("grp").alias("p_grp"), F.col("bucket").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                                F.col("kids").alias("p_kids"), "path", *carried)
            inner = nodes.where(F.col("n") > fanout ** k).join(
                up, (F.col("grp") == F.col("p_grp")) & (F.floor(F.col("lo") / width) == F.col("p_bucket"))
                & (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi")))
            lo, hi = F.col("lo"), F.col("hi")
            before = F.array_join(F.filter("p_kids", lambda s: s["hi"] < lo)["digest"], "")
            after = F.array_join(F.filter("p_kids", lambda s: s["lo"] > hi)["digest"], "")
            step = F.struct(before.alias("before"), after.alias("after"))
            inner = inner.withColumn("path", F.concat(F.array(step), F.col("path"))).select(out.columns)
            out = out.unionByName(inner)
        parents = out
    return parents


def leaf_table(docs: DataFrame) -> DataFrame:
    """One leaf a row: ``doc_id, lang, leaf, tampered, grp, n, lo, hi, digest``; the texts are read once and not shuffled.

    Leaves of a ``lang`` ascend by doc_id (null first), rows of one doc_id by their digest.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("grp"),
        row_digest().alias("digest"), row_digest({"text": tampered_text()}).alias("tampered"))
    rows = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id()))  # equal rows are interchangeable
    ranked = with_positions(rows, ["grp"], [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")], "lo", total="n")
    lo = F.col("lo") - 1
    return ranked.select("doc_id", "lang", "grp", "n", lo.alias("lo"), lo.alias("hi"), "digest", "tampered")


def upper_tree(found: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``grp, path, subroot, root``: the tree over the groups' roots, null lang first, then bytewise."""
    ranked = with_positions(found.select(F.lit("").alias("all"), "grp", "digest"), ["all"], ["grp"], "lo", total="n")
    lo = F.col("lo") - 1
    leaves = cut_lineage(ranked.select(F.col("all").alias("grp"), F.col("grp").alias("own"), "n", lo.alias("lo"), lo.alias("hi"), "digest"))
    levels = climb(leaves, fanout)
    top = roots(leaves, levels, fanout).select("grp", F.array().cast(_PATH).alias("path"), F.col("digest").alias("root"))
    return descend(leaves, levels, top, fanout).select(F.col("own").alias("grp"), "path", F.col("digest").alias("subroot"), "root")


def tree_nodes(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The manifest's lower trees: ``grp`` ('' for a null lang, else '=' and lang), ``level, lo, hi, digest``."""
    leaves = cut_lineage(leaf_table(docs))
    out = leaves.select("grp", F.lit(0).alias("level"), "lo", "hi", "digest")
    for k, level in enumerate(climb(leaves, fanout)):
        out = out.unionByName(level.select("grp", F.lit(k + 1).alias("level"), "lo", "hi", "digest"))
    return out


def prove_rows(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``doc_id, lang, rank, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    Needs the columns of ``FIELDS``; others are not part of a leaf. Nulls are encoded as ``-``, empty texts as ``0:``. A null
    doc_id ranks first and is never tampered with; repeated rows are leaves of their own. An empty table gives no rows.
    """
    leaves = cut_lineage(leaf_table(docs))
    levels = climb(leaves, fanout)
    above = cut_lineage(upper_tree(roots(leaves, levels, fanout), fanout))
    proved = descend(leaves, levels, above, fanout)
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["before"], p["after"])), "")
    folded = F.aggregate("path", F.col("tampered"), lambda node, p: digest(p["before"], node, p["after"]))
    return proved.select("doc_id", "lang", F.col("lo").alias("rank"), F.col("digest").alias("leaf"), "subroot", "root",
                         F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 10, fanout: int = FANOUT) -> str:
    """DuckDB SQL for ``prove_rows`` over ``documents``; ``levels`` bounds the depth (fanout^levels rows a lang)."""
    def enc(e: str) -> str:
        return f"CASE WHEN {e} IS NULL THEN '-' ELSE strlen(CAST({e} AS VARCHAR)) || ':' || CAST({e} AS VARCHAR) END"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(enc(text if f == "text" else f) for f in FIELDS) + ")"

    def tree(name: str, depth: int) -> list[str]:
        """Nodes of each level, then (as-is node, path so far) per leaf going up."""
        out = [f"{name}_0 AS (SELECT grp, rk, node, count(*) OVER (PARTITION BY grp) AS size FROM {name}_in)"]
        for k in range(depth):
            out.append(
                f"{name}_{k + 1} AS (SELECT grp, rk, node, count(*) OVER (PARTITION BY grp) AS size FROM ("
                f"SELECT grp, rk // {fanout} AS rk, sha256(string_agg(node, '' ORDER BY rk)) AS node FROM {name}_{k} WHERE size > 1 GROUP BY grp, rk // {fanout} "
                f"UNION ALL SELECT grp, rk, node FROM {name}_{k} WHERE size = 1))")
        out.append(f"{name}_w0 AS (SELECT grp, rk AS own, rk, [] :: STRUCT(a VARCHAR, b VARCHAR)[] AS path FROM {name}_0)")
        for k in range(depth):
            out.append(
                f"{name}_s{k} AS (SELECT x.grp, x.rk, coalesce(string_agg(y.node, '' ORDER BY y.rk) FILTER (y.rk < x.rk), '') AS a, "
                f"coalesce(string_agg(y.node, '' ORDER BY y.rk) FILTER (y.rk > x.rk), '') AS b "
                f"FROM {name}_{k} x JOIN {name}_{k} y ON x.grp = y.grp AND x.rk // {fanout} = y.rk // {fanout} WHERE x.size > 1 GROUP BY x.grp, x.rk)")
            out.append(
                f"{name}_w{k + 1} AS (SELECT w.grp, w.own, CASE WHEN s.rk IS NULL THEN w.rk ELSE w.rk // {fanout} END AS rk, "
                f"CASE WHEN s.rk IS NULL THEN w.path ELSE list_append(w.path, {{'a': s.a, 'b': s.b}}) END AS path "
                f"FROM {name}_w{k} w LEFT JOIN {name}_s{k} s ON w.grp = s.grp AND w.rk = s.rk)")
        return out

    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: (ord(c) >> i) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform({bits}, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    low = f"CASE WHEN ({crc}) % 3 = 0 THEN translate(text, '{ascii_uppercase}', '{ascii_lowercase}') ELSE text END"
    upper = 4
    parts = [
        f"rows_in AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf('text')} AS leaf, {leaf('low')} AS tampered FROM (SELECT *, {low} AS low FROM documents))",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rk FROM rows_in)",
        "d_in AS (SELECT grp, rk, leaf AS node FROM ranked)", *tree("d", levels),
        f"u_in AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS rk, node, grp AS lang_key FROM d_{levels})", *tree("u", upper),
        f"paths AS (SELECT r.doc_id, r.leaf, r.tampered, u.node AS subroot, top.node AS root, list_concat(d.path, v.path) AS path FROM ranked r "
        f"JOIN d_w{levels} d ON d.grp = r.grp AND d.own = r.rk JOIN u_in u ON u.lang_key = r.grp JOIN u_w{upper} v ON v.own = u.rk CROSS JOIN u_{upper} top)",
    ]
    fold = "list_reduce(list_prepend({'a': tampered, 'b': ''}, path), lambda x, p: {'a': sha256(p.a || x.a || p.b), 'b': ''}).a"
    return ("WITH " + ", ".join(parts) +
            f" SELECT doc_id, leaf, subroot, root, sha256(list_aggregate(list_prepend('', list_transform(path, lambda p: p.a || p.b)), 'string_agg', '')) AS proof_sha256, "
            f"{fold} AS folded_root, {fold} = root AS verified FROM paths")
