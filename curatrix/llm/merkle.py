"""A manifest of a dataset as a tree of hashes, grown by DuckDB in blocks.

Rows become leaves in the JVM, and what moves afterwards is hashes. A tree's nodes are cut into aligned buckets of 2^LEVELS nodes;
an executor grows a bucket's levels by ordered string_agg and sha256 in DuckDB over its Arrow table. Roots of buckets are the
nodes of the next tier, until each language has one root; those of all languages are the nodes of an outer tree, grown the same
way. On the way back each bucket gets the proof of its root, and its own siblings go before it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import attach, materialise
from curatrix.shared import placed

LEVELS = 10
#: Ids that this divides, by their checksum, are tampered with.
TAMPERED = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof is the side of the sibling and its hash, or empty where a node has none.
LEFT, RIGHT = "L", "R"
NODE = "tree long, pos long, n long, hash string"
PROOF = "tree long, pos long, top string, steps array<string>"


def encoded(value: Column) -> Column:
    """A value with its size in bytes before it, so that no two rows read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def depth(n: int, levels: int) -> int:
    """Levels that a bucket of a tree with n nodes grows: up to the tree's root, or all."""
    return min(levels, (n - 1).bit_length())


_CONNECTION = None


def _grown(nodes: pa.Table, levels: int):
    """A connection whose table grown has the bucket's nodes by level, and how many levels were added."""
    global _CONNECTION
    if _CONNECTION is None:
        import duckdb

        _CONNECTION = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con, added = _CONNECTION, depth(nodes.column("n")[0].as_py(), levels)
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TABLE grown AS SELECT 0 AS level, pos, hash FROM nodes")
    for level in range(added):
        con.execute("INSERT INTO grown SELECT level + 1, pos // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM grown WHERE level = ? GROUP BY level, pos // 2", [level])
    return con, added


def _done(con, query: str, values: list, types: dict[str, pa.DataType]) -> pa.Table:
    found = con.sql(query, params=values).to_arrow_table()
    con.unregister("nodes")
    return found.select(list(types)).cast(pa.schema(list(types.items())))


def _roots(levels: int):
    kinds = {"tree": pa.int64(), "pos": pa.int64(), "n": pa.int64(), "hash": pa.string()}

    def run(nodes: pa.Table) -> pa.Table:
        con, added = _grown(nodes, levels)
        tree, n = nodes.column("tree")[0].as_py(), nodes.column("n")[0].as_py()
        return _done(con, "SELECT ? AS tree, min(pos) >> ? AS pos, ? AS n, max(hash) AS hash FROM grown WHERE level = ?", [tree, levels - added, -(-n >> levels), added], kinds)

    return run


def _proofs(levels: int, kept: dict[str, pa.DataType]):
    """What is kept of each node, the root of its tree and the steps to the root of all."""
    kinds = kept | {"top": pa.string(), "steps": pa.list_(pa.string())}

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        con, added = _grown(nodes, levels)
        top, rest = above.column("top")[0].as_py(), above.column("steps")[0].as_py()
        query = f"""WITH own AS (SELECT w.pos, list(CASE WHEN s.hash IS NULL THEN '' WHEN w.pos >> w.level & 1 = 1 THEN '{LEFT}' || s.hash ELSE '{RIGHT}' || s.hash END ORDER BY w.level) AS steps
            FROM (SELECT pos, level FROM nodes, range(?) l(level)) w LEFT JOIN grown s ON s.level = w.level AND s.pos = xor(w.pos >> w.level, 1) GROUP BY w.pos)
            SELECT {", ".join(f"nodes.{c}" for c in kept)}, ?::VARCHAR AS top, list_concat(coalesce(own.steps, []), ?::VARCHAR[]) AS steps FROM nodes LEFT JOIN own USING (pos)"""
        return _done(con, query, [added, top, rest], kinds)

    return run


def _bucket(levels: int) -> Column:
    return F.shiftright("pos", levels).alias("bucket")


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (tree, pos, n, hash), the roots of their buckets, and so on up to one node a tree; two tiers at least."""
    tiers = [nodes]
    while len(tiers) == 1 or (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        roots = tiers[-1].select("tree", "pos", "n", "hash", _bucket(levels)).groupBy("tree", "bucket").applyInArrow(_roots(levels), NODE)
        tiers.append(materialise(roots, "bucket-roots"))
    return tiers


def _down(tiers: list[DataFrame], above: DataFrame, levels: int, kept: str) -> DataFrame:
    """Proofs of the lowest tier's nodes, with the columns kept of them; above has those of the highest tier's nodes."""
    for i, nodes in enumerate(reversed(tiers[:-1])):
        names = kept if i == len(tiers) - 2 else PROOF.split(", top")[0]
        kinds = {c.split()[0]: {"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in names.split(", ")}
        under = nodes.select("*", _bucket(levels)).groupBy("tree", "bucket")
        above = under.cogroup(above.select("tree", F.col("pos").alias("bucket"), "top", "steps").groupBy("tree", "bucket")).applyInArrow(_proofs(levels, kinds), f"{names}, top string, steps array<string>")
        if i < len(tiers) - 2:
            above = materialise(above, "proofs")
    return above


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        return F.sha2(F.when(F.substring(step, 1, 1) == LEFT, F.concat(sibling, node)).otherwise(F.concat(node, sibling)), 256)

    return F.aggregate(steps, leaf, up)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row for each row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified.

    Leaves of a language are in order of doc_id, nulls first, and equal ids in that of their hashes; a missing language is one of
    its own. Nulls in any column have a hash of their own. Repeated rows are leaves of their own. A row without an id or without
    n_chars is not tampered with. Other columns are ignored; an empty table gives an empty result. The text is read once, and
    what is moved afterwards are hashes.
    """
    language = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("lang")))
    tampers = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0) & F.col("n_chars").isNotNull()
    tampered = F.when(tampers, leaf_hash(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = materialise(docs.select(language.alias("key"), "doc_id", leaf_hash().alias("leaf"), tampered.alias("tampered")), "leaves")
    numbered = materialise(placed(leaves, ["key", F.asc_nulls_first("doc_id"), "leaf"]), "leaves-placed")
    languages = numbered.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    languages = materialise(placed(languages, ["key"], "rank").withColumn("tree", F.col("rank") - 1), "languages")
    known = attach(numbered, languages, "key", "n", numbered.count())
    own = known.select("tree", (F.col("place") - F.col("first")).alias("pos"), "n", F.col("leaf").alias("hash"), F.col("doc_id").cast("long").alias("doc_id"), "tampered")
    trees = _tiers(own, levels)
    n_trees = languages.count()
    subroots = trees[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("n"), "hash")
    outer = _tiers(subroots, levels)
    root = outer[-1].select("hash").first()
    nothing = F.array().cast("array<string>")
    above = _down(outer, outer[-1].select("tree", "pos", F.col("hash").alias("top"), nothing.alias("steps")), levels, "pos long, hash string")
    above = materialise(above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("hash").alias("top"), "steps"), "outer-proofs")
    rows = _down(trees, above, levels, "doc_id long, hash string, tampered string")
    proof = F.array_join(F.transform("steps", lambda s: F.substring(s, 2, 64)), "")
    reached = folded(F.coalesce("tampered", "hash"), F.col("steps"))
    whole = F.lit(root[0] if root else None).cast("string")
    out = rows.select("doc_id", F.col("hash").alias("leaf"), F.col("top").alias("subroot"), whole.alias("root"), F.sha2(proof, 256).alias("proof_sha256"), reached.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
