"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without its ASCII white space is cut where its own characters say so. Every distinct chunk gets a verified
identifier: its 64-bit hash, and where different chunks share a hash, their rank among those. A document's recipe is its
ordered list of identifiers, and texts are equal when their recipes are. Chunk contents move once, each distinct chunk of
a task once; after that only recipes move, 8 bytes for some 600 characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import attach, materialise

#: The white space that texts are compared without.
WHITE_SPACE = " \t\n\x0b\x0c\r"
SHORTEST, LONGEST = 512, 4096


def _boundary() -> str:
    """Two code points in a row, each of about one in seven: picked one by one below U+0100, in short ranges among alphabets
    above, and in longer ones among the scripts of many characters. Most texts fail the look-ahead, not the ranges."""
    single = "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x100) if (c * 40503 >> 7) % 7 == 0)
    ranges = [(c, c + 3) for c in range(0x100, 0x1000, 28)] + [(c, c + 63) for c in range(0x1000, 0x20000, 448)]
    return f"(?:[{single}]{{2}}|(?=[\\x{{100}}-\\x{{1ffff}}])[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]{2})"


#: From SHORTEST code points on up to the next boundary, LONGEST at most; the last chunk is what is left.
CHUNK = f"(?s).{{{SHORTEST},{LONGEST - 2}}}?{_boundary()}|(?s).{{1,{LONGEST}}}"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE_SPACE, "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """doc_id, text_hash, n_chars, text_sha256 and recipe of every row. hash_of: the chunks' hash; a weak one gives the same
    result. text_hash: of the text as it is, to know a row again."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), normalised().alias("norm"))
    pieces = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk")).select(hash_of("chunk").alias("hash"), "chunk").distinct()
    shared = materialise(pieces.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "shared-hashes")
    recipe = texts.select("doc_id", "text_hash", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.struct(hash_of(c).alias("hash"), F.lit(0).alias("rank"))).alias("recipe"))
    if shared.limit(1).count() == 0:  # as it is unless 64-bit hashes collide
        return recipe
    ranked = pieces.join(shared, "hash", "left_semi").select("hash", "chunk", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).alias("rank"))
    exploded = texts.select("doc_id", "text_hash", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode_outer(chunks(F.col("norm"))).alias("at", "chunk"))
    known = exploded.withColumn("hash", hash_of("chunk")).join(ranked, ["hash", "chunk"], "left")
    parts = F.sort_array(F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "hash", F.coalesce("rank", F.lit(0)).alias("rank")))))
    whole = known.groupBy("doc_id", "text_hash", "n_chars", "text_sha256").agg(F.transform(parts, lambda p: F.struct(p["hash"].alias("hash"), p["rank"].alias("rank"))).alias("recipe"))
    # Rows that repeat an id with an equal text were merged above; each gets the recipe.
    return recipe.drop("recipe").join(whole.withColumnsRenamed({"doc_id": "i", "text_hash": "h", "n_chars": "n", "text_sha256": "s"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_hash") == F.col("h")) & (F.col("n_chars") == F.col("n")) & (F.col("text_sha256") == F.col("s"))).drop("i", "h", "n", "s")


def _grouped(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """exact_groups with text_hash."""
    found = materialise(recipes(docs, hash_of), "recipes")
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
    groups = materialise(found.groupBy("recipe").agg(F.count("*").alias("group_size"), first), "recipe-groups")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("n_chars") == -F.col("first.n"))
    return attach(found, groups, "recipe", "group_size", found.count()).select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "text_hash")


def exact_groups(docs: DataFrame, hash_of=F.xxhash64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. The row with the most code points in its original text
    stays, of these the smallest doc_id. A null text is empty, and empty texts are equal to each other. A null doc_id
    comes after all others. Rows that repeat the kept row's id and length are one document and all kept. Other columns,
    whatever their names, are ignored. An empty table gives an empty result.
    """
    return _grouped(docs, hash_of).drop("text_hash")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns.

    It is the row that stays or goes: of an id with several texts, those that are copies of another document's go and the
    others stay. Rows that repeat an id and its text stay or go together. An empty table gives an empty result.
    """
    stay = _grouped(docs).filter("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_hash").alias("__kept_hash")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["__kept_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == stay["__kept_hash"]), "left_semi")
