"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are made in numpy, and equal ones become one class. Six blocks of bits of which four differ at most share two
whole blocks, so every linked pair meets under one of 15 keys. The rows under a key lie next to each other; a batch of rows
is turned into 64 bit planes, and for each shift k the planes and the planes shifted by k are compared, 64 pairs in
a machine word: carry-save counters add up the differing planes, and words whose pairs are all beyond the radius are
abandoned. Of the links under a key only a spanning forest leaves the task.

Texts whose sets of five-word shingles have a similarity of 0.8 are some ten bits of 64 apart, too far for whole blocks. So
the dedup that keeps one of each group makes fingerprints of 256 bits by those sets, and rows meet under keys of sampled
bits: enough keys, of a width that grows with the rows, for all but MISSED of such pairs. The same bit-sliced comparison
finds candidates under a key, and a candidate is a link if the shingle sets themselves are similar enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import attach, materialise
from curatrix.operators.components import connected_components

RADIUS = 4
#: The widths of the blocks of bits, of which all but RADIUS make a key; narrower ones beyond so many fingerprints.
BLOCKS, MANY_BLOCKS, MANY = (11, 11, 11, 11, 10, 10), (8,) * 8, 1 << 26
#: Keys with more rows are compared in blocks of so many rows, each pair of blocks in a group of its own.
BLOCK_ROWS = 8192
#: For dedup: texts are linked if their sets of runs of so many words have a similarity (Jaccard) of LIKE or more.
SHINGLE_WORDS, LIKE = 5, 0.8
#: Words of 64 bits in such a fingerprint; the share of bits in which two that are just LIKE differ: their angle over pi.
WIDE = 4
APART = math.acos(2 * LIKE / (1 + LIKE)) / math.pi
#: Share of such pairs that meet under no key, at most.
MISSED = 0.03
#: How far candidates may be apart by one word of the fingerprint and by all, step by step so that the nearest are tied
#: together first. Just LIKE is 10 and 39 bits on average, with deviations of 2.9 and 5.7.
STEPS = ((10, 24), (14, 38), (18, 54))
#: ASCII letters and digits, and all that is not ASCII, are parts of words.
SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: So many hashes of sets leave a task together.
SET_NUMBERS = 1 << 20
#: So many shifts are compared together.
SHIFTS = 32
FINGERPRINTS = "doc_id long, fp long"


def shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """XXH64 of all runs of so many words; of the whole text if it has fewer."""
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, and only ASCII white space


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit fingerprint, unsigned; zero for a text without words."""
    found = words_in(text)
    return majority(shingle_hashes(found, words)) if found else 0


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same things."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain_words(text: str | None) -> list[bytes]:
    """Words without case and punctuation: a copy that is punctuated anew has the same."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(SEPARATORS).split()


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's runs of SHINGLE_WORDS plain words, ascending; none for a text without words."""
    found = plain_words(text)
    return np.unique(shingle_hashes(found, SHINGLE_WORDS)) if found else np.zeros(0, np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> list[int]:
    """WIDE words of bits that over half of a shingle set has, and a hash of the set."""
    if not len(shingles):
        return [0] * (WIDE + 1)
    return [*[majority(mixed(shingles, k)) for k in range(WIDE)], xxhash.xxh64_intdigest(shingles.tobytes())]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])


def _wide_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *[f"w{k}" for k in range(WIDE)], "shingles"]
    for batch in batches:
        fps = np.array([wide_fingerprint(shingle_set(x.as_py())) for x in batch.column(1)], np.uint64).reshape(-1, WIDE + 1).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(c)) for c in fps.T]], names)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sets, size = [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "hashes"])

        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc_id)
            sets.append(shingle_set(text.as_py()).view(np.int64))
            size += len(sets[-1])
            if size > SET_NUMBERS:  # sets may be longer than their texts
                yield out()
                ids, sets, size = [], [], 0
        yield out()


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of machine words: row b has bit b of all fingerprints, one word of padding behind."""
    words = -(-len(fps) // 64) + 1
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(fps)] = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def _shifted(planes: np.ndarray, k: int) -> np.ndarray:
    w, r = divmod(k, 64)
    moved = np.zeros_like(planes)
    low = planes[..., w:]
    moved[..., : low.shape[-1]] = low >> np.uint64(r) if r else low
    if r and planes.shape[-1] > w + 1:
        high = planes[..., w + 1 :]
        moved[..., : high.shape[-1]] |= high << np.uint64(64 - r)
    return moved


def near_at(planes: np.ndarray, same: np.ndarray, first: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """The (i, k) with fingerprints i and i + k at most radius apart, among those whose bit i is set in same[k - first].

    same: a row of machine words for each shift from first on. radius: 27 at most.
    """
    moved = np.stack([_shifted(planes, first + x) for x in range(len(same))], axis=1)
    shift, word = np.nonzero(same)
    open_ = same[shift, word]
    ones = twos = fours = eights = sixteens = np.zeros(len(word), np.uint64)
    for b in range(64):
        bit = planes[b][word] ^ moved[b][shift, word]
        carry = ones & bit
        ones = ones ^ bit
        carry, twos = twos & carry, twos ^ carry
        carry, fours = fours & carry, fours ^ carry
        carry, eights = eights & carry, eights ^ carry
        sixteens = sixteens ^ carry
        if b % 4 == 3:  # pairs within the radius count radius + 4 by now at most, so no counter has run over
            open_ = open_ & ~_over((sixteens, eights, fours, twos, ones), radius)
        if b % 8 == 7:  # abandon the words whose pairs are all beyond the radius
            keep = open_ != 0
            if not keep.all():
                shift, word, open_, ones, twos, fours, eights, sixteens = (x[keep] for x in (shift, word, open_, ones, twos, fours, eights, sixteens))
            if not len(word):
                break
    at, bit = np.nonzero(np.unpackbits(open_.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return word[at] * 64 + bit, shift[at] + first


def _over(counters: tuple[np.ndarray, ...], radius: int) -> np.ndarray:
    """Bits whose counter, the highest place first, is over the radius."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for place, c in zip(range(len(counters) - 1, -1, -1), counters):
        if radius >> place & 1:
            equal = equal & c
        else:
            over |= equal & c
            equal = equal & ~c
    return over


def _forest(group: np.ndarray, fps: np.ndarray, steps: tuple, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) that connect what is near in each group; group: ascending numbers. steps: of each pass the radius, and
    that by all the bits of wide, if given; what an earlier pass has connected is not compared again."""
    n = len(fps)
    label = np.arange(n)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    room = ends - np.arange(n) - 1  # how far a row's later neighbours reach
    planes = planes_of(fps)
    left, right = [], []
    for radius, in_all in steps:
        for first in range(1, int(room.max(initial=0)) + 1, SHIFTS):
            while (up := label[label]).tobytes() != label.tobytes():
                label[:] = up
            bits = np.zeros((SHIFTS, planes.shape[1] * 64), np.uint8)
            for x in range(min(SHIFTS, n - first)):  # pairs that are connected already need no comparison
                k = first + x
                bits[x, : n - k] = (room[: n - k] >= k) & (label[: n - k] != label[k:])
            i_, k_ = near_at(planes, np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64), first, radius)
            if wide is not None:
                far = np.bitwise_count(wide[i_] ^ wide[i_ + k_]).sum(1, dtype=np.int64)
                order = np.flatnonzero(far <= in_all)
                order = order[np.argsort(far[order], kind="stable")]
                i_, k_ = i_[order], k_[order]
            for i, k in zip(i_.tolist(), k_.tolist()):
                a, b = root(i), root(i + k)
                if a != b:
                    label[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(i + k)
    return np.array(left, np.int64), np.array(right, np.int64)


def _links(batches: Iterator[pa.RecordBatch], steps: tuple, extra: int) -> Iterator[pa.RecordBatch]:
    """Rows (tbl, key, part, fp, rep and extra wide words), sorted by key and part, to edges (a, b). A group that goes on in
    the next batch waits."""
    wait: list[np.ndarray] = []

    def found(rows: np.ndarray):
        change = (rows["key"][1:] != rows["key"][:-1]) | (rows["part"][1:] != rows["part"][:-1]) | (rows["tbl"][1:] != rows["tbl"][:-1])
        group = np.concatenate(([0], np.cumsum(change)))
        several = np.bincount(group)[group] > 1
        group, rows = group[several], rows[several]
        # Small runs keep the planes within the processor's caches; groups are never cut.
        at = 0
        while at < len(rows):
            end = min(at + 4096, len(rows))
            while end < len(rows) and group[end] == group[end - 1]:
                end += 1
            wide = np.stack([rows[f"w{k}"][at:end] for k in range(extra)], axis=1).view(np.uint64) if extra else None
            i, j = _forest(group[at:end], rows["fp"][at:end].copy().view(np.uint64), steps, wide)
            if len(i):
                reps = rows["rep"][at:end]
                yield pa.RecordBatch.from_arrays([pa.array(reps[i]), pa.array(reps[j])], ["a", "b"])
            at = end

    kind = np.dtype([("tbl", np.int32), ("key", np.int64), ("part", np.int64), ("fp", np.int64), ("rep", np.int64), *[(f"w{k}", np.int64) for k in range(extra)]])
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.empty(batch.num_rows, kind)
        for c in kind.names:
            rows[c] = batch.column(c).to_numpy(zero_copy_only=False)
        last = rows[["tbl", "key", "part"]] == rows[["tbl", "key", "part"]][-1]
        if last.all():
            if wait and (wait[-1][["tbl", "key", "part"]][-1] != rows[["tbl", "key", "part"]][-1]):
                yield from found(np.concatenate(wait))
                wait = []
            wait.append(rows)
            continue
        cut = len(rows) - int(np.argmin(last[::-1]))
        yield from found(np.concatenate([*wait, rows[:cut]]))
        wait = [rows[cut:]]
    if wait:
        yield from found(np.concatenate(wait))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def key_masks(blocks: tuple = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Of each choice of the blocks that may be left when radius others differ, the mask of its bits, signed."""
    ends = np.cumsum((0, *blocks)).tolist()
    masks = [((1 << w) - 1) << at for at, w in zip(ends, blocks)]
    return [_signed(sum(c)) for c in combinations(masks, len(blocks) - radius)]


def _compared(keyed: DataFrame, block_rows: int, steps: tuple) -> DataFrame:
    """Edges (a, b) between the rep of rows (tbl, key, fp, rep, and maybe wide words) that are near under a key."""
    wide = [c for c in keyed.columns if c not in ("tbl", "key", "fp", "rep")]
    counts = materialise(keyed.groupBy("tbl", "key").agg(F.count("*").alias("n")).filter(F.col("n") > block_rows), "large-keys")
    n_hot = counts.count()
    if n_hot:
        # Of a large key each row goes to every pair of blocks that its own block is in.
        hot = F.broadcast(counts) if n_hot <= 100_000 else counts
        known = keyed.join(hot, ["tbl", "key"], "left").withColumn("m", F.ceil(F.col("n") / block_rows)).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("m")))
        parts = F.when(F.col("n").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda o: F.least(o, F.col("mine")) * F.col("m") + F.greatest(o, F.col("mine"))))
        keyed = known.withColumn("part", F.explode(parts))
    else:
        keyed = keyed.withColumn("part", F.lit(0).cast("long"))
    # In order of rep, so that the same neighbours are found under many keys.
    rows = keyed.select("tbl", "key", "part", "fp", "rep", *wide).repartition("tbl", "key", "part").sortWithinPartitions("tbl", "key", "part", "rep")
    return rows.mapInArrow(lambda batches: _links(batches, steps, len(wide)), "a long, b long")


def fingerprint_links(classes: DataFrame, block_rows: int = BLOCK_ROWS, radius: int = RADIUS, blocks: tuple = BLOCKS) -> DataFrame:
    """Edges (a, b) between the rep of classes (fp, rep) that connect exactly what a chain of links connects."""
    keys = F.array(*[F.struct(F.lit(t).alias("tbl"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(key_masks(blocks, radius))])
    return _compared(classes.select("fp", "rep", F.explode(keys).alias("k")).select("k.tbl", "k.key", "fp", "rep"), block_rows, ((radius, 64),))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints RADIUS or fewer bits apart are linked; component_id is the smallest doc_id that links reach. A null text
    is empty and has fingerprint zero, as all texts without words. Rows without doc_id are linked like all others; their
    component_id is null if no row that links reach has an id. Repeated rows stay repeated. Other columns are ignored; an
    empty table gives an empty result.
    """
    marks = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, FINGERPRINTS), "fingerprints")
    classes = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprint-classes")
    links = fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), blocks=BLOCKS if classes.count() <= MANY else MANY_BLOCKS)
    # Components of fingerprints, as some have no id; most fingerprints are linked to none.
    found = connected_components(links)
    components = materialise(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()), "fingerprint-components")
    linked = classes.join(components, F.col("fp") == F.col("id"))
    least = materialise(linked.groupBy("component").agg(F.min("first").alias("least"), F.count("*").alias("members")), "component-least")
    of = attach(components, least, "component", "members", components.count()).select("id", "least")
    named = materialise(classes.join(of, F.col("fp") == F.col("id"), "left").select("fp", "n", F.when(F.col("id").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), "components")
    joined = attach(marks, named, "fp", "n", marks.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sampled_masks(rows: int) -> list[list[int]]:
    """For so many rows, the masks of each key over the fingerprint's words: a key's bits are sampled, some 32 to 64 unrelated
    rows share it, and there are so many keys that two texts that are just LIKE miss all with a probability of MISSED."""
    width = max(12, math.ceil(math.log2(max(2, rows))) - 5)
    keys = math.ceil(math.log(MISSED) / math.log1p(-((1 - APART) ** width)))
    rng = np.random.default_rng(width)
    out = []
    for _ in range(keys):
        masks = [0] * WIDE
        for bit in rng.choice(64 * WIDE, width, replace=False).tolist():
            masks[bit // 64] |= 1 << bit % 64
        out.append([_signed(m) for m in masks])
    return out


def near_copies(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, component) of rows whose text is nearly one with a smaller id: chains of texts whose sets of runs of
    SHINGLE_WORDS words, without case and punctuation, have a similarity of LIKE or more (of a shorter text, its whole
    sequence is the one run). Texts without words are one group. Rows without an id are left out; rows that repeat an id are one text for each."""
    wide = [f"w{k}" for k in range(WIDE)]
    kind = ", ".join(["doc_id long", *[f"{w} long" for w in wide], "shingles long"])
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = materialise(texts.mapInArrow(_wide_fingerprints, kind), "wide-fingerprints")
    # Equal shingle sets are one class, so a group of copies of any size has one row under each key.
    classes = materialise(marks.groupBy("shingles", *wide).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "wide-classes")
    keys = F.array(*[F.struct(F.lit(t).alias("tbl"), F.xxhash64(*[F.col(w).bitwiseAND(F.lit(m).cast("long")) for w, m in zip(wide, masks) if m]).alias("key")) for t, masks in enumerate(sampled_masks(classes.count()))])
    keyed = classes.filter(F.col("shingles") != 0).select(F.explode(keys).alias("k"), F.col("w0").alias("fp"), "rep", *wide).select("k.tbl", "k.key", "fp", "rep", *wide)
    able = materialise(_compared(keyed, block_rows, STEPS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "near-candidates")
    # Only the texts of candidates are read again; each pair is judged by its two sets. An id may repeat with other texts.
    which = able.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialise(texts.join(which, "doc_id", "left_semi").mapInArrow(_shingle_sets, "doc_id long, hashes array<long>"), "shingle-sets")
    x, y = (sets.select(F.col("doc_id").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    similar = both / (F.size("of_a") + F.size("of_b") - both)
    links = able.join(x, "a").join(y, "b").filter(similar >= LIKE).select("a", "b").distinct()
    linked = connected_components(links)
    # A row's class is known by its first id: joined on all words packed into one key.
    pack = F.concat_ws(".", "shingles", *wide)
    known = classes.select(pack.alias("mark"), "rep", "n").join(linked, F.col("rep") == F.col("id"), "left")
    named = materialise(known.select("mark", "n", F.coalesce("component", "rep").alias("component")), "near-components")
    rows = materialise(marks.select("doc_id", pack.alias("mark")), "marks")
    return attach(rows, named, "mark", "n", rows.count()).filter("doc_id <> component").select(F.col("doc_id").alias("id"), "component")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs but near copies of rows with a smaller id (near_copies), with all their columns. Rows without an id
    stay; rows that repeat an id stay or go together. An empty table gives an empty result."""
    gone = near_copies(docs).select(F.col("id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
