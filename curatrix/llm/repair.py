"""Conversation structure repair: a forward Viterbi pass over four grammar states.

Roles must read (s?(ua)+)?, so a prefix of a dialogue is in one of four states: NOTHING, after a SYSTEM turn, after a USER turn,
after an ANSWER. For each turn the pass carries the minimum of (cost, audit) of each state, and closes the turn's layer with the
inserts that lead from one state to another, of which two are enough. As a turn's own letters K, R and D number the same on every
way, no audit of the same cost begins another, so what is least now stays least whatever follows.

Conversations of up to TURNS turns are a row each. Longer ones are cut into segments of TURNS turns; each segment's pass starts
in all four states, and the 4 x 4 tables of segments that follow one another are joined in tiers, as matrices are multiplied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import attach, materialise
from curatrix.shared import placed, small

#: Turns of a segment, and segments or joined segments that meet in a tier.
TURNS, FAN = 256, 64
NOTHING, SYSTEM, USER, ANSWER = range(4)
#: Fixed values of the contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
INSERTS = ((NOTHING, USER), (SYSTEM, USER), (ANSWER, USER), (USER, ANSWER))
#: Where a turn with this role initial leads from each state; -1: nowhere.
NEXT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ANSWER, -1)}
WHITE = " \t\n\x0b\x0c\r"
Best = "list[tuple[int, str] | None]"

SEEN = ("blank", "duplicate", "truncated", "illegal")
RESULT = f"conv_id {{kind}}, gaps long, {' long, '.join(SEEN)} long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (key, conv_id, turn, role, text, there) after the damage; missing roles and texts are one space, as missing values
    are in the number drawn. Dropped rows are not there, but still name their conversation."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    key = F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string")))
    rows = conversations.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("key", "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), times.alias("time")).drop("time")


def closed(layer: Best) -> Best:
    """A layer with the inserts after its turn: at most two, as a third would come back to a state for more."""
    for _ in range(2):
        for source, target in INSERTS:
            if (b := layer[source]) is not None:
                new = (b[0] + INSERT, b[1] + "I")
                if layer[target] is None or new < layer[target]:
                    layer[target] = new
    return layer


def advance(layer: Best, initial: str, dead: bool, truncated: bool) -> Best:
    """The layer after one more turn; a dead one, blank or duplicate, can only be deleted."""
    out: Best = [None if b is None else (b[0] + DELETE, b[1] + "D") for b in layer]
    if not dead:
        more = TRUNCATED if truncated else 0
        leads = NEXT.get(initial)
        for state, b in enumerate(layer):
            if b is None:
                continue
            edits = [(ANSWER if state == USER else USER, b[0] + REROLE + more, b[1] + "R")]
            if leads and leads[state] >= 0:
                edits.append((leads[state], b[0] + KEEP + more, b[1] + "K"))
            for target, cost, audit in edits:
                if out[target] is None or (cost, audit) < out[target]:
                    out[target] = (cost, audit)
    return closed(out)


def start(state: int = NOTHING) -> Best:
    return closed([(0, "") if s == state else None for s in range(4)])


def chosen(layer: Best) -> tuple[int, str]:
    """The best of the states in which a dialogue may end."""
    return min(b for b in (layer[NOTHING], layer[ANSWER]) if b is not None)


def joined(first: list[Best], second: list[Best]) -> list[Best]:
    """The table of two stretches of turns one after the other: entry state by exit state."""
    out = []
    for row in first:
        ways: Best = [None] * 4
        for middle, a in enumerate(row):
            for end, b in enumerate(second[middle] if a is not None else ()):
                if b is not None and (ways[end] is None or (a[0] + b[0], a[1] + b[1]) < ways[end]):
                    ways[end] = (a[0] + b[0], a[1] + b[1])
        out.append(ways)
    return out


def faults(turns: list[dict], seen: set | None) -> list[tuple[str, str | None]]:
    """Of each turn its role's initial and its first fault. seen: roles and texts so far, or None where turns say themselves
    whether they are the first of their kind."""
    out = []
    for t in turns:
        text, said = t["text"], (t["role"], t["text"])
        body = text.rstrip(WHITE)
        fault = "blank" if not body else "duplicate" if (said in seen if seen is not None else not t["first"]) else "truncated" if body[-1] not in ".!?" else None
        if seen is not None:
            seen.add(said)
        out.append((t["role"][:1], fault))
    return out


def counted(found: list[tuple[str, str | None]]) -> list[int]:
    """Blank, duplicate, truncated and illegal."""
    kinds = [f for _, f in found]
    return [kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))]


def edited(turns: list[dict], audit: str, state: int = NOTHING) -> list[str]:
    """What the edits make of the turns, each as role:text, from a state on."""
    out, at = [], 0
    for letter in audit:
        turn = turns[at] if letter != "I" else None
        at += letter != "I"
        if letter == "D":
            continue
        target = NEXT[turn["role"][:1]][state] if letter == "K" else ANSWER if state == USER else USER
        role = turn["role"] if letter == "K" else "assistant" if target == ANSWER else "user"
        out.append(f"{role}:{turn['text'] if turn else ''}")
        state = target
    return out


def repaired(turns: list[dict]) -> tuple[list[int], int, str, str]:
    """Of a whole conversation's turns in order: counts of faults, cost, audit and the hash of what is left."""
    found = faults(turns, set())
    layer = start()
    for initial, fault in found:
        layer = advance(layer, initial, fault in ("blank", "duplicate"), fault == "truncated")
    cost, audit = chosen(layer)
    return counted(found), cost, audit, hashlib.sha256("\n".join(edited(turns, audit)).encode()).hexdigest()


def _gaps(turns: list[dict]) -> int:
    known = [t["turn"] for t in turns if t["turn"] is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def _batch(rows: list[tuple], like: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in like]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, like)], schema=like)


def _arrow(df_schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)


def _whole(like: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
                found, cost, audit, digest = repaired(turns)
                out.append((conv_id, _gaps(turns), *found, cost, audit, digest))
            yield _batch(out, like)

    return run


TABLE = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
FOUND = pa.schema([*TABLE, *[(c, pa.int64()) for c in SEEN]])
BEST = pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
SLICE = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("letters", pa.string()), ("state", pa.int32())])
CHUNK = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("chunk", pa.string())])
DIGEST = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])


def _mapped(df: DataFrame, rows, schema: pa.Schema) -> DataFrame:
    """df's rows, each a dict, through a generator of tuples; what comes out is sent on before it gets large."""
    from pyspark.sql.pandas.types import from_arrow_schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                for x in rows(row):
                    out.append(x)
                    if len(out) == 4096:
                        yield _batch(out, schema)
                        out = []
            yield _batch(out, schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


#: A table of a stretch has 16 costs, null where there is no way, and 16 audits, by entry and then by exit state.
def _flat(table: list[Best]) -> tuple[list, list]:
    cells = [b for row in table for b in row]
    return [b and b[0] for b in cells], [b and b[1] for b in cells]


def _square(costs: list, audits: list) -> list[Best]:
    cells = [None if c is None else (c, a) for c, a in zip(costs, audits)]
    return [cells[4 * i : 4 * i + 4] for i in range(4)]


def _table(row: dict) -> Iterator[tuple]:
    found = faults(row["turns"], None)
    table = []
    for state in range(4):
        layer = start(state)
        for initial, fault in found:
            layer = advance(layer, initial, fault in ("blank", "duplicate"), fault == "truncated")
        table.append(layer)
    yield row["key"], row["seg"], *_flat(table), *counted(found)


def _join_tables(row: dict) -> Iterator[tuple]:
    tables = [_square(t["costs"], t["audits"]) for t in row["tables"]]
    whole = tables[0]
    for t in tables[1:]:
        whole = joined(whole, t)
    yield row["key"], row["seg"], *_flat(whole)


def _best(row: dict) -> Iterator[tuple]:
    yield row["key"], *chosen(_square(row["costs"], row["audits"])[NOTHING])


def _slices(turns: int):
    """Of an audit a row for each segment: its letters, with the inserts after its last turn, and the state that it begins in.
    What is left reads (s?(ua)+)?, so it begins with a system turn if its number is odd, and a place in it tells the state."""

    def run(row: dict) -> Iterator[tuple]:
        audit = row["audit"]
        system = (len(audit) - audit.count("D")) % 2
        begin = seg = own = left = 0
        state = NOTHING
        for i, letter in enumerate(audit):
            if letter != "I" and own == turns:
                yield row["key"], seg, audit[begin:i], state
                begin, own, seg = i, 0, seg + 1
                state = NOTHING if not left else SYSTEM if left == 1 and system else USER if (left - system) % 2 else ANSWER
            own += letter != "I"
            left += letter != "D"
        yield row["key"], seg, audit[begin:], state

    return run


def _chunk(row: dict) -> Iterator[tuple]:
    if out := edited(row["turns"], row["letters"], row["state"]):
        yield row["key"], row["seg"], "\n".join(out)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks come by key and segment; a conversation is hashed piece by piece and never held."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k, chunk in zip(batch.column("key").to_pylist(), batch.column("chunk")):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(chunk.as_py().encode())
        yield _batch(out, DIGEST)
    if key is not None:
        yield _batch([(key, digest.hexdigest())], DIGEST)


def _long_conversations(rows: DataFrame, kind: str, turns: int, fan: int) -> DataFrame:
    """The result's rows of conversations with more turns than a segment has. rows: key, conv_id, turn, role, text."""
    numbered = placed(rows, ["key", F.asc_nulls_first("turn"), "role", "text"])
    talks = numbered.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.min("place").alias("first"), F.count("*").alias("n"))
    known = attach(numbered.drop("conv_id"), materialise(talks, "long-talks"), "key", "n", numbered.count())
    seg = F.floor((F.col("place") - F.col("first")) / turns)
    said = F.sort_array(F.collect_list(F.struct("place", "turn", "role", "text")))
    # Repeated turns: which place is the first of its role and text, gathered by segment.
    firsts = known.groupBy("key", "first", "role", F.sha2("text", 256).alias("hash")).agg(F.min("place").alias("place")).groupBy("key", seg.alias("seg")).agg(F.collect_list("place").alias("firsts"))
    flagged = F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), F.coalesce(F.array_contains("firsts", t["place"]), F.lit(False)).alias("first")))
    cut = known.groupBy("key", seg.alias("seg")).agg(said.alias("said")).join(firsts, ["key", "seg"], "left")
    segments = materialise(cut.select("key", "seg", flagged.alias("turns")), "segments")

    initial = lambda at: F.substring(F.element_at("turns", at)["role"], 1, 1)
    edges = segments.select("key", "seg", initial(1).alias("begins"), initial(-1).alias("ends"))
    pair = F.concat("ends", "begins")
    across = edges.select("key", "seg", "begins").join(edges.select("key", (F.col("seg") + 1).alias("seg"), "ends"), ["key", "seg"]).groupBy("key").agg(F.count_if(~pair.isin("su", "ua", "au")).alias("across"))
    by_turn = numbered.groupBy("key", "turn").agg(F.lit(1).alias("one")).groupBy("key")
    gaps = by_turn.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))

    found = materialise(_mapped(segments, _table, FOUND), "tables")
    sums = found.groupBy("key").agg(*[F.sum(c).alias(c) for c in SEEN])
    tables = found.select(*TABLE.names)
    while (tables.agg(F.max("seg")).first()[0] or 0) > 0:
        tier = F.floor(F.col("seg") / fan)
        grouped = tables.groupBy("key", tier.alias("tier")).agg(F.sort_array(F.collect_list(F.struct("seg", "costs", "audits"))).alias("tables"))
        tables = materialise(_mapped(grouped.select("key", F.col("tier").alias("seg"), "tables"), _join_tables, TABLE), "tables")
    best = materialise(_mapped(tables, _best, BEST), "audits")
    chunks = _mapped(segments.join(_mapped(best, _slices(turns), SLICE), ["key", "seg"]), _chunk, CHUNK)
    digests = chunks.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_digests, "key string, repaired_sha256 string")
    whole = talks.select("key", "conv_id").join(gaps, "key").join(sums, "key").join(across, "key", "left").join(best, "key").join(digests, "key", "left")
    illegal = F.col("illegal") + F.coalesce("across", F.lit(0))
    names = [c.split()[0] for c in RESULT.format(kind=kind).split(", ")]
    return whole.withColumn("illegal", illegal).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))).select(*names)


def repaired_conversations(conversations: DataFrame, turns: int = TURNS, fan: int = FAN) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows are damaged first and then repaired at the least cost. Turns are in order of turn, nulls first; turns of equal number
    go by role and text. Missing roles and texts are one space, so such texts are blank, and such roles are none of the
    grammar's; a role counts by its first letter. Rows without conv_id are one conversation. A conversation of which nothing is
    left after the damage has zeros and the empty string's hash. Other columns are ignored; an empty table gives an empty result.

    A conversation of more turns than a segment is never in one task as a whole, but for its audit, which is one value of the
    result, and for its hash, which can only be worked out from front to end and is fed piece by piece.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    sizes = rows.groupBy("key").agg(F.count_if("there").alias("n")).filter(F.col("n") > turns).select("key")
    long = materialise(sizes, "long-conversations")
    n_long = long.count()
    if n_long:
        there = small(long)
        rest = rows.join(there, "key", "left_anti")
    else:
        rest = rows
    turn = F.when(F.col("there"), F.struct("turn", "role", "text"))
    talks = rest.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    result = RESULT.format(kind=kind)
    like = _arrow(talks.select("conv_id").limit(0).selectExpr(*[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in result.split(", ")]).schema)
    out = talks.select("conv_id", "turns").mapInArrow(_whole(like), result)
    if n_long:
        out = out.unionByName(_long_conversations(rows.filter("there").join(there, "key", "left_semi").drop("there"), kind, turns, fan))
    return out
