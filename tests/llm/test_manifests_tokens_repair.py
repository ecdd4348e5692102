"""The Merkle manifest, token counts and the repair of dialogues against plain loops, a library and every possible edit."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from curatrix.llm import repair
from curatrix.llm.merkle import manifest
from curatrix.llm.repair import repaired_conversations
from curatrix.llm.token_counts import Counter, Merges, token_counts

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
CLASHING = ("key", "tree", "pos", "hash", "place", "turns", "there", "kind", "n", "n_tokens", "first", "seg", "leaf", "steps", "time")


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# 11


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold_up(nodes):
    """Of each node the siblings on its way up, with their sides, and the root."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, at):
            if (i ^ 1) < len(nodes):
                p.append((i & 1, nodes[i ^ 1]))
            else:
                p.append((None, ""))
        nodes = [H("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [i // 2 for i in at]
    return paths, nodes[0]


def plain_manifest(docs):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, more=0: H("".join(said(v) for v in (d[0], d[1], d[2], None if d[3] is None else d[3] + more, d[4])))
    by_lang = {}
    for d in docs:
        by_lang.setdefault(d[2], []).append(d)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    inner = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
        inner[lang] = fold_up([leaf(d) for d in by_lang[lang]])
    outer, root = fold_up([inner[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, outer):
        for d, path in zip(by_lang[lang], inner[lang][0]):
            tampered = d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            node = leaf(d, 1 if tampered else 0)
            for side, sibling in path + top:
                node = H(sibling + node if side == 1 else node + sibling)
            out.append((d[0], leaf(d), inner[lang][1], root, H("".join(s for _, s in path + top)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_is_that_of_plain_loops(spark, levels):
    r = random.Random(levels)
    langs = [None, "", "de", "en", "en", "en", "é", "z"]
    docs = [(i, r.choice(["s", None, ""]), r.choice(langs), r.choice([None, i, 2**63 - 1]), r.choice([None, "", "text", "ü" * 1000, "1:-"])) for i in range(90)]
    docs += [(None, "s", "en", 5, "x"), (None, None, None, None, None), (7, "s", "en", 1, "again"), (7, "s", "en", 1, "again"), (-3, "s", "de", 0, ""), (1000, "a", "alone", 1, "y")]
    r.shuffle(docs)
    got = rows(manifest(clashing(spark.createDataFrame(docs, DOCS)), levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
    want = plain_manifest(docs)
    assert got == want
    assert {v for *_, v in want} == {True, False}


def test_manifest_of_little(spark):
    assert manifest(spark.createDataFrame([], DOCS)).collect() == []
    one = [(1, "s", "en", 3, "abc")]
    assert rows(manifest(spark.createDataFrame(one, DOCS))) == plain_manifest(one)
    assert rows(manifest(spark.createDataFrame([(1, "s", "a", 3, "x"), (2, "s", "b", 3, "y")], DOCS))) == plain_manifest([(1, "s", "a", 3, "x"), (2, "s", "b", 3, "y")])


# 12

WORDS = ["", None, "hello World", "I'll don't 12345 !!!??? ...", " \x1c a\x1db", "x" * 30_000, "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|><|endoftext|>", "ΣΑΣ Σ İstanbul é ́ x", "  a b", "日本語 テキスト 🙂🙂", "ﬁ ǅ ẞ K Å", "\x00\x85\xad", "aaaaaaa aaaaaaaa"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_are_the_librarys(spark, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, r = public_tokenizers.path(name), random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz'! 1\n\té́ΣÀ😀中​"
    texts = WORDS + ["".join(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(400)] + ["".join(chr(r.randint(1, 0x2FFF)) for _ in range(80)) for _ in range(200)] + ["".join(r.choice("etaoinshr") for _ in range(4000))]
    df = clashing(spark.createDataFrame([(i if i else None, "s", "en", 1, t) for i, t in enumerate(texts)] + [(2, "s", "en", 1, "hello World")], DOCS))
    library = Tokenizer.from_file(path)
    want = []
    for i, t in [*enumerate(texts), (2, "hello World")]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i if i else None, len((t or "").encode()), n, n > 100))
    assert rows(token_counts(df, path, 100)) == sorted(want, key=repr)
    assert token_counts(spark.createDataFrame([], DOCS), path).collect() == []


def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    import public_tokenizers
    from curatrix.llm import token_counts as module

    texts = [t or "" for t in WORDS]
    want = list(Counter(public_tokenizers.path("word_bpe_49k.json")).count(texts))
    for name in ("REMEMBERED", "STRETCH", "TOGETHER"):
        monkeypatch.setattr(module, name, 3)
    assert list(Counter(public_tokenizers.path("word_bpe_49k.json")).count(texts)) == want


def plain_merge(symbols, ranks):
    """One pair at a time: the lowest rank, of equal ones the leftmost."""
    symbols = list(symbols)
    while found := [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        _, i = min(found)
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return len(symbols)


def test_merging_all_at_once_is_merging_one_by_one():
    """Also where a symbol is made in two ways, the later of which must wait."""
    from curatrix.llm.token_counts import byte_characters

    merges = [("a", "b"), ("ab", "c"), ("abc", "a"), ("b", "c"), ("a", "a"), ("aa", "a"), ("a", "bc"), ("c", "c"), ("cc", "cc"), ("abca", "bc")]
    symbols = dict.fromkeys([*byte_characters(), *(a + b for a, b in merges)])
    some = merges[1:]  # without ab, abc is made of a and bc only, and abc+a has a lower rank than it
    for pairs in (merges, some):
        engine = Merges({s: i for i, s in enumerate(symbols)}, pairs)
        ranks = {p: i for i, p in enumerate(pairs)}
        words = ["".join(w) for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
        assert engine.surviving(words).tolist() == [plain_merge(w, ranks) for w in words]
    assert engine.waits.any()


# 13

TALK = "conv_id long, turn long, role string, text string"


def every_edit(found):
    """The cheapest audit, by trying all of them: up to two inserts at every place."""
    legal, best = re.compile("(s?(ua)+)?"), None
    per_row = []
    for initial, fault in found:
        more = fault == "truncated"
        ways = [("D", 3, "")]
        if fault not in ("blank", "duplicate"):
            ways += [("K", more, initial or "?"), ("R", 2 + more, "u"), ("R", 2 + more, "a")]
        per_row.append(ways)
    gaps = [("", 0, "")] + [("I" * n, 2 * n, "".join(w)) for n in (1, 2) for w in itertools.product("ua", repeat=n)]
    for ways in itertools.product(*[x for row in per_row for x in (gaps, row)], gaps):
        if legal.fullmatch("".join(w[2] for w in ways)):
            one = (sum(w[1] for w in ways), "".join(w[0] for w in ways))
            best = min(best, one) if best else one
    return best


def test_repairs_are_the_cheapest_of_all_edits():
    kinds = [(i, f) for i in ("s", "u", "a", "t", "") for f in (None, "blank", "truncated")]
    r = random.Random(5)
    cases = [[]] + [[k] for k in kinds] + [[a, b] for a in kinds for b in kinds] + [[r.choice(kinds) for _ in range(3)] for _ in range(60)]
    for found in cases:
        layer = repair.start()
        for initial, fault in found:
            layer = repair.advance(layer, initial, fault in ("blank", "duplicate"), fault == "truncated")
        assert repair.chosen(layer) == every_edit(found), found


def plain_repair(talk):
    """Damage and repair of rows (conv_id, turn, role, text) in plain loops."""
    out = {}
    for conv, turn, role, text in talk:
        there = out.setdefault(conv, [])
        said = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else said(role), "" if kind == 1 else re.sub("[.!?]", "", said(text)) if kind == 2 else said(text)
        there += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    result = []
    for conv, turns in out.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        counts, cost, audit, digest = repair.repaired([{"turn": t, "role": r, "text": x} for t, r, x in turns])
        known = [t for t, _, _ in turns if t is not None]
        result.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *counts, cost, audit, digest))
    return sorted(result, key=repr)


def talks(seed, n, most):
    r, out = random.Random(seed), []
    texts = ["Yes.", "No?", "well", "well.", "", " \t", None, "More! \n", "a" * 500 + ".", "é", "ok.  "]
    for conv in [None, *range(n)]:
        for turn in range(r.randint(1, most)):
            out.append((conv, r.choice([turn, turn, turn, turn * 2, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(texts + [f"say {turn}.", f"say {turn}"] * 4)))
    return out


@pytest.mark.parametrize(("turns", "fan"), [(256, 64), (3, 2)])
def test_repair_is_that_of_plain_loops_in_segments_or_whole(spark, turns, fan):
    talk = talks(turns, 60, 24)
    assert rows(repaired_conversations(clashing(spark.createDataFrame(talk, TALK)), turns, fan)) == plain_repair(talk)


def test_what_is_left_is_legal_and_counted():
    for talk in (talks(s, 1, 12) for s in range(40)):
        turns = [{"turn": t, "role": r or " ", "text": x or " "} for _, t, r, x in talk]
        found, cost, audit, _ = repair.repaired(turns)
        left = repair.edited(turns, audit)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left)) and len(audit) - audit.count("I") == len(turns)
        kinds = [f for _, f in repair.faults(turns, set())]
        assert found[:3] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        letters = audit.replace("I", "")
        assert cost == 2 * audit.count("I") + sum(3 if x == "D" else 2 * (x == "R") + (k == "truncated") for x, k in zip(letters, kinds))


def test_repair_of_a_hot_conversation_of_equal_rows(spark):
    talk = [(1, None, "user", "same.")] * 700 + [(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(500)] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    assert rows(repaired_conversations(spark.createDataFrame(talk, TALK), 16, 4)) == plain_repair(talk)


def test_repair_of_nothing(spark):
    assert repaired_conversations(spark.createDataFrame([], TALK)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "x.")], TALK)
    assert rows(repaired_conversations(df)) == [(gone, 0, 0, 0, 0, 0, 0, "", H(""))]
    text_id = df.withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    assert repaired_conversations(text_id).count() == 1
