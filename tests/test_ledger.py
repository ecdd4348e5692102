"""Exports that come again, writers that meet, files that arrive as a stream, families that grow."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from curatrix.operators import catalog, families, ledger
from curatrix.plans import commands
from curatrix.schemas import AVATAR_URLS, schema
from curatrix.sources.versions import Catalog, Conflict
from curatrix.streaming.manifests import ingest_stream

FACTS = ("normalized_url", "original_url", "handles", "display_names", "source_surfaces", "seen_count", "first_seen_at", "last_seen_at", "example_profile_url", "example_notification_url", "example_tweet_url", "whitelisted", "download_status", "image_sha256")


def facts(df):
    return sorted((tuple(r) for r in df.select(*FACTS).collect()), key=repr)


def avatar(r, url):
    text = lambda *some: r.choice([None, "", *some])
    return {"normalized_url": url, "original_url": f"{url}?{r.random()}", "handles": r.sample(["a", "b", "c", ""], 2), "display_names": r.sample(["A", "B"], 1), "source_surfaces": ["tweet"], "seen_count": r.randint(1, 9),
            "first_seen_at": f"2024-01-{r.randint(1, 28):02d}T00:00:00Z", "last_seen_at": f"2024-02-{r.randint(1, 28):02d}T00:00:00Z", "example_profile_url": text("p1", "p2"), "example_notification_url": text("n1"), "example_tweet_url": text("t1", "t2"), "whitelisted": r.random() < 0.3}


def manifest(path, seed, urls):
    r = random.Random(seed)
    rows = [avatar(r, u) for u in urls]
    path.write_text(json.dumps({"version": 1, "exported_at": "2024-01-01T00:00:00Z", "avatar_count": len(rows), "total_sightings": sum(a["seen_count"] for a in rows), "avatars": rows}))


def test_a_forced_manifest_takes_its_old_contribution_out(spark, tmp_path):
    c, given = Catalog(spark, str(tmp_path / "catalog")), tmp_path / "in"
    given.mkdir()
    manifest(given / "a.json", 1, ["u1", "u2", "only-a", "u1"])
    manifest(given / "b.json", 2, ["u2", "u3", "only-b"])
    assert commands.ingest(c, str(given)) == 2
    manifest(given / "c.json", 3, ["u1", "u4"])
    assert commands.ingest(c, str(given)) == 1 and commands.ingest(c, str(given)) == 0
    outcomes = spark.createDataFrame([("u2", "s2", None), ("only-b", None, "gone")], "normalized_url string, sha256 string, error string")
    c.update(lambda snap: {"avatar_urls": catalog.record_outcomes(snap.read("avatar_urls"), outcomes, F.current_timestamp())})
    first_bytes = (given / "b.json").read_bytes()
    archived = lambda: {r.source_path.rsplit("/", 1)[1]: bytes(r.content) for r in c.snapshot().read_parts("archive").collect()}
    assert archived()["b.json"] == first_bytes

    manifest(given / "b.json", 4, ["u3", "u5", "u1"])  # u2 and only-b are no more said by it
    before = c.snapshot()
    assert commands.ingest(c, "", [str(given / "b.json")], force=True) == 1
    fresh = Catalog(spark, str(tmp_path / "fresh"))
    for name in ("a.json", "c.json", "b.json"):
        commands.ingest(fresh, "", [str(given / name)])
    fresh.update(lambda snap: {"avatar_urls": catalog.record_outcomes(snap.read("avatar_urls"), outcomes, F.current_timestamp())})
    now = facts(c.read("avatar_urls"))
    assert now == facts(fresh.read("avatar_urls")) and {x[0] for x in now} == {"u1", "u2", "u3", "u4", "u5", "only-a"}
    assert next(x for x in now if x[0] == "u2")[-2:] == ("downloaded", "s2")  # what was downloaded stays
    assert c.read("exports").count() == 3 and archived()["b.json"] == (given / "b.json").read_bytes()
    assert commands.ingest(c, "", [str(given / "b.json")], force=True) == 1 and facts(c.read("avatar_urls")) == now  # counts nothing twice

    # The snapshot of before still reads what it read, until old versions go.
    assert {r.normalized_url for r in before.read("avatar_urls").collect()} == {"u1", "u2", "u3", "u4", "only-a", "only-b"}
    assert before.read_parts("contributions").filter("normalized_url = 'only-b'").count() == 1
    assert c.vacuum() and facts(c.read("avatar_urls")) == now and c.snapshot().read_parts("contributions").select("export_path").distinct().count() == 3
    assert c.vacuum() == []


def test_many_exports_have_a_file_each_and_are_looked_up_together(spark, tmp_path, monkeypatch):
    """A part's rows meet in one file, and of many paths in a folder none is asked for on its own."""
    from curatrix.sources import manifests

    given = tmp_path / "in"
    given.mkdir()
    for i in range(40):
        manifest(given / f"{i:03}.json", i, [f"u{j}" for j in range(60)])
    (given / "odd name.json").write_bytes((given / "000.json").read_bytes())
    asked = []
    for name in ("exists", "_whole"):
        real = getattr(manifests, name)
        monkeypatch.setattr(manifests, name, lambda spark, path, name=name, real=real: asked.append((name, path)) or real(spark, path))
    c = Catalog(spark, str(tmp_path / "catalog"))
    monkeypatch.setattr(manifests, "FEW", 16, raising=False)
    paths = [str(p) for p in sorted(given.iterdir())]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where there is so much that partitions stay apart
    try:
        assert commands.ingest(c, "", [*paths, str(given / "gone.json"), str(tmp_path / "none" / "x.json")]) == 41
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(asked) == [("_whole", str(given)), ("_whole", str(given / "odd name.json")), ("exists", str(given / "gone.json")), ("exists", str(given / "odd name.json")), ("exists", str(tmp_path / "none" / "x.json"))]
    parts = list((tmp_path / "catalog" / "contributions").glob("version=*/part=*"))
    assert len(parts) == 41 and all(len(list(p.glob("*.parquet"))) == 1 for p in parts)
    assert c.read("avatar_urls").count() == 60 and c.read("exports").count() == 41
    assert manifests.discover_exports(spark, str(given)) == sorted(f"file:{p}" for p in paths)


def test_folding_touched_urls_again_is_folding_all(spark):
    """Random exports, some of which come again."""
    columns = "export_path string, file_rank int, position int, normalized_url string, original_url string, handles array<string>, display_names array<string>, source_surfaces array<string>, seen_count int, first_seen_at string, last_seen_at string, example_profile_url string, example_notification_url string, example_tweet_url string, whitelisted boolean"
    r = random.Random(9)
    rows, again = [], []
    for out, exports in ((rows, range(6)), (again, (1, 4))):
        for e in exports:
            for position in range(r.randint(0, 6)):
                a = avatar(r, f"u{r.randint(0, 8)}")
                out.append((f"e{e}", e, position, *a.values()))
    frame = lambda x: spark.createDataFrame(x, columns).withColumn("first_seen_at", F.col("first_seen_at").cast("timestamp")).withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp"))
    first, second = ledger.contributions(frame(rows), 1), ledger.contributions(frame(again), 2)
    nothing, now = spark.createDataFrame([], schema(AVATAR_URLS)), F.lit("2024-03-01").cast("timestamp")
    state = catalog.merge_into_catalog(nothing, catalog.merge_sightings(first, list(ledger.ORDER)), now)
    replaced = first.filter("export_path in ('e1', 'e4')")
    live = first.filter("export_path not in ('e1', 'e4')").unionByName(second)
    got = ledger.refold(state, live, ledger.touched_urls(replaced, second), now)
    want = catalog.merge_into_catalog(nothing, catalog.merge_sightings(live, list(ledger.ORDER)), now)
    assert facts(got) == facts(want) and got.count() < state.count() + 9


def test_of_two_writers_one_is_told(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "catalog"))
    row = lambda name: spark.createDataFrame([(name,)], "export_path string")
    assert c.snapshot().number == 0 and c.read("exports").count() == 0
    one, other = c.snapshot(), c.snapshot()
    one.write(exports=row("one"))
    with pytest.raises(Conflict):
        other.write(exports=row("other"), images=spark.createDataFrame([("x",)], "sha256 string"))
    assert [r.export_path for r in c.read("exports").collect()] == ["one"] and "images" not in c.versions()
    assert [f.name for f in (tmp_path / "catalog" / "commits").iterdir() if "crc" not in f.name] == ["000000000001.json"]

    # A change is worked out again from what holds by then.
    late = iter([True, False])

    def add(snap):
        found = snap.read("exports").unionByName(row("third"), allowMissingColumns=True)
        if next(late):
            c.write(exports=snap.read("exports").unionByName(row("second"), allowMissingColumns=True))
        return {"exports": found}

    assert c.update(add).number == 3 and {r.export_path for r in c.read("exports").collect()} == {"one", "second", "third"}
    assert c.snapshot(1).read("exports").count() == 1  # an older commit is still one snapshot
    with pytest.raises(ValueError):
        c.snapshot(9)
    gone = c.vacuum()
    assert any("/images/" in p for p in gone) and c.read("exports").count() == 3  # the late writer's files go


def test_manifests_arrive_as_a_stream(spark, tmp_path, monkeypatch):
    """Killed after a commit and before the stream's checkpoint, and resumed: the catalog is that of a batch."""
    from curatrix.streaming import manifests as stream

    given = tmp_path / "in"
    given.mkdir()
    for i, name in enumerate("abc"):
        manifest(given / f"{name}.json", i, [f"u{i}", "shared"])
    (given / "note.txt").write_text("not a manifest")
    c, checkpoint = Catalog(spark, str(tmp_path / "streamed")), str(tmp_path / "checkpoint")
    real = stream.ingest_files

    def killed(*args):
        real(*args)
        raise OSError("killed")

    monkeypatch.setattr(stream, "ingest_files", killed)
    with pytest.raises(Exception, match="killed"):
        ingest_stream(c, str(given), checkpoint, 3).awaitTermination()
    assert c.snapshot().number == 1
    monkeypatch.setattr(stream, "ingest_files", real)
    ingest_stream(c, str(given), checkpoint, 3).awaitTermination()
    assert c.snapshot().number == 1 and c.read("exports").count() == 3
    manifest(given / "d.json", 7, ["u0", "late"])
    ingest_stream(c, str(given), checkpoint, 3).awaitTermination()
    batch = Catalog(spark, str(tmp_path / "batch"))
    commands.ingest(batch, str(given))
    assert c.snapshot().number == 2 and facts(c.read("avatar_urls")) == facts(batch.read("avatar_urls"))


@pytest.mark.parametrize("seed", [2])
def test_families_grow_as_if_all_had_come_at_once(spark, seed):
    r = random.Random(seed)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()[:6]
    rows = [(f"export:{i:03d}", "positive", "gold", "export", sha(f"raw{r.randint(0, 40)}") if r.random() < 0.95 else None, sha(f"pix{r.randint(0, 40)}"), True) for i in range(60)]
    df = spark.createDataFrame(rows, "sample_id string, label string, label_tier string, source string, raw_sha string, pixel_digest string, blind_eval_eligible boolean")
    for c in set(families.MEMBER) - set(df.columns):
        df = df.withColumn(c, F.lit(None).cast("string"))
    parts = df.filter("sample_id < 'export:030'"), df.filter("sample_id between 'export:030' and 'export:044'"), df.filter("sample_id > 'export:044'")
    found, stars = families.with_stars(parts[0])
    before = families.group_records(found)
    prior = before.select("group_id", F.when(F.ascii(F.substring("group_id", 1, 1)) % 2 == 0, "train").otherwise("test").alias("split"))
    names = {x.group_key: x.split for x in before.join(prior, "group_id").collect()}
    for part in parts[1:]:
        grown = families.grow(found, stars, part)
        met = {x.id: x.component for x in grown.renamed.collect()}
        records = families.group_records(grown.samples)
        handed = {x.group_id: x.split for x in families.hand_over(prior, before, records, grown.renamed).collect()}
        keys = {x.group_id: x.group_key for x in records.collect()}
        want = {}
        for key, split in names.items():
            want.setdefault(met.get(key, key), set()).add(split)
        assert {keys[g]: s for g, s in handed.items()} == {k: "train" if "train" in s else "test" for k, s in want.items()}
        names = {keys[g]: s for g, s in handed.items()}
        found, stars, before = grown.samples, grown.stars, records
        prior = spark.createDataFrame(list(handed.items()), "group_id string, split string")
    once, once_stars = families.with_stars(df)
    key = lambda x: sorted((r.sample_id, r.group_key) for r in x.select("sample_id", "group_key").collect())
    assert key(found) == key(once) and sorted(map(tuple, stars.collect())) == sorted(map(tuple, once_stars.collect()))
