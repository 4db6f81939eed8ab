"""Readers and writers on small files."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from segue.plans import corpus as C
from segue.plans import metrics as M
from segue.schema import AXES
from segue.sources import features, generate, results, slices, submission, zips
from segue.streaming import popularity as stream


def track(i):
    return {"pos": i, "artist_name": f"A{i % 2}", "track_uri": f"spotify:track:t{i}", "artist_uri": f"spotify:artist:a{i % 2}", "track_name": f"T{i}", "album_uri": "al", "album_name": "Al", "duration_ms": 1}


DOC = {"info": {"slice": "0-1"}, "playlists": [
    {"name": "Throwback", "collaborative": "false", "pid": 0, "tracks": [track(0), track(1), track(2)]},
    {"name": "chill vibes", "collaborative": "false", "pid": 1, "tracks": [track(1), track(3)]},
]}
LATER = {"playlists": [{"pid": 1000, "tracks": [track(1) | {"track_name": "other"}, track(9)]}]}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "mpd.slice.0-1.json").write_text(json.dumps(DOC, indent=1))
    (tmp_path / "mpd.slice.1000-1999.json").write_text(json.dumps(LATER))
    (tmp_path / "notes.txt").write_text("no")
    return tmp_path


def test_slices(spark, folder, tmp_path_factory):
    c = slices.load(spark, str(folder), max_slices=1)
    assert c.playlists.count() == 2 and {r.track[-2:] for r in c.tracks.collect()} == {"t0", "t1", "t2", "t3"}
    order = c.interactions.filter("pid = 0").orderBy("pos").collect()
    assert [r.track[-2:] for r in order] == ["t0", "t1", "t2"]
    artist = {r.track[-2:]: r.artist for r in c.tracks.collect()}
    assert artist["t0"] == artist["t2"] == "spotify:artist:a0"
    assert slices.load(spark, str(folder), max_playlists=1).playlists.count() == 1
    both = slices.load(spark, str(folder))
    assert both.tracks.filter("track like '%t1'").first().track_name == "T1"
    assert both.playlists.filter("pid = 1000").first().title == ""
    with pytest.raises(FileNotFoundError):
        slices.load(spark, str(tmp_path_factory.mktemp("empty")))


def test_statistics_and_pruning(spark, folder):
    c = slices.load(spark, str(folder), max_slices=1)
    stats = {r.track[-2:]: r["count"] for r in C.track_stats(c.interactions).collect()}
    assert stats == {"t0": 1, "t1": 2, "t2": 1, "t3": 1}
    assert C.corpus_stats(c.interactions).first().n_interactions == 5
    p = C.prune(c, 2)
    assert sorted((r.pid, r.pos, r.track[-2:]) for r in p.interactions.collect()) == [(0, 0, "t1"), (1, 0, "t1")]
    keep = spark.createDataFrame([("spotify:track:t3",)], "track string")
    assert C.prune(c, 2, keep).interactions.count() == 3
    assert C.prune(c, 99).playlists.count() == 0
    again = spark.createDataFrame([(7, 0, "x"), (7, 1, "x"), (8, 0, "x")], "pid long, pos long, track string")
    assert {r.pid: r.cnt for r in C.counts(again).collect()} == {7: 2, 8: 1} and {r.cnt for r in C.counts(again, binary=True).collect()} == {1}


def test_zip(spark, tmp_path):
    path = str(tmp_path / "m.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data/mpd.slice.1000-1999.json", json.dumps(LATER))
        z.writestr("data/mpd.slice.0-999.json", json.dumps(DOC))
        z.writestr("data/readme.txt", "x")
        z.writestr("challenge_set.json", json.dumps({"playlists": [{"pid": 5, "num_samples": 1, "num_holdouts": 4, "tracks": [track(1)]}, {"pid": 6, "name": "n", "tracks": []}]}))
    assert [m.split(".")[-2] for m in zips.members(path)] == ["0-999", "1000-1999"]
    assert zips.load(spark, path).playlists.count() == 3
    assert zips.load(spark, path, max_slices=1).interactions.count() == 5
    ch = {r.pid: r for r in zips.read_challenge(spark, path).collect()}
    assert ch[5].title is None and ch[5].tracks == ["spotify:track:t1"] and ch[5].num_holdouts == 4 and ch[6].tracks == []


def test_features(spark, tmp_path):
    (tmp_path / "f.csv").write_text("track_uri,tempo,genre:rap\nt1,0.2,\nt2,,1\nt1,0.9,0.5\n")
    got = {r.track: r.axes for r in features.read_axis_csv(spark, str(tmp_path / "f.csv")).collect()}
    assert got["t1"][0] == 0.9 and got["t2"][0] == 0.5 and got["t2"][AXES.index("genre:rap")] == 1 and got["t1"][1] == 0.5
    rows = [("a", 140.0, 2.0, None, float("nan"), 0.1), ("a", 250.0, 0.0, 0.0, 0.0, 0.0), ("b", 20.0, -1.0, 0.3, math.inf, 1.5)]
    spark.createDataFrame(rows, "id string, tempo double, energy double, valence double, acousticness double, instrumentalness double").write.parquet(str(tmp_path / "au"))
    tracks = spark.createDataFrame([("x:track:a",), ("x:track:b",), ("x:track:c",)], "track string")
    f = features.attach_audio(tracks, features.read_audio(spark, str(tmp_path / "au")))
    got = {r.track[-1]: [round(x, 3) for x in r.axes[:5]] for r in f.collect()}
    assert got == {"a": [0.5, 1.0, 0.5, 0.5, 0.9], "b": [0.0, 0.0, 0.3, 0.5, 0.0]}
    assert features.matched(tracks, f).first().n_matched == 2


def test_generated_corpus(spark):
    c = generate.make(spark, 120, 300, seed=3)
    lens = [r["n"] for r in c.interactions.groupBy("pid").agg(F.count("*").alias("n")).collect()]
    assert len(lens) == 120 and min(lens) >= 5 and max(lens) <= 250
    assert c.interactions.dropDuplicates(["pid", "track"]).count() == c.interactions.count()
    assert c.features.count() == 300 and len(c.features.first().axes) == len(AXES)
    assert c.playlists.filter("title = ''").count() < 30
    shares = [r["share"] for r in M.shares(c.interactions.join(c.tracks, "track"), "home").collect()]
    assert len(shares) == 10 and abs(sum(shares) - 1) < 1e-4
    one = c.interactions.join(c.tracks, "track").groupBy("pid", "home").agg(F.count("*").alias("n")).groupBy("pid").agg((F.max("n") / F.sum("n")).alias("top")).agg(F.avg("top")).first()[0]
    assert 0.6 < one < 0.95  # mostly one archetype
    again = generate.make(spark, 120, 300, seed=3)
    assert again.interactions.exceptAll(c.interactions).count() == 0


def test_submission(spark, tmp_path):
    recs = spark.createDataFrame([(1, 1, "spotify:track:a"), (1, 2, "spotify:track:b"), (2, 1, "spotify:track:a")], "case_id long, rank long, track string")
    path = str(tmp_path / "s")
    submission.write(recs, path, "team", "me@x.org")
    assert submission.validate(spark, path).count() == 0
    seeds = spark.createDataFrame([(2, "spotify:track:a")], "case_id long, track string")
    assert [r.line for r in submission.validate(spark, path, seeds).collect()] == [4]
    submission.write(recs, path, "team", "me@x.org", gzip=True)
    assert submission.validate(spark, path).count() == 0
    big = ",".join(f"spotify:track:{i}" for i in range(501))
    bad = ["team_info,t", "x,spotify:track:a", "1,spotify:track:a,spotify:track:a", "1,zzz", f"2,{big}"]
    errs = submission.validate_lines(spark.createDataFrame([(i + 1, v) for i, v in enumerate(bad)], "line long, value string")).collect()
    assert sorted((e.line, e.error.split()[0]) for e in errs) == [(1, "first"), (2, "pid"), (3, "pid"), (4, "bad"), (4, "duplicate"), (5, "pid")]
    assert submission.validate_lines(spark.createDataFrame([(1, "")], "line long, value string")).first().error == "missing team_info line"
    with open(str(tmp_path / "long.csv"), "w") as f:  # read in several splits: line numbers still count from the file's first line
        f.write("team_info,t,a@b.c\r\n" + "".join(f"{i},spotify:track:a\n" if i % 1000 else "x\n" for i in range(1, 20_001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert sorted(e.line for e in submission.validate(spark, str(tmp_path / "long.csv")).collect()) == [i + 1 for i in range(1000, 20_001, 1000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    quoted = spark.createDataFrame([('a, "b, ""c""" ,,d',), ("",), ('"x"',)], "v string").select(submission.fields(F.col("v"))).collect()
    assert [r[0] for r in quoted] == [["a", 'b, "c"', "", "d"], [""], ["x"]]
    submission.write_both(recs.filter("case_id = 1"), str(tmp_path / "both"), "team", "me@x.org", 2)
    assert submission.validate(spark, str(tmp_path / "both/plain")).count() == submission.validate(spark, str(tmp_path / "both/gzip")).count() == 0
    with pytest.raises(ValueError, match="case 2"):
        submission.write_both(recs, str(tmp_path / "bad"), "team", "me@x.org", 2)
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    pop = spark.createDataFrame([(f"spotify:track:{c}", i + 1) for i, c in enumerate("abcdef")], "track string, pop_rank long")
    full = submission.build(recs, cases, seeds, pop, 4).collect()
    by = {c: [r.track[-1] for r in sorted(full, key=lambda r: r.rank) if r.case_id == c] for c in (1, 2, 3)}
    assert by == {1: list("abcd"), 2: list("bcde"), 3: list("abcd")}


def test_reports(spark, tmp_path):
    rows = [("hybrid", "OVERALL", 5, 0.3, 0.5, 2.0), ("als", "OVERALL", 5, 0.2, 0.4, 3.0), ("item_cf", "OVERALL", 5, 0.25, 0.4, 3.0), ("track2vec", "OVERALL", 5, 0.1, 0.4, 9.0), ("popularity", "OVERALL", 5, 0.15, 0.4, 5.0), ("title", "title_only", 5, 0.2, 0.2, 1.0), ("title", "OVERALL", 5, 0.18, 0.2, 3.0), ("hybrid", "title_only", 5, 0.1, 0.2, 1.0)]
    df = spark.createDataFrame(rows, results.RESULTS)
    results.write_csv(df, str(tmp_path / "r"))
    back = results.read_csv(spark, str(tmp_path / "r"))
    assert back.count() == len(rows)
    v = {r.conclusion: r.verdict for r in results.verdicts(back, back).collect()}
    assert v["hybrid beats als and item_cf"] == "held" and v["track2vec is weakest"] == "held" and v["title wins cold start"] == "held"
    assert v["popularity strong on clicks"] == "didn't hold" and "routed beats hybrid" not in v and v["tier order"] == "held"
    assert [r.model for r in results.overview(back).orderBy("place").collect()][:2] == ["item_cf", "hybrid"]
    assert "| als |" in results.markdown(back) and results.scenario_grid(back).count() == 2
    results.write_meta(spark, {"a": 1}, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"a": 1}'
    ab = spark.createDataFrame([("trust", "honest", 0.2, 0.31, 1.0), ("trust", "bad", 0.2, 0.3, 1.0), ("k", "honest", 1.0, 0.1, 1.0)], "knob string, mode string, trust double, r_precision double, clicks double")
    assert results.trust_curve(ab).count() == 2


def test_stream_of_slices(spark, folder, tmp_path):
    got = stream.run_available(stream.track_counts(spark, str(folder / "mpd.slice.*"), 1), "counts", str(tmp_path / "ck"))
    assert {r.track[-2:]: r["count"] for r in got.collect()} == {"t0": 1, "t1": 3, "t2": 1, "t3": 1, "t9": 1}


def test_listed_drops_repeats_and_seeds_and_fills_up(spark):
    lists = spark.createDataFrame([(1, ["a", "b", "a", "s"]), (2, ["d", "c", "b", "a"])], "case_id long, tracks array<string>")
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    seeds = spark.createDataFrame([(1, "s"), (1, "p")], "case_id long, track string")
    popular = spark.createDataFrame([("p", 1), ("b", 2), ("q", 3), ("r", 4)], "track string, pop_rank long")
    got = {r.case_id: r.tracks for r in submission.listed(lists, cases, seeds, popular, 3).collect()}
    assert got == {1: ["a", "b", "q"], 2: ["d", "c", "b"], 3: ["p", "b", "q"]}
