import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakewarden.config import ConfigError, MatchConfig, Thresholds
from lakewarden.operators import match_exact as exact
from lakewarden.operators import match_pairs as mp
from lakewarden.operators.components import components
from lakewarden.operators.golden import duplicates, golden_master, survivors
from lakewarden.operators.keyed import Skew
from lakewarden.plans.pair_matching import PairMatching
from lakewarden.sources.store import TableStore


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def half_up(x):
    return int(x * 10000 + 0.5 + 1e-9) / 10000


def confidence(a, b):
    longer = max(len(a), len(b))
    similarity = half_up(1 - edit_distance(a, b) / longer) if longer else 0.0
    return half_up(similarity * 0.9 + 0.1 * (a.split(" ")[0] == b.split(" ")[0]))


def brute_force(records, medium, high):
    """Every pair of records in a block, as the plain definition has it."""
    found, totals = Counter(), Counter()
    for (i, n, b), (j, m, c) in itertools.permutations(records, 2):
        if b is None or b != c or i is None or j is None or not i < j:
            continue
        totals[b] += 1
        if n is None or m is None:
            continue
        score = confidence(n, m)
        if score >= medium:
            first, second = sorted((n, m), key=lambda t: (len(t), t))
            step = "AUTO_MERGE" if score >= high else "STEWARD_REVIEW"
            found[b, first, second, score, step] += 1
    return found, totals


def random_records(seed, count):
    rng = random.Random(seed)
    words = ["STORE", "EAST", "WEST", "PARK", "A", "HILL 12", "STATION", "STATIONS", "OLD"]
    names = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(count // 3)]
    records = []
    for _ in range(count):
        name = rng.choice(names)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 4])):  # typing errors
            at = rng.randrange(len(name) + 1)
            name = rng.choice([name[:at] + rng.choice("ABXYZ") + name[at:],
                               name[:at] + name[at + 1:], name[:at] + "Q" + name[at + 1:]])
        name = " ".join(name.split()) or "A"
        records.append((rng.randrange(count), name, rng.choice(["X", "X", "X", "Y", None])))
    return records + [(1, "", "X"), (2, "", "X"), (3, None, "X"), (None, "PARK", "X"),
                      (5, "PARK", "Y"), (6, "PARK", "Y"), (6, "PARK", "Y"), (5, "PARKS", "Y")]


def as_table(spark, records):
    return spark.createDataFrame(records, "id int, name string, block string")


@pytest.mark.parametrize("seed, medium, high, skew, direct, long", [
    (1, 0.80, 0.95, Skew(), 0, 64), (2, 0.80, 0.90, Skew(rows=3), 64, 10),
    (4, 0.50, 0.70, Skew(), 0, 8), (5, 0.93, 0.97, Skew(), 5, 64),
    (6, 1.0, 1.0, Skew(), 0, 64), (8, 0.80, 0.95, Skew(), 0, 0),
])
def test_pairs_equal_brute_force(spark, monkeypatch, seed, medium, high, skew, direct, long):
    monkeypatch.setattr(mp, "LONG_NAME", long)
    records = random_records(seed, 150)
    prepared = mp.prepare(as_table(spark, records), "id", "name", "block")
    members = mp.members(prepared, "id")
    scored = mp.match_names(members, Thresholds(high, medium), skew=skew, direct=direct).cache()
    expected, totals = brute_force(records, medium, high)
    got = {(r["block"], r["name_a"], r["name_b"], r["match_confidence"], r["decision"]):
           int(r["pair_count"]) for r in scored.collect()}
    assert got == dict(expected)

    report = {r["block"]: r for r in mp.block_report(members, scored).collect()}
    for block, total in totals.items():
        matched = sum(n for key, n in expected.items() if key[0] == block)
        assert int(report[block]["total_pairs"]) == total
        assert int(report[block]["reject_pairs"]) == total - matched

    scored.unpersist()


def test_first_ids_belong_to_their_names(spark):
    records = [(7, "SAME NAME", "X"), (3, "SAME NAME", "X"), (9, "SAME NAMES", "X")]
    members = mp.members(mp.prepare(as_table(spark, records), "id", "name", "block"), "id")
    got = {(r["name_a"], r["name_b"]): (r["first_id_a"], r["first_id_b"], int(r["pair_count"]),
                                        r["match_confidence"], r["decision"])
           for r in mp.match_names(members).collect()}
    assert got["SAME NAME", "SAME NAME"] == (3, 3, 1, 1.0, "AUTO_MERGE")
    assert got["SAME NAME", "SAME NAMES"] == (3, 9, 2, 0.91, "STEWARD_REVIEW")


@pytest.mark.parametrize("seed, medium, high", [(9, 0.30, 0.60), (10, 0.05, 0.50)])
def test_low_thresholds(spark, seed, medium, high):
    """Names that can hardly be cut. Halves may be rounded either way in the plain definition."""
    records = [r for r in random_records(seed, 120) if r[1]]
    members = mp.members(mp.prepare(as_table(spark, records), "id", "name", "block"), "id")
    got = {(r["block"], r["name_a"], r["name_b"], int(r["pair_count"])): r["match_confidence"]
           for r in mp.match_names(members, Thresholds(high, medium), direct=0).collect()}
    expected = {(b, x, y, n): score
                for (b, x, y, score, _), n in brute_force(records, medium, high)[0].items()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1.5e-4 for k in got)


def test_thresholds_out_of_order(spark):
    members = mp.members(mp.prepare(as_table(spark, [(1, "A", "X")]), "id", "name", "block"), "id")
    with pytest.raises(ConfigError):
        mp.match_names(members, Thresholds(0.7, 0.8))


def test_prepare_without_block(spark, rows):
    df = spark.createDataFrame([(1, "é x", None)], "id int, name string, b string")
    assert rows(mp.prepare(df, "id", "name", None), "block_norm", "match_key") == [
        ("UNKNOWN", "UNKNOWN::X")]
    assert rows(mp.prepare(df, "id", "name", "b"), "block_norm", "match_key") == [(None, "X")]
    with pytest.raises(ValueError, match="lacks"):
        mp.prepare(df, "id", "zone", None)


def test_merge_links(spark, rows):
    records = [(7, "N", "X"), (3, "N", "X"), (3, "N", "X"), (4, "M", "X"), (8, "N", "Y")]
    members = mp.members(mp.prepare(as_table(spark, records), "id", "name", "block"), "id")
    assert rows(mp.merge_links(members), "block", "name", "id", "survivor_id", "records") == [
        ("X", "N", 3, 3, 3), ("X", "N", 7, 3, 3)]


def test_zone_tables(spark, rows):
    zones = spark.createDataFrame([(1, "Old Mill"), (2, "old-mill")], "LocationID int, zone_name string")
    run = PairMatching.over_zones(zones)
    assert rows(run.scored, "block", "name_a", "decision") == [("UNKNOWN", "OLD MILL", "AUTO_MERGE")]
    assert rows(run.master(), "LocationID", "survivorship_rule") == [
        (1, "min(LocationID) per match_key")]
    with pytest.raises(ValueError, match="zone names"):
        PairMatching.over_zones(zones.drop("zone_name"))
    with pytest.raises(ValueError, match="LocationID"):
        PairMatching.over_zones(zones.drop("LocationID"))


def test_audit_of_nothing(spark):
    run = PairMatching.over(as_table(spark, []), "id", "name", "block")
    row = run.audit().first()
    assert (row["total_rows"], int(row["total_pairs_compared"]), int(row["reject_pairs"]),
            row["avg_matched_confidence"]) == (0, 0, 0, None)


def test_written_run(spark, tmp_path):
    records = [(7, "OLD MILL", "X"), (3, "OLD MILL", "X"), (9, "OLD MILLS", "X"), (9, "BAY", "X")]
    run = PairMatching.over(as_table(spark, records), "id", "name", "block")
    places = run.write(TableStore(spark, str(tmp_path / "log"), format="parquet"),
                       str(tmp_path / "out"), "job")
    audit = spark.read.json(places["audit"]).first()
    assert (audit["total_rows"], audit["total_pairs_compared"], audit["auto_merge_pairs"],
            audit["steward_review_pairs"], audit["reject_pairs"]) == (4, 5, 1, 2, 2)
    # The report does not take the evidence beside it away.
    assert spark.read.parquet(places["master"]).count() == 3
    assert spark.read.parquet(places["steward_queue"]).count() == 1
    keys = spark.read.option("header", True).csv(places["duplicate_keys"]).collect()
    assert [tuple(r) for r in keys] == [("X::OLD MILL", "2")]
    ids = spark.read.option("header", True).csv(places["duplicate_ids"]).collect()
    assert [tuple(r) for r in ids] == [("9", "2")]


def test_no_pair_of_a_block_is_formed_without_a_shared_piece(spark, plan_text):
    members = mp.members(mp.prepare(as_table(spark, [(1, "A", "X")]), "id", "name", "block"), "id")
    plan = plan_text(mp.match_names(members))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# ---------------------------------------------------------------- by key

CONFIG = MatchConfig("upper(name)")


def test_groups_by_key(spark, rows):
    df = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "B"), (4, "b"), (5, None)], "id int, name string")
    scored = exact.match_exact(df, CONFIG, skew=Skew(rows=2))
    assert rows(scored, "id", "dupe_count", "match_confidence", "decision") == [
        (1, 1, 0.99, "AUTO_MERGE"), (2, 3, 0.88, "STEWARD_REVIEW"),
        (3, 3, 0.88, "STEWARD_REVIEW"), (4, 3, 0.88, "STEWARD_REVIEW"),
        (5, 1, 0.99, "AUTO_MERGE")]
    assert rows(exact.exact_master(scored, "id"), "id", "mdm_state", "source_system",
                "survivorship_rule") == [
        (1, "ACTIVE", "raw_reference", "min(id) per match_key"),
        (5, "ACTIVE", "raw_reference", "min(id) per match_key")]
    queue = exact.review_records(scored)
    assert rows(queue, "id", "mdm_state", "submitted_by") == [
        (2, "PROPOSED", "glue_job"), (3, "PROPOSED", "glue_job"), (4, "PROPOSED", "glue_job")]
    assert exact.rejected_records(scored).count() == 0
    row = exact.exact_audit(scored, CONFIG.thresholds).first()
    assert (row["total_rows"], row["auto_merge_rows"], row["steward_review_rows"],
            row["reject_rows"]) == (5, 2, 3, 0)
    assert row["avg_match_confidence"] == pytest.approx((2 * 0.99 + 3 * 0.88) / 5)


def test_low_confidence_groups_are_rejected(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id int, name string")
    strict = MatchConfig("upper(name)", Thresholds(0.95, 0.90))
    got = exact.rejected_records(exact.match_exact(df, strict))
    assert rows(got, "id", "mdm_state") == [(1, "REJECTED"), (2, "REJECTED")]


def test_survivor_is_the_smallest_id(spark, rows, plan_text):
    df = spark.createDataFrame([(7, "k", "x"), (3, "k", "z"), (3, "k", "y"), (5, None, "n")],
                               "id int, key string, t string")
    assert rows(survivors(df, ["key"], "id")) == [(3, "k", "y"), (5, None, "n")]
    assert plan_text(survivors(df, ["key"], "id")).count("WindowGroupLimit") >= 2
    assert golden_master(df, ["key"], "id").count() == 2


def test_duplicates(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, t string")
    assert rows(duplicates(df, "id")) == [(1, 2)]
    assert duplicates(df.withColumn("u", F.col("t")), "id", "t").count() == 0


def test_both_sides_of_a_signature_make_it_heavy(spark):
    """Names on a signature are split by the comparisons it causes, not by its rows alone."""
    records = [(i, f"SITE {i:06d}", "X") for i in range(300)]
    members = mp.members(mp.prepare(as_table(spark, records), "id", "name", "block"), "id")
    split = mp.match_names(members, skew=Skew(rows=20), direct=0)
    whole = mp.match_names(members, direct=0)
    key = ("name_a", "name_b", "match_confidence")
    assert sorted(map(tuple, split.select(*key).collect())) == sorted(
        map(tuple, whole.select(*key).collect()))


def test_numbered_names_do_not_all_meet(spark):
    """The blank after a shared first word is no piece of its own."""
    records = [(i, f"SITE {i * 7919 % 1000000:06d}", "X") for i in range(600)]
    members = mp.members(mp.prepare(as_table(spark, records), "id", "name", "block"), "id")
    groups = mp.name_groups(members)
    reach = mp._reaches(Thresholds())[True]
    named = mp._cuttable(groups, [reach], Skew())
    each = F.explode(F.expr(reach.offered()))
    most = named.select(each.alias("s")).groupBy("s").count().agg(F.max("count")).first()[0]
    assert most < 600 / 3


def clusters_by_hand(records, least):
    """(block, name, id) to the smallest id and the number of records that hang together."""
    names = sorted({(b, n) for i, n, b in records if b is not None and i is not None and n})
    parent = {x: x for x in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in itertools.combinations(names, 2):
        if x[0] == y[0] and confidence(x[1], y[1]) >= least:
            parent[root(x)] = root(y)
    ids = {}
    for i, n, b in records:
        if (b, n) in parent and i is not None:
            ids.setdefault(root((b, n)), []).append(i)
    return sorted({(b, n, i, min(ids[root((b, n))]), len(ids[root((b, n))]))
                   for i, n, b in records if (b, n) in parent and i is not None})


@pytest.mark.parametrize("least", [0.95, 0.8])
def test_merge_clusters(spark, rows, least):
    chain = ["AB CDEFGHIJKLMNOPQRST"]
    for k in range(12):  # each differs from the next by a letter, the ends by many
        chain.append(chain[-1][:k + 4] + "Z" + chain[-1][k + 5:])
    records = [(100 - i, n, "X") for i, n in enumerate(chain)]
    records += [(i + 500, f"SERIAL {i:09d}", "Y") for i in range(150)]
    records += [(7, "ONE", "X"), (7, "TWO THINGS", "X"), (7, chain[0], "Y"), (3, "ONE", "X"), (3, "ONE", "X"),
                (None, "ONE", "X"), (9, "", "X"), (9, None, "X"), (9, "ONE", None)]
    members = mp.members(spark.createDataFrame(
        records, "id int, name_norm string, block_norm string"), "id")
    got = mp.merge_clusters(members, least, skew=Skew(rows=50), direct=4)
    assert rows(got, "block", "name", "id", "survivor_id", "records") == clusters_by_hand(records, least)


def test_merge_clusters_of_nothing(spark):
    members = mp.members(spark.createDataFrame([], "id int, name_norm string, block_norm string"), "id")
    assert mp.merge_clusters(members).collect() == []


def test_components(spark):
    star = spark.range(1, 100_001).selectExpr("CAST(0 AS BIGINT) AS a", "id AS b")
    chain = spark.range(200_000, 200_300).selectExpr("id AS a", "id + 1 AS b")
    odd = spark.createDataFrame([(900_005, 900_001), (900_001, 900_005), (900_009, 900_009), (None, 5),
                                 (900_003, 900_005)], "a bigint, b bigint")
    found = components(star.unionAll(chain).unionAll(odd), skew=Skew(rows=20_000))
    sizes = {r["component"]: r["count"] for r in found.groupBy("component").count().collect()}
    assert sizes == {0: 100_001, 200_000: 301, 900_001: 3}
    assert found.select("node").distinct().count() == found.count()
    assert components(odd.where("false")).collect() == []


def test_an_id_under_very_many_names(spark):
    """Ids are looked up for the pairs found, not joined with themselves."""
    many = spark.range(100_000).selectExpr(
        "0 AS id", "md5(CAST(id AS STRING)) AS name_norm", "'X' AS block_norm")
    few = spark.createDataFrame([(1, "LONG COMMON NAMES", "X"), (0, "LONG COMMON NAMEZ", "X")],
                                "id int, name_norm string, block_norm string")
    found = mp.match_names(mp.members(many.unionAll(few), "id"), Thresholds(0.95, 0.9)).collect()
    assert [(r["name_a"], r["name_b"], int(r["pair_count"])) for r in found] == [
        ("LONG COMMON NAMES", "LONG COMMON NAMEZ", 1)]
