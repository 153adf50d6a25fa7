"""Chunked state against the batch, also after a restart, and near texts against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from monsoonway.operators import similarity as S
from monsoonway.operators.network import scratch_folder
from monsoonway.streaming.chunks import ChunkedHistograms


def _chunks(spark):
    nan = float("nan")
    rows = [
        [(0, "w1", "a", 1.0), (1, "w1", "a", 9.0), (2, "w1", "b", 2.0), (3, "w2", "a", 5.0), (4, "w1", "n", nan), (5, None, "a", 1.0)],
        [(6, "w1", "a", 7.0), (7, "w1", "c", 2.0), (8, "w1", "n", 4.0), (9, "w1", "i", float("inf")), (10, None, "a", 3.0)],
        [(11, "w1", "c", 8.0), (12, "w2", "a", 6.0), (13, "w2", None, 5.0), (14, "w2", None, 6.0), (15, "w1", "z", None)],
    ]
    return [spark.createDataFrame(r, "row int, week string, cell string, v double") for r in rows]


def _rows(state):
    return {(r["week"], r["v"]): r["count"] for r in state.histogram().collect()}


def test_chunks_with_seen_cells_equal_the_batch_after_a_restart(spark):
    folder = scratch_folder(spark)
    one, two, three = _chunks(spark)
    ChunkedHistograms(spark, folder, ["week"], "v", "cell").offer(one, F.col("row"))
    assert _rows(ChunkedHistograms(spark, folder, ["week"], "v", "cell")) == {("w1", 1.0): 1, ("w1", 2.0): 1, ("w2", 5.0): 1, (None, 1.0): 1}
    again = ChunkedHistograms(spark, folder, ["week"], "v", "cell")
    again.offer(two, F.col("row"))
    # a chunk that was written before the driver died, and is counted by the next one
    reduced = three.where("v is not null").groupBy("week", "cell").agg(F.min_by("v", "row").alias("v"), F.lit(1).cast("long").alias("times"))
    reduced.write.mode("append").parquet(f"{folder}/chunks")
    last = ChunkedHistograms(spark, folder, ["week"], "v", "cell")
    last.catch_up()
    want = {("w1", 1.0): 1, ("w1", 2.0): 2, ("w1", 4.0): 1, ("w2", 5.0): 2, (None, 1.0): 1}
    assert _rows(last) == want
    for chunk in (one, three):  # the same rows again change nothing
        last.offer(chunk, F.col("row"))
    assert _rows(last) == want


def test_a_batch_that_is_repeated_replaces_itself(spark):
    """The last commit of the stream is lost, as when the driver dies after the sink was written: the batch runs again and counts once."""
    folder = scratch_folder(spark)
    for chunk in _chunks(spark):
        ChunkedHistograms(spark, folder, ["week"], "v", "cell").offer(chunk, F.col("row"))
    want = _rows(ChunkedHistograms(spark, folder, ["week"], "v", "cell"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    commits = jvm.org.apache.hadoop.fs.Path(f"{folder}/state/commits")
    system = commits.getFileSystem(conf)
    last = max(int(s.getPath().getName()) for s in system.listStatus(commits) if s.getPath().getName().isdigit())
    assert last >= 2 and system.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/state/commits/{last}"), False)
    state = ChunkedHistograms(spark, folder, ["week"], "v", "cell")
    state.catch_up()
    assert _rows(state) == want


def test_chunks_of_roads_count_every_value(spark):
    state = ChunkedHistograms(spark, scratch_folder(spark), ["week"], "v")
    for chunk in _chunks(spark):
        state.offer(chunk)
    assert _rows(state) == {("w1", 1.0): 1, ("w1", 9.0): 1, ("w1", 2.0): 2, ("w1", 7.0): 1, ("w1", 4.0): 1, ("w1", 8.0): 1, ("w2", 5.0): 2, ("w2", 6.0): 2, (None, 1.0): 1, (None, 3.0): 1}
    state.offer(_chunks(spark)[0].limit(0))
    assert len(_rows(state)) == 10


def test_ratio_of_literals(spark):
    """Worked by hand: blocks bcd of abcd and bcde; of abxcd and abcd ab and cd; none."""
    table = [("abcd", "bcde", 75.0), ("abxcd", "abcd", 800 / 9), ("tide", "diet", 25.0), ("diet", "tide", 50.0), ("", "", 100.0), ("a", "", 0.0), ("abc", "xyz", 0.0), ("same", "same", 100.0)]
    found = spark.createDataFrame(table, "a string, b string, want double").withColumn("got", S.block_ratio("a", "b")).collect()
    assert all(abs(r["got"] - r["want"]) < 1e-9 for r in found)
    assert spark.createDataFrame([(None, "a")], "a string, b string").select(S.block_ratio("a", "b")).first()[0] is None


def test_normalised(spark):
    texts = [("  Rio   GRANDE! do-Sul ", "rio grande do-sul"), (None, ""), ("L’été: 5%", "l’été 5 ")]
    assert [r["got"] for r in spark.createDataFrame(texts, "t string, want string").select(S.normalised(F.col("t")).alias("got")).collect()] == [w for _, w in texts]


def _ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() * 100


def _drawn_texts(seed, n, letters="abcde "):
    draw = random.Random(seed)
    out = []
    while len(out) < n:
        base = "".join(draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 40])))
        out.append(base)
        for _ in range(3):
            t = list(base)
            for _ in range(draw.randint(0, 1 + len(t) // 5)):
                i = draw.randrange(len(t) + 1)
                t[i : i + draw.choice([0, 1])] = [draw.choice(letters)] * draw.choice([0, 1])
            out.append("".join(t))
    return out


@pytest.mark.parametrize("least", [70.0, 75.0, 90.0])
def test_near_texts_lose_no_pair(spark, least):
    texts = sorted(set(_drawn_texts(1, 260) + ["x" * 250, "x" * 240 + "y" * 9, ""]))
    want = {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if a and max(_ratio(a, b), _ratio(b, a)) > least}
    found = {tuple(r) for r in S.near_texts(spark.createDataFrame([(t,) for t in [*texts, texts[0], None]], "text string"), least).collect()}
    assert want <= found and all(a < b for a, b in found) and len(want) > 50


@pytest.mark.parametrize("least", [70.0, 75.0, 90.0])
def test_tiles_keep_every_pair_in_its_order(least):
    """Bounds leave out only what the ratio leaves out, in each order, for repeated characters, empty and long texts."""
    texts = sorted(set(_drawn_texts(2, 150) + ["", "a" * 30, "a" * 40, "ab" * 150, "ab" * 140 + "x" * 9, "é\U0001f600a", "é\U0001f600b"]))
    a, b = texts[::2] + texts[:9], texts[1::2] + texts[:9]
    ahead, back = S._alike(a, b, least)
    assert sorted(ahead) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y or _ratio(x, y) > least]
    assert sorted(back) == [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y or _ratio(y, x) > least]


def test_near_classes_compare_few_texts(spark, monkeypatch):
    """Names are compared by the ratio only after the bounds: 600 unlike names of one place, in several tiles, need next to none."""
    names = sorted({f"{k * 7919 % 26**4:05d} {k * 104729 % 99991:06d}" for k in range(600)})
    classes = spark.createDataFrame([(i, n, "here" if i % 2 else "there") for i, n in enumerate(names)] + [(9999, names[1], "hexe")], "class long, t0 string, t1 string")
    monkeypatch.setattr(S, "TILE", 64)
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and i % 2 == j % 2 and _ratio(a, b) > 90}
    assert {tuple(r) for r in S._near_classes(classes.where("class < 9999"), ["t0", "t1"], 90.0).collect()} == want
    alike = [tuple(r) for r in S._near_classes(classes, ["t0", "t1"], 70.0).where("other = 9999").collect()]
    assert (1, 9999) in alike and len(alike) == len(set(alike))


def _greedy(rows, least=75.0):
    kept = []
    for r in sorted(rows):
        a, what, where = r[1], r[2] or "", r[3] or ""
        if not any((a is not None and a == k[1]) or (_ratio(what, k[2] or "") > least and _ratio(where, k[3] or "") > least) for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_deduplication_equals_one_by_one(spark, seed):
    """Addresses, equal texts and near texts drop rows, and rows dropped drop none: in any mix, with nulls and empty texts."""
    draw = random.Random(seed)
    what, where = _drawn_texts(seed, 40, "abcdefgh "), _drawn_texts(seed + 9, 8, "klm")
    rows = [(i, draw.choice([None, *(f"u{k}" for k in range(60))]), draw.choice([*what, None, ""]), draw.choice([*where, None, ""])) for i in range(150)]
    table = spark.createDataFrame(rows, "i int, url string, what string, place string")
    found = sorted(tuple(r) for r in S.deduplicated(table, ["i"], "url", ["what", "place"]).collect())
    assert found == _greedy(rows) and 5 < len(found) < 150
    assert S.deduplicated(table.limit(0), ["i"], "url", ["what", "place"]).count() == 0


def test_near_cases_equal_one_by_one(spark):
    from monsoonway.plans import states

    rows = spark.read.parquet("/root/testdata/sf0.001/clients.parquet").distinct()
    rows = rows.select(F.struct("updated_at", "client_id", "source", "email", "name", "city", "segment", "balance", "master_id", "nation_id").alias("o"), "email", S.normalised(F.col("name")).alias("a"), S.normalised(F.col("city")).alias("b"), "client_id").collect()
    key = lambda r: tuple((v is not None, v) for v in r["o"])
    kept = []
    for r in sorted(rows, key=key):
        if not any((r["email"] is not None and r["email"] == k["email"]) or (_ratio(r["a"], k["a"]) > 75 and _ratio(r["b"], k["b"]) > 75) for k in kept):
            kept.append(r)
    found = states.near_cases(spark, "/root/testdata/sf0.001")
    assert sorted(r["client_id"] for r in found.collect()) == sorted(r["client_id"] for r in kept) and len(kept) < len(rows)


def _sliced(spark):
    from pyspark.sql.types import StructType

    from monsoonway.sources.slices import SlicedTable

    schema = StructType.fromDDL("country string, week int, v double")
    return SlicedTable(spark, scratch_folder(spark), schema, "country", ["country", "week"])


def _stored(table):
    return sorted((r["slice"], r["country"], r["week"], r["v"]) for r in table.stored().collect())


def test_slices_take_their_rows_and_repeats_add_nothing(spark):
    table = _sliced(spark)
    assert table.rows().count() == 0 and table.slices() == set()
    table.ensure_slice("ago")
    rows = spark.createDataFrame([("ago", 1, 1.0), ("AGO", 2, 2.0), ("BRA", 1, 3.0), ("BRA", 1, 3.0), ("ZMB", 1, 4.0)], table.schema)
    table.insert(rows)
    want = [("AGO", "AGO", 2, 2.0), ("AGO", "ago", 1, 1.0), ("__default__", "BRA", 1, 3.0), ("__default__", "ZMB", 1, 4.0)]
    assert _stored(table) == want
    table.insert(rows.limit(3))
    table.insert(rows.limit(0))
    assert _stored(table) == want and table.rebalance("COD") == 0 and table.slices() == {"AGO", "COD"}
    with pytest.raises(ValueError):
        table.insert(spark.createDataFrame([(None, 1, 1.0)], table.schema))
    with pytest.raises(ValueError):
        table.ensure_slice("a/b")


def test_a_move_that_breaks_off_loses_nothing_and_repeats(spark):
    class Broken(Exception):
        pass

    def broken():
        raise Broken

    table = _sliced(spark)
    table.insert(spark.createDataFrame([("BRA", w, float(w)) for w in range(5)] + [("ZMB", 1, 4.0)], table.schema))
    whole = sorted(map(tuple, table.rows().collect()))
    with pytest.raises(Broken):
        table.rebalance("bra", broken)
    # half way: the rows lie in both slices, and the table shows them once
    assert len(_stored(table)) == 11 and sorted(map(tuple, table.rows().collect())) == whole
    # a row that comes meanwhile goes to the new slice
    table.insert(spark.createDataFrame([("BRA", 9, 9.0), ("BRA", 1, 77.0)], table.schema))
    assert table.rebalance("BRA") == 5
    assert _stored(table) == sorted([*(("BRA", "BRA", w, float(w)) for w in (0, 1, 2, 3, 4, 9)), ("__default__", "ZMB", 1, 4.0)])
    assert table.rebalance("BRA") == 0 and table.rebalance("ZMB") == 1
    # the default slice is empty now
    assert {s for s, *_ in _stored(table)} == {"BRA", "ZMB"} and table.rows().count() == 7


def test_overlay_plan_reads_each_source_once(spark):
    from datetime import date

    from monsoonway.operators import overlay as O

    asked = []
    weeks = [date(2024, 1, 1 + 7 * k) for k in range(3)]

    def rain(columns, todo):
        asked.append(("rain", tuple(columns), tuple(todo)))
        return spark.createDataFrame([("a", w, float(w.day), -1.0) for w in todo[:2]], "cell string, week_start date, mm double, gust double")

    def soil(columns, todo):
        asked.append(("soil", tuple(columns), tuple(todo)))
        return spark.createDataFrame([(1, 7.0)], "road int, soil double")

    def never(columns, todo):
        raise AssertionError("a source that is off is not read")

    sources = [O.Source("rain", ("cell",), {"mm": "double", "gust": "double"}, rain), O.Source("flood", ("cell",), {"depth": "double"}, lambda c, w: None), O.Source("soil", ("road",), {"soil": "double"}, soil, weekly=False), O.Source("smoke", ("cell",), {"pm": "double"}, never)]
    roads = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "road int, cell string")
    plan = O.planned(sources, off=("smoke",))
    found = {(r["road"], r["week_start"]): (r["mm"], r["depth"], r["soil"]) for r in O.weekly_overlay(O.static_overlay(roads, plan), plan, weeks).collect()}
    assert len(found) == 9 and found[1, weeks[0]] == (1.0, None, 7.0) and found[1, weeks[2]] == (None, None, 7.0) and found[3, weeks[0]] == (None, None, None)
    assert asked == [("soil", ("soil",), ()), ("rain", ("mm", "gust"), tuple(weeks))]
    assert [(s.name, c) for s, c in O.planned(sources, ["gust", "soil", "pm"], off=("smoke",))] == [("rain", ["gust"]), ("soil", ["soil"])]
    with pytest.raises(ValueError):
        O.planned(sources, ["nobody"])
    # resume: weeks that are there are not read again, a week asked for again replaces itself
    folder, plan = scratch_folder(spark), O.planned(sources, ["mm"])
    asked.clear()
    assert O.write_weeks(roads, plan, weeks[:1], folder) == weeks[:1] and O.write_weeks(roads, plan, weeks, folder) == weeks[1:] and O.write_weeks(roads, plan, weeks, folder) == []
    assert asked == [("rain", ("mm",), tuple(weeks[:1])), ("rain", ("mm",), tuple(weeks[1:]))] and O.weeks_at(spark, folder) == set(weeks)
    O.write_weeks(roads, plan, weeks[1:2], folder, again=True)
    assert spark.read.parquet(folder).count() == 9
