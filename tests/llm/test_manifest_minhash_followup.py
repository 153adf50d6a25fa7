"""op11 to op13 against brute force, on odd rows, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from monsoonway.llm import fast_minhash, merkle_manifest, missing_followup, queries
from monsoonway.llm.near_copies import shingles

DATA = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, level string, tree string, component_id string, digest string"
HOUR = 3_600_000_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_fast_minhash"])
def test_query_equals_its_sql(spark, tables, name):
    want = tables.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, str(DATA)).select(*names)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


def brute_manifest(rows):
    """Each row's (leaf, subroot, root, proof, folded, verified), by lists in memory."""

    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf(r, more=0):
        n = r[4] if r[4] is None else r[4] + more
        return sha("".join(map(field, (r[0], r[3], r[2], n, r[1]))))

    def climb(level):
        """Tops, and for each place its siblings as (stands left, digest) or None by level."""
        paths, at = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, p in enumerate(paths):
                j = at[i] ^ 1
                p.append((j < at[i], level[j]) if j < len(level) else None)
            level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
            at = [x // 2 for x in at]
        return level[0], paths

    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    own = {k: sorted(trees[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for k in order}
    tops = {k: climb([leaf(r) for r in own[k]]) for k in order}
    root, above = climb([tops[k][0] for k in order])
    out = []
    for k, up in zip(order, above):
        for r, path in zip(own[k], tops[k][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf(r, 1) if bad else leaf(r)
            for s in path + up:
                node = sha(node) if s is None else sha(s[1] + node) if s[0] else sha(node + s[1])
            out.append((r[0], leaf(r), tops[k][0], root, sha("".join(s[1] for s in path + up if s)), node, node == root))
    return out


def documents(n_by_lang, draw):
    rows, i = [], 0
    for lang, n in n_by_lang:
        for _ in range(n):
            text = None if i % 13 == 0 else "ünï " * int(draw.integers(0, 6))
            rows.append((i, text, lang, ["s", None][i % 2], None if i % 5 == 0 else i, "clash", "clash", "clash", "clash"))
            i += 3
    # a repeated row, ties of an id, a null id
    return rows + [rows[0], (rows[-1][0], "other", *rows[-1][2:]), (None, "x", rows[0][2], None, None, None, None, None, None)]


@pytest.mark.parametrize("span", [1, 2, 10])
@pytest.mark.parametrize("n_by_lang", [[("en", 1)], [("en", 8), (None, 4)], [(None, 1), ("", 2), ("de", 3), ("fr", 16), ("é", 37)]])
def test_manifest_equals_brute_force(spark, n_by_lang, span):
    """Trees of one leaf, of powers of two that end at a pass's edge, and of odd widths, in passes of one, two and ten levels."""
    rows = documents(n_by_lang, np.random.default_rng(1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = merkle_manifest.verified(*merkle_manifest.manifest(docs, merkle_manifest.tampered(docs), span)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "t", None, None, 1, *["c"] * 4)], SCHEMA)
    root, found = merkle_manifest.manifest(one)
    row = found.first()
    assert bytes(row["digest"]) == root and merkle_manifest.fold(root, bytes(row["path"]))[0] == root
    root, found = merkle_manifest.manifest(one.limit(0))
    assert root is None and merkle_manifest.verified(root, found).count() == 0


def test_manifest_store_has_a_partition_for_each_level(spark):
    docs = spark.createDataFrame(documents([("en", 20)], np.random.default_rng(2)), SCHEMA)
    leaves = docs.select(F.lit("").alias("tree"), merkle_manifest.leaf_digest().alias("digest"), "doc_id", F.lit(None).cast("binary").alias("changed"))
    store = merkle_manifest.build(merkle_manifest.ranked(leaves, ["doc_id", "digest"]), 2)
    assert {r["level"]: r["count"] for r in store.nodes().groupBy("level").count().collect()} == {0: 23, 1: 12, 2: 6, 3: 3, 4: 2, 5: 1}
    assert store.passes == 3 and store.tops().count() == 1


def brute_minhash(rows):
    def words(text):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()

    sets = [set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set() for w in (words(r[1]) for r in rows)]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and root[i] != root[j] and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    least = {}
    for r, k in zip(rows, root):
        if r[0] is not None:
            least[k] = min(least.get(k, r[0]), r[0])
    return [(r[0], len(s), least.get(k), r[0] is not None and r[0] == least.get(k)) for r, s, k in zip(rows, sets, root)]


def test_minhash_equals_brute_force(spark):
    draw = np.random.default_rng(4)
    vocabulary = [f"W{i}" for i in range(400)]
    texts = []
    for n in (1, 2, 6, 30, 90, 200):
        for _ in range(4):
            base = draw.choice(vocabulary, n).tolist()
            texts.append(" ".join(base))
            for k in (1, 2, 4, 9):  # near copies about the threshold
                other = list(base)
                for at in draw.integers(0, n, max(1, n * k // 100)):
                    other[at] = str(draw.choice(vocabulary))
                texts.append("\t".join(other).lower() if k == 2 else " ".join(other))
    texts += ["", None, " \n ", "one", "ONE", "a b", "A\x0bB ", "İ b", "i̇ b", texts[9], "x" * 200_000, " ".join(f"v{i}" for i in range(60_000)), " ".join(f"v{i}" for i in range(59_000))]
    rows = [(i, t, "en", "s", 1, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[3], *rows[3][2:]), (None, "nobody else says so", *rows[3][2:]), (None, None, *rows[3][2:])]
    found = fast_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(brute_minhash(rows), key=key)
    assert fast_minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketches_are_full_and_estimate_likeness():
    draw = np.random.default_rng(5)
    own = [draw.integers(0, 1 << 63, n, dtype=np.uint64) for n in (1, 2, 3, 50, 5000)]
    found = fast_minhash.sketches(own, 64)
    assert found.shape == (5, 64) and (found != np.uint64((1 << 64) - 1)).all()
    # taken alone or together, in any order, with repeats
    assert all((fast_minhash.sketches([np.concatenate([s[::-1], s])], 64)[0] == f).all() for s, f in zip(own, found))
    # the first rounds fill a one-element set in part only; the last t rounds place it everywhere
    assert {int(x) >> 32 for x in found[0]} & set(range(64, 128))
    for share in (0.2, 0.5, 0.8, 0.95):
        both = draw.integers(0, 1 << 63, 1000, dtype=np.uint64)
        n = int(round(1000 * share))
        a = np.concatenate([both[:n], draw.integers(0, 1 << 63, (1000 - n) // 2, dtype=np.uint64)])
        b = np.concatenate([both[:n], draw.integers(0, 1 << 63, (1000 - n) // 2, dtype=np.uint64)])
        x, y = fast_minhash.sketches([a, b], 2000)
        assert abs((x == y).mean() - share) < 0.04


def test_sketches_evaluate_few_hashes(monkeypatch):
    """A set of n elements costs about n + t log t hashes, not n t."""
    taken = []
    mixed = fast_minhash._mixed
    monkeypatch.setattr(fast_minhash, "_mixed", lambda x, i: taken.append(len(x)) or mixed(x, i))
    t = 180
    for n in (1, 20, 1000, 20_000):
        taken.clear()
        fast_minhash.sketches([shingles([f"w{n}-{i}".encode() for i in range(n + 1)], 2)], t)
        assert sum(taken) <= 3 * (n + t * np.log(t))


def brute_alerts(events, batches=8, period=24 * HOUR, lateness=96 * HOUR):
    """Alerts and late events of (batch, client, at, kind), each client's events sorted in memory."""
    marks, most = [], None
    for b in range(batches):
        marks.append(None if most is None else most - lateness)
        most = max([x for x in [most] if x is not None] + [e[2] for e in events if e[0] == b], default=None)
    out, late, own = [], defaultdict(int), defaultdict(list)
    for b, c, at, kind in events:
        if marks[b] is not None and at < marks[b]:
            late[b, c] += 1
        else:
            own[c].append((at, kind))
    for c, mine in own.items():
        now, done = None, []
        for at, kind in sorted(mine):
            if now and at > now[1]:
                done.append(now)
                now = None
            if kind == 1:
                now = None
            else:
                now = now or [at, at + period, 0]
                now[2] += 1
        for first, due, n in done + [now] * bool(now):
            out.append((next((b for b in range(batches) if marks[b] is not None and marks[b] > due), batches), c, first, due, n))
    return sorted(out + [(b, c, -1, -1, n) for (b, c), n in late.items()])


def test_followup_query_equals_brute_force(spark, tables):
    start = 1_704_067_200_000_000
    clicks = tables.execute("select click_id, epoch_us(arrived_at), client_id, epoch_us(ts) from (select distinct * from clicks where kind = 'error') where client_id is not null and ts is not null").fetchall()
    sales = tables.execute("select sale_id, epoch_us(arrived_at), client_id, epoch_us(sold_at) from sales where client_id is not null and sold_at is not null").fetchall()
    events = [(min(7, ((a - start) // HOUR + 80 * (zlib.crc32(str(i).encode()) % 4)) * 8 // 3648), c, at, kind) for kind, rows in ((0, clicks), (1, sales)) for i, a, c, at in rows]
    found = sorted(map(tuple, queries.op13_missing_followup(spark, str(DATA)).collect()))
    assert found == brute_alerts(events) and any(r[2] >= 0 for r in found) and any(r[2] < 0 for r in found)


@pytest.mark.parametrize("seed", range(3))
def test_followup_on_drawn_events(spark, seed):
    """Ties, limits met exactly, late events, an empty batch, a hot client, a client who never buys; few buckets."""
    draw = np.random.default_rng(seed)
    events = []
    for _ in range(600):
        batch = int(draw.choice([0, 1, 2, 4]))
        at = int((batch * 60 + draw.integers(-70, 80)) * HOUR // 1)
        client = int(draw.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]))
        events.append((batch, client, at, 0 if client == 2 else int(draw.integers(0, 2))))
    events += [(0, 8, 0, 0), (0, 8, 24 * HOUR, 1), (0, 9, 0, 0), (0, 9, 24 * HOUR + 1, 1), (0, 10, 5, 0), (0, 10, 5, 1), (0, 10, 6, 0), (0, 11, 0, 0), (0, 11, 24 * HOUR, 0), (0, 11, 24 * HOUR + 1, 0)]
    table = spark.createDataFrame([(*e, 1) for e in events], "batch int, client_id long, at long, kind int, n long")
    found = missing_followup.follow(table, 5, buckets=3).collect()
    assert sorted(map(tuple, found)) == brute_alerts(events, 5)


def test_thinning_changes_nothing_and_shrinks_a_hot_client():
    """The same events with and without thinning, and a hot client that buys often is left with a few rows a period."""
    import pyarrow as pa

    draw = np.random.default_rng(7)
    at = np.sort(draw.integers(0, 20 * 24 * HOUR, 5000))
    kind = draw.integers(0, 2, 5000)
    batch = pa.record_batch([pa.array(np.zeros(5000, np.int32)), pa.array(np.ones(5000, np.int64)), pa.array(at), pa.array(kind.astype(np.int32)), pa.array(np.ones(5000, np.int64))], ["batch", "client_id", "at", "kind", "n"])
    mark = 3 * 24 * HOUR
    (thin,) = missing_followup.thinned(mark, 24 * HOUR)([batch])
    assert thin.num_rows < 150
    results = []
    for rows in (batch, thin):
        bucket = missing_followup.Bucket()
        columns = [rows.column(i).to_numpy() for i in (1, 2, 3, 4)]
        first = bucket.advance(mark, *columns)
        again = missing_followup.Bucket(bucket.held())  # through the stored form
        results.append((first, again.advance(missing_followup.EVER, *[np.zeros(0, np.int64)] * 4)))
    assert results[0] == results[1] and results[0][0][0] == {1: int((at < mark).sum())}


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, batch string, at string"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, kind string, n string"


def test_followup_on_odd_rows(spark):
    from datetime import datetime as day

    early, later = day(2024, 1, 2), day(2024, 1, 3, 1)
    click = (1, early, early, 7, "error", None, None, "clash", "clash")
    clicks = [click, click, (1, early, early, 7, "error", 1.0, None, "clash", "clash"), (2, None, early, 7, "error", None, None, None, None), (3, early, early, None, "error", None, None, None, None),
              (4, early, None, 8, "error", None, None, None, None), (None, early, day(2023, 12, 1), 9, "error", None, None, None, None), (5, early, early, 7, None, None, None, None, None)]
    sales = [(1, 9, later, later, "clash", "clash"), (2, 9, None, later, None, None), (3, None, later, later, None, None)]
    read = lambda c, s: missing_followup.events_of(spark.createDataFrame(c, CLICKS), spark.createDataFrame(s, SALES))
    at = int((early - day(1970, 1, 1)).total_seconds()) * 1_000_000
    due = at + 24 * HOUR
    # client 8 comes in the last batch, where nothing is late as W is 96 hours behind; client 9's sale is an hour too late
    assert sorted(map(tuple, missing_followup.follow(read(clicks, sales), buckets=2).collect())) == [(8, 7, at, due, 2), (8, 8, at, due, 1), (8, 9, at, due, 1)]
    assert missing_followup.follow(read([], []), buckets=2).count() == 0
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert {r["at"] for r in read(clicks, []).collect()} == {at}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
