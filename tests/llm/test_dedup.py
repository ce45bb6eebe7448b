"""Exact, near and byte-string dedup and sharding, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crestline.llm import near_dedup as N
from crestline.llm import queries as Q
from crestline.llm import rolling as R
from crestline.llm import sharding as S
from crestline.llm import suffix_dedup as X
from crestline.llm.components import components
from crestline.llm.exact_dedup import exact_dedup
from crestline.llm.line_templates import Rules, drop_recurring_lines
from crestline.llm.screen import bits_for, hits, key_bitmap, with_hit
from crestline.llm.skew import join_groups

from .brute import line_templates, without_recurring_lines

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(3)


ODD = [(5, None), (6, ""), (7, " \n"), (None, "null id"), (8, "x y"), (8, "x y"), (9, "X  y"), (10, "xy")]


def test_exact_cases(spark):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(spark, ODD)).collect()}
    assert got == {(5, 7, 3, False), (6, 7, 3, False), (7, 7, 3, True), (None, None, 1, True), (8, 8, 3, True), (9, 9, 1, True), (10, 8, 3, False)}
    assert exact_dedup(docs(spark, [])).count() == 0


def test_exact_keeps_the_longest_original(spark):
    got = {r.doc_id: r.keep_id for r in exact_dedup(docs(spark, [(1, "ab"), (2, "a b"), (3, "a\tb")])).collect()}
    assert got == {1: 2, 2: 2, 3: 2}


def test_exact_excludes_collisions(spark):
    weak = lambda norm: F.unhex(F.lit("00"))
    rows = [(1, "a"), (2, "b"), (3, "a "), (None, " c"), (4, "c")]
    for options in ({"hash_of": weak}, {"hash_of": weak, "digest_of": weak}):
        got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(docs(spark, rows), **options).collect()}
        assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), None: (None, 2), 4: (None, 2)}


def test_exact_groups_of_long_texts(spark):
    wide = [(i, f"{i} " * 400) for i in range(300)] + [(900, "twin " * 300), (901, "twin " * 300)]
    got = {r.doc_id: r.group_size for r in exact_dedup(docs(spark, wide)).collect()}
    assert {i for i, n in got.items() if n > 1} == {900, 901}


def test_screen_lets_all_keys_through(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    rows = spark.range(20000).withColumn("key", F.xxhash64("id"))
    out = with_hit(rows, F.col("key"), keys, "k", 5000, "hit").select("id", "hit").collect()
    assert len(out) == 20000 and all(r.hit for r in out if r.id < 5000) and sum(r.hit for r in out) < 5200
    bitmap = key_bitmap(keys, "k", bits_for(5000))
    h = np.array([r.key for r in rows.collect()], np.int64)
    assert hits(bitmap, bits_for(5000), h).sum() == sum(r.hit for r in out)


def test_hot_groups_are_spread(spark):
    """The second join's key holds more than the group's, so a group's rows part; none is lost."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k % 3 < 2")
    out = join_groups(rows, groups, ["k"], "n", 3000)
    assert {r.id: r.n for r in out.collect()} == {i: (1500 if i < 1500 else 1 if i % 3 < 2 else None) for i in range(3000)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftOuter, \(\(k#\d+L = _k#\d+L\) AND \(_from#\d+L = _to#\d+L\)\)", plan), plan


def test_exact_matches_sql(spark, duck):
    folder = "/root/testdata/sf0.001"
    got = sorted(map(tuple, Q.QUERIES["op1_exact_dedup"](spark, folder).collect()))
    assert got == sorted(duck(folder).execute(Q.ORACLES["op1_exact_dedup"]).fetchall())


def check_shards(rows, shards, total):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for k, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs))) and 0 <= k < shards
    return [sum(r.size for r in by[k]) for k in range(shards)]


def test_shards_are_even_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abc ", k=rng.randrange(20, 400)))) for i in range(3000)] + [(5000 + i, "the same text " * 12) for i in range(1500)]
    got = S.shard_by_bytes(docs(spark, rows), 24).collect()
    sizes = check_shards(got, 24, len(rows))
    mean = sum(sizes) / 24
    assert len(got) == len(rows) and max(sizes) < 1.03 * mean and min(sizes) > 0.97 * mean
    again = S.shard_by_bytes(docs(spark, rows), 24).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shard_groups_stay_together(spark):
    rows = [(i, f"text {i // 2} " * 20) for i in range(4000)]
    at = {r.doc_id: r.shard for r in S.shard_by_bytes(docs(spark, rows), 8).collect()}
    assert all(at[i] == at[i + 1] for i in range(0, 4000, 2))


def test_shard_cases(spark):
    got = S.shard_by_bytes(docs(spark, ODD), 24).collect()
    check_shards(got, 24, len(ODD))
    assert sorted(r.size for r in got) == sorted(len((t or "").encode()) + 8 for _, t in ODD) and all(r.grown_shard is None and r.law == "bytes" for r in got)
    assert S.shard_by_bytes(docs(spark, []), 24).count() == 0


def test_ranges_by_binary_search(spark):
    bounds = [(1, 0, 0), (1, 5, 2), (1, 5, 3), (3, -2, 0), (9, 9, 1)]
    keys = [(h, k, u) for h in range(-1, 11) for k in (-3, 0, 5, 9) for u in range(4)]
    got = spark.createDataFrame(keys, "h bigint, k bigint, u bigint").select("h", "k", "u", S.range_of(bounds).alias("r")).collect()
    assert all(r.r == sum(b <= (r.h, r.k, r.u) for b in bounds) for r in got)


SAME = "all of these rows are equal in text and id " * 4
KINDS = {
    "null ids": [(None, SAME)] * 1200,
    "one giant": [(9000, "g" * 90_000), *[(9001 + i, "g") for i in range(300)]],
    "one id": [(77, SAME)] * 1200,
    "empty texts": [(9000 + i, None if i % 3 else "") for i in range(4000)],
    "empty texts of one id": [(7, "")] * 4000,
    "pairs": [(9000 + i, f"pair {i // 2} " * 9) for i in range(600)],
}


def brute_shards(keyed, shards):
    """(id, size, crc, shard, slot) from rows with (h, k, u): midpoints of bytes in key order, small groups as one."""
    rows = sorted(keyed, key=lambda r: (r.h, r.k, r.u))
    total, at, group = sum(r.size for r in rows), 0, Counter()
    for r in rows:
        group[r.h] += r.size
    begin, out, slots = {}, [], Counter()
    for r in rows:
        begin.setdefault(r.h, at)
        twice = 2 * begin[r.h] + group[r.h] if group[r.h] * shards * S.WHOLE_GROUP <= total else 2 * at + r.size
        shard = min(shards - 1, twice * shards // (2 * total))
        out.append((r.id, r.size, r.crc, shard, slots[shard]))
        slots[shard] += 1
        at += r.size
    return out


@pytest.mark.parametrize("kind", KINDS)
def test_ranges_are_subdivided_until_none_is_overfull(spark, kind):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("abc ", k=200))) for i in range(400)] + KINDS[kind]
    slim = S.keyed(docs(spark, rows)).withColumn("u", F.monotonically_increasing_id()).cache()
    mean, mean_rows = sum(len((t or "").encode()) + 8 for _, t in rows) / 192, len(rows) / 192
    bounds, sums = S.ranges_of(slim, 192, mean, mean_rows, 3)
    assert all((b <= 2 * mean and n <= 2 * mean_rows) or n == 1 for b, n in sums.values())
    got = S.shard_by_bytes(docs(spark, rows), 24).collect()
    sizes = check_shards(got, 24, len(rows))
    told = lambda r: (r[0] is not None, r)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=told) == sorted(brute_shards(slim.collect(), 24), key=told)
    if kind != "one giant":
        assert max(sizes) < 1.1 * sum(sizes) / 24


# byte strings


def removed(rows, width=200):
    count = Counter(b[p : p + width] for b in ((t or "").encode() for _, t in rows) for p in range(len(b) - width + 1))
    out = defaultdict(list)
    for i, t in rows:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                cover[p : p + width] = True
        runs = int(np.sum(cover & ~np.concatenate([[False], cover[:-1]])))
        kept = bytes(c for c, g in zip(b, cover) if not g)
        out[i].append((len(b), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def repeats(df):
    out = defaultdict(list)
    for r in X.remove_repeats(df).collect():
        out[r.doc_id].append((r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("cell, part", [(1000, 1 << 20), (3, 1 << 20), (5, 300)])
def test_repeats_match_brute_force(spark, monkeypatch, cell, part):
    """Also with cells that small groups overfill, and texts in parts."""
    monkeypatch.setattr(X, "CELL", cell)
    monkeypatch.setattr(R, "SLICE", part)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh éñ\n", k=n))
    base = [text(900) for _ in range(5)]
    rows = []
    for k in range(150):
        b, x = rng.choice(base), rng.randrange(700)
        t = text(rng.randrange(300)) + b[x : x + rng.choice([150, 190, 200, 201, 260, 400])] + text(rng.randrange(300))
        kind = rng.random()
        t = "a" * rng.choice([199, 200, 201, 900]) if kind < 0.1 else ("abcdefg" * 200)[: rng.randrange(900)] if kind > 0.92 else t
        rows.append((k if kind < 0.96 else None, t))
    rows += [*rows[:2], (900, None), (901, "")]
    assert repeats(docs(spark, rows)) == removed(rows)
    assert X.remove_repeats(docs(spark, [])).count() == 0


def test_suffix_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    suffix = rng.permutation(360)
    cell = np.sort(rng.integers(0, 4, 360))
    order = X.SuffixSorter(data, 40).sort(suffix, cell)
    key = lambda i: (cell[i], data[suffix[i] : suffix[i] + 40].tobytes())
    assert [key(i) for i in order] == sorted(key(i) for i in range(360))


def test_parts_of_long_texts_hold_every_window_once(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab é", k=k)) for k in (0, 150, 5000, 10, 700, 2300)]
    seen = Counter()
    for lo, _, data, offs, start in R.chunks(pa.array(texts), 200, 500):
        for d in range(len(offs) - 1):
            for p in range(offs[d], offs[d + 1] - 199):
                seen[lo + d, p - offs[d] + start, data[p : p + 200].tobytes()] += 1
    want = {(i, p, b[p : p + 200]) for i, b in enumerate(t.encode() for t in texts) for p in range(len(b) - 199)}
    assert set(seen) == want and set(seen.values()) == {1}


def test_collisions_start_again_with_other_bases(spark, monkeypatch):
    tried, spans = [], X._spans
    # hashes of workers are real; a driver-side stand-in shows the way back
    monkeypatch.setattr(X, "_spans", lambda rows, width, seed: tried.append(seed) or (_ for _ in ()).throw(X._Collision()) if seed == 0 else spans(rows, width, seed))
    rows = [(1, "xyz " * 100), (2, "q"), (3, "xyz " * 80)]
    assert repeats(docs(spark, rows)) == removed(rows) and tried == [0]


def test_hash_collisions_are_redone_on_bytes(monkeypatch):
    bodies = [b"x" * 100 + bytes([97 + i]) * 100 for i in (0, 1, 0)]
    monkeypatch.setattr(X.SuffixSorter, "extension", lambda self, i, j: np.full(len(i), 200))
    masks = X.repeated_windows(bodies, np.zeros(3, int), np.zeros(3, int), np.ones(3, int), 200)
    assert masks.tolist() == [1, 0, 1]


# near duplicates


def shingles(t, n):
    w = re.findall(r"[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def linked(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    low = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        low[find(a)].append(i)
    return {i: (len(s), min(low[find(a)])) for a, (i, s) in enumerate(sets)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choices(vocab, k=k) for k in (4, 30, 120, 120, 400)]
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w) if rng.random() < 0.7 else "\t".join(w).upper()))
    rows += [(900, None), (901, " "), (902, "one"), (903, "ONE"), (904, "one two"), (905, "one two")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_dedup(docs(spark, rows), 3, 85).collect()}
    assert got == linked(rows, 3, 85)


def test_look_alikes_under_the_threshold_meet_on_rare_shingles_only(spark):
    """Families that share a frequent frame, and links between members that no hub has."""
    rng = random.Random(9)
    frame = [f"f{i}" for i in range(100)]
    rows = []
    for k in range(120):
        own = [f"o{k}x{i}" for i in range(26)]
        rows.append((k, " ".join(frame + own)))
        if k % 10 == 0:  # a near copy of this member
            own[rng.randrange(26)] = "zz"
            rows.append((1000 + k, " ".join(frame + own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_dedup(docs(spark, rows), 3, 85).collect()}
    assert got == linked(rows, 3, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_lose_no_link(spark, monkeypatch, percent):
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = np.random.default_rng(percent)
    base = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 7, 40, 200)]
    sets = []
    for _ in range(80):
        s = base[rng.integers(4)].copy()
        cut = rng.random(len(s)) < rng.choice([0.02, 0.05, 0.1, 0.2])
        s[cut] = rng.integers(0, 2**63, cut.sum(), dtype=np.uint64)
        sets.append(np.unique(s))
    (_, odd), par = N.sketches(sets), N.parities(sets)
    comp = [int(rng.integers(12)) for _ in sets]
    df = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "nid bigint, items array<bigint>")
    comps = spark.createDataFrame(list(enumerate(comp)), "nid bigint, comp bigint")
    prints = spark.createDataFrame([(i, len(s), odd[i].tolist(), par[i].tolist()) for i, s in enumerate(sets)], "nid bigint, n bigint, odd array<bigint>, par array<bigint>")
    placed = N._prefix_rows(df, percent).join(comps, "nid")
    got = {(min(r), max(r)) for r in N._with_all(placed, prints, percent).collect()}
    hubs = {(min(r), max(r)) for r in N._with_hubs(placed, prints, percent).collect()}
    assert hubs <= got and hubs
    for i, s in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(s, sets[j]))
            if comp[i] != comp[j] and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                assert (j, i) in got
    assert all(comp[i] != comp[j] for i, j in got)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(400)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in chain + star] + [(5000, 5001)]
    rng.shuffle(links)
    got = {(r.node, r.comp) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(i, 1000) for i in range(1000, 1401)} | {(5000, 5000), (5001, 5000)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_copies_keep_clashing_columns(spark):
    df = docs(spark, [(1, "one two three four five six"), (2, "One two three four five six"), (3, None)]).withColumnsRenamed({"lang": "key", "source": "place", "n_chars": "_hit"})
    out = N.drop_near_copies(df.withColumn("c1", F.lit(1)))
    assert out.columns == [*df.columns, "c1"] and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert N.drop_near_copies(df.limit(0)).count() == 0


def test_near_cases(spark):
    got = N.near_dedup(docs(spark, ODD), 3, 85).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.component_id for r in got}[9] == 8
    assert N.near_dedup(docs(spark, []), 3, 85).count() == 0


def test_near_copies_go_row_by_row(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    stay = lambda rows: pipeline.near_duplicates(spark, docs(spark, rows), "").collect()
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    clean, copy, only_null, repeated = (text(k) for k in "abcd")
    rows = [(None, clean), (1, copy), (None, copy + " x"), (None, only_null), (None, only_null + " y"), (None, ""), (None, "")]
    rows += [(2, copy.upper()), (2, "b" + clean.replace(" ", " b")), (5, repeated), (5, repeated), (5, repeated), (6, None)]
    left = [(r.doc_id, r.text) for r in stay(rows)]
    null = [t for i, t in left if i is None]
    assert clean in null and null.count("") == 2 and len(null) == 4 and {t[:40] for t in null} == {clean[:40], only_null[:40], ""}
    assert sorted((i, t) for i, t in left if i in (1, 2, 5)) == [(1, copy), (2, rows[8][1]), (5, repeated)] and (6, None) in left
    assert sorted(r.doc_id for r in stay([(1, copy), (2, copy), (3, clean)])) == [1, 3]


def test_odd_sketches_estimate_high_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    b = np.unique(np.concatenate([a[40:], rng.integers(0, 2**63, 40, dtype=np.uint64)]))  # about 0.85
    c = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
    _, odd = N.sketches([a, b, c])
    bits = lambda i, j: int(sum(int(x).bit_count() for x in (odd[i] ^ odd[j]).view(np.uint64)))
    assert bits(0, 1) < N.odd_limit(85) < bits(0, 2)
    par = N.parities([a, b])
    assert sum(int(x).bit_count() for x in (par[0] ^ par[1]).view(np.uint64)) <= len(np.setxor1d(a, b))


def test_bands_follow_the_threshold(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9))) for i in range(4)]
    for percent in (80, 85):
        n = len(spark.createDataFrame(rows, "id bigint, text string").mapInArrow(N._sketch_batches(5, N.bands_for(percent)), N.SKETCH).first().bands)
        assert (1 - (percent / 100) ** N.PER_BAND) ** n <= 8e-7 < (1 - (percent / 100) ** N.PER_BAND) ** (n - 1)
    assert (N.bands_for(80), N.bands_for(85)) == (36, 24)


# lines


def test_lines(spark):
    long_ = "Posted by {} on the board of the town hall in the month of May {}"
    rows = [(i, f"own text {i} {'q' * i}\n{long_.format(n, 2000 + i)}\n\nkept {'k' * (i + 1)}") for i, n in enumerate(["Ann", "Bob", "Cyd"])]
    rows += [(7, "Only twice here, nothing more to say."), (8, "Only twice here, nothing more to say."), (9, None), (None, "own null")]
    got = {r.doc_id: (r.n_dropped, r.text) for r in drop_recurring_lines(docs(spark, rows)).collect()}
    assert got[0][0] == 0 and got[1][0] == 1 and "Posted" not in got[1][1] and "own text 1" in got[1][1] and "\n\n" in got[1][1] + "\n\n"
    assert got[7][0] == got[8][0] == 0 and got[9] == (0, "") and got[None] == (0, "own null")
    assert drop_recurring_lines(docs(spark, [])).count() == 0


def test_lines_of_different_content_stay(spark):
    parts = ["one two three", "account balance forty", "my secret recipe", "here nothing matters"]
    rows = [(i, f"alpha beta {x} four five six seven eight nine") for i, x in enumerate(parts)]
    rows += [(10 + i, f"{i} {i * 7} {i + 3} 12:0{i} {i}") for i in range(5)]  # numbers alone are no template
    rows += [(20 + i, f"seen at {i} o'clock") for i in range(3)]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(docs(spark, rows)).collect()}
    assert got == {**{i: 0 for i, _ in rows}, 21: 1, 22: 1}


def test_whole_lines_recur_from_two_documents_on(spark):
    plain, dated = "this line of nine words is in two documents", "on 3 May 2019 the council of 12 met here"
    rows = [(1, f"one\n{plain}\n{dated}\nseven words only are in this line"), (2, f"{dated}\n{plain}\ntwo\nseven words only are in this line")]
    rows += [(3, f"three\n{dated.replace('2019', '2020')}"), (4, f"{plain.replace('nine', 'ten')}\nfour")]
    got = {r.doc_id: (r.n_dropped, r.text) for r in drop_recurring_lines(docs(spark, rows[:2])).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, "two\nseven words only are in this line")}
    for other in rows[2:]:  # two documents whose lines differ in a number or a word
        assert {r.n_dropped for r in drop_recurring_lines(docs(spark, [rows[0], other])).collect()} == {0}


def lined(rng, n):
    """Texts of own lines and of lines from templates with variable fields at any place."""
    vocab = ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(400)]
    common = ["the", "of", "and", "in", "a"]
    forms = []
    for size in (1, 3, 4, 5, 6, 9, 12, 16, 21, 30):
        for spots in (0, 1, 2, 4, 5):
            form = rng.choices(vocab + common * 40, k=size)
            for p in rng.sample(range(size), min(spots, size)):
                form[p] = None
            forms.append(form)
    names = rng.sample(vocab, 12)
    rows = []
    for i in range(n):
        t = []
        for _ in range(rng.randrange(8)):
            form = rng.choice(forms)
            t.append(" ".join(x or rng.choice([rng.choice(vocab), rng.choice(names), str(rng.randrange(99))]) for x in form))
            if rng.random() < 0.3:
                t.append(" ".join(rng.choices(vocab + common * 40, k=rng.randrange(12))))
        rows.append((i, "\n".join(t)))
    rng.shuffle(rows)
    return rows


def test_lines_match_brute_force(spark):
    rows = lined(random.Random(12), 300) + [(900, None), (None, ""), (901, "\n\n")]
    want = {i: x for (i, _), x in zip(rows, without_recurring_lines(rows))}
    got = {r.doc_id: (r.n_dropped, r.text) for r in drop_recurring_lines(docs(spark, rows)).collect()}
    assert got == want
    keys, at, recurs = line_templates(rows)
    kinds = Counter(k[0] for k in at if recurs(k))
    assert min(kinds[k] for k in ("form", "masked", "whole")) > 5, kinds


def test_precision_of_templates():
    """Of lines dropped for a template, how many were made from one: planted forms among prose."""
    rng = random.Random(13)
    vocab = ["".join(rng.choices("abcdefghijk", k=4)) for _ in range(60)]  # few words, so lines agree by chance
    made, rows = set(), []
    for i in range(400):
        t = [" ".join(rng.choices(vocab, k=rng.randrange(3, 20))) for _ in range(6)]
        if i % 4 == 0:
            t.append(f"shared by {rng.choice(vocab)} on the page of our club for all members of it")
            made.add((i, 6))
        rows.append((i, "\n".join(t)))
    keys, at, recurs = line_templates(rows)
    hit = {place for place, ks in keys.items() if any(recurs(k) for k in ks)}
    assert len(hit & made) >= 0.95 * len(hit) and len(hit & made) >= 0.95 * len(made)


def test_one_row_holds_a_line_where_ids_repeat_or_are_null(spark):
    null, same, twin = (f"{k} line of more than eight words recurs in rows like {k}" for k in ("null", "same", "twin"))
    rows = [(None, f"{null}\n{k}") for k in "abc"] + [(5, f"{same}\n{k}") for k in "def"] + [(6, twin)] * 3 + [(7, f"own\n{twin}"), (8, None), (None, "")]
    got = [(r.doc_id, r.n_dropped, r.text) for r in drop_recurring_lines(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    for line, of in ((null, None), (same, 5), (twin, 6)):
        assert [i for i, _, t in got if line in t] == [of]
    assert sorted(n for _, n, _ in got) == [0] * 5 + [1] * 7 and (7, 1, "own") in got
    assert {t[-1] for i, _, t in got if i in (None, 5) and t} == set("abcdef")


def test_lines_pass_other_columns_through(spark):
    df = docs(spark, [(1, "a"), (None, "b"), (1, "a line of more than eight words for the test"), (2, "a line of more than eight words for the test")])
    for names in ({"lang": "id", "source": "key"}, {"lang": "n_dropped", "source": "_n_dropped", "n_chars": "gone"}):
        out = drop_recurring_lines(df.withColumnsRenamed(names).withColumn("c0", F.lit(5)))
        assert out.columns[:-1] == [names.get(c, c) for c in df.columns] + ["c0"] and out.columns[-1].lstrip("_") == "n_dropped"
        assert sorted(r[-1] for r in out.collect()) == [0, 0, 0, 1] and {r[-2] for r in out.collect()} == {5}
    assert drop_recurring_lines(df, count_as=None).columns == df.columns
    assert drop_recurring_lines(df, keep_emptied=False).count() == 3


@pytest.mark.parametrize("bits", [0, 7])
def test_colliding_line_keys_change_nothing(spark, bits):
    """With a first hash of few bits lines are told apart by the second."""
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(150)]
    rows = [(i, "\n".join(rng.choices(lines, k=4) + [f"{rng.choice(lines)} {rng.randrange(999)}"] + [" ".join(rng.choices(words, k=9))])) for i in range(120)]
    want = {r.doc_id: (r.n_dropped, r.text) for r in drop_recurring_lines(docs(spark, rows)).collect()}
    got = {r.doc_id: (r.n_dropped, r.text) for r in drop_recurring_lines(docs(spark, rows), rules=Rules(key_bits=bits)).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 100
    assert [want[i] for i, _ in rows] == without_recurring_lines(rows)


def test_template_bounds_are_parameters(spark):
    rows = [(i, f"alpha {x} gamma\n{x}") for i, x in enumerate(["red", "blue", "green", "black"])]
    count = lambda **rules: sum(r.n_dropped for r in drop_recurring_lines(docs(spark, rows), rules=Rules(**rules)).collect())
    assert count() == 0 and count(lead=1, per_field=3) >= 3
    short = [(i, f"one two three\n{i} a{i}") for i in range(2)]
    dropped = lambda **rules: sum(r.n_dropped for r in drop_recurring_lines(docs(spark, short), rules=Rules(**rules)).collect())
    assert dropped() == 0 and dropped(whole_from=3) == 1
    with pytest.raises(ValueError):
        Rules(most_fields=8)


def test_columns_that_differ_in_case_only(spark):
    rows = [(1, "one two three four five six seven eight"), (2, "one two three four five six seven eight"), (3, "x")]
    wide = docs(spark, rows).select("*", F.lit("y").alias("Text"), F.lit(1).alias("a`b"), F.lit(2).alias("KEY"))
    out = drop_recurring_lines(wide)
    assert out.columns == [*wide.columns, "n_dropped"] and sorted(r[-1] for r in out.collect()) == [0, 0, 1]
    assert sorted(r[0] for r in N.drop_near_copies(wide).collect()) == [1, 3]
