import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from crestline.llm import merkle
from crestline.llm.merkle import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tamper(c):
    return F.crc32(c["doc_id"].cast("string")) % 7 == 0, {"n_chars": c["n_chars"] + 1}


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(said, (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """(root, for each node its path as (right, sibling or None))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            other = at[k] ^ 1
            path.append((at[k] % 2 == 0, nodes[other] if other < len(nodes) else None))
            at[k] //= 2
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def brute(rows):
    last = lambda x: (x is None, x or 0)
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = [sorted((r for r in rows if r[2] == lang), key=lambda r: (last(r[0]), leaf(*r))) for lang in langs]
    inner = [climb([leaf(*r) for r in t]) for t in trees]
    root, outer = climb([h for h, _ in inner]) if inner else (None, [])
    out = []
    for t, (sub, paths), over in zip(trees, inner, outer):
        for r, path in zip(t, paths):
            whole = path + over
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf(*r[:4], r[4] + 1) if hit else leaf(*r)
            for right, other in whole:
                node = sha(node) if other is None else sha(node, other) if right else sha(other, node)
            out.append((r[0], leaf(*r), sub, root, sha(*[o for _, o in whole if o]), node, node == root))
    return sorted(out, key=repr)


def rows_of(n, langs, start=0):
    return [(i, f"text {i} é" * (i % 4), lang, f"s{i % 3}", 7 * i) for i, lang in zip(range(start, start + n), itertools.cycle(langs))]


CASES = {
    "empty": [],
    "one row": rows_of(1, ["en"]),
    "two languages of one row": rows_of(2, ["en", "de"]),
    "odd counts": rows_of(37, ["en", "en", "de", None, "", "ünd"]),
    "nulls in any column": [(None, None, None, None, None), (None, "x", "en", None, 3), (7, None, "en", "a", None), (14, "y", None, None, 1), (9, "", "en", "", 0)],
    "ties and repeated rows": [(5, "a", "en", "s", 1)] * 9 + [(5, "b", "en", "s", 1)] * 3 + rows_of(6, ["en"]),
    "a long text": [(1, "lang " * 200_000, "en", "s", 10**6), *rows_of(5, ["en"], 2)],
    "a hot language": rows_of(150, ["en"]) + rows_of(4, ["fr"], 500),
}


@pytest.mark.parametrize("levels", [12, 2])
@pytest.mark.parametrize("case", CASES)
def test_manifest_equals_brute_force(spark, monkeypatch, case, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BUCKET", 1 << levels)
    got = manifest(spark.createDataFrame(CASES[case], SCHEMA), COLUMNS, "doc_id", "lang", tamper).collect()
    assert sorted(map(tuple, got), key=repr) == brute(CASES[case])


def test_other_columns_and_names_do_not_matter(spark):
    rows = CASES["odd counts"]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", F.lit("x").alias("Text"), F.lit(1).alias("tree"), F.lit(2).alias("a`b"), F.lit(3).alias("at"))
    got = manifest(docs, COLUMNS, "doc_id", "lang", tamper).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_ranges_number_a_language_over_several_tasks(spark):
    rows = spark.range(3000).select((F.col("id") % 2).cast("string").alias("tree"), (F.col("id") * 7919 % 3001).alias("id"))
    got = merkle.placed(rows, "tree", ["id"], 7)
    assert got.agg(F.max("total")).first()[0] == 1500
    by = sorted((r["tree"], r["id"], r["at"]) for r in got.collect())
    assert [at for *_, at in by] == [*range(1500), *range(1500)]
