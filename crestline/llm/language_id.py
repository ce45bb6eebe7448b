"""Language identification by Bayesian fusion of text, markup, address and host.

posterior(l)  ~  exp(text log likelihood)  *  P(declared | l)  *  prior(l | host)

* Text: byte-trigram multinomials fitted on a bounded sample of labelled rows
  (``FIT_ROWS``, the smallest hashes of their ids; whole texts), tempered to at
  most ``EVIDENCE`` trigrams so that long texts do not silence the rest.
* Declared: how often markup declares d where the text says l, a grouped count
  over all rows.
* Host prior: expected language counts of the host, smoothed by its domain, that
  by the address suffix, that by all rows.  A row's own text is taken out of each
  level first.  Counts are sums of integers, so they do not depend on the order.

A row is rejected (lang "und") without letters, if its text (of ``JUDGED`` trigrams or
more) fits no language as well as the worst of the sample, with a margin, or below
``LEAST`` confidence.

Cases: null or letterless text is rejected; null host, suffix or declaration is no
evidence; repeated rows count each; extra columns are ignored; an empty table
gives an empty result; without any labelled row there is no model and every
row is accepted as "und".
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rolling as R
from .skew import join_groups
from ..plans.staging import drop, stage

FIT_ROWS = 2000
BUCKETS = 16
EVIDENCE, LEAST, MARGIN = 200.0, 0.5, 1.5
JUDGED = 50  # trigrams from which on the fit of a text is judged
STRENGTH = 4.0  # rows that each level's parent counts as
_UNIT = 1_000_000
_SLICE = 1 << 20
_DROP = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})", re.I)


_LETTERS = np.zeros(256, bool)
_LETTERS[[0x20, 0x27, *range(65, 91), *range(97, 123), *range(0x80, 256)]] = True


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram beginning at each byte, and whether it counts: letters, blanks and
    apostrophes only, so that numbers, addresses and markup say nothing about a language."""
    low = R.LOWER[data].astype(np.uint32)
    out, counts = np.zeros(len(data), np.int64), np.zeros(len(data), bool)
    if len(data) > 2:
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        out[:-2] = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS)
        ok = _LETTERS[data]
        counts[:-2] = ok[:-2] & ok[1:-1] & ok[2:]
    return out, counts


def counted(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams that count, text after text, and where each text's begin (and the end)."""
    gram, counts = trigrams(data)
    tail = np.concatenate([offs[1:] - 1, offs[1:] - 2])  # none reaches into the next text
    counts[tail[tail >= 0]] = False
    at = np.flatnonzero(counts)
    return gram[at], np.searchsorted(at, offs)


@dataclass(frozen=True)
class TextModel:
    langs: list[str]
    table: np.ndarray  # (2^BUCKETS, languages) log probabilities
    floor: float  # worst mean log likelihood of the sample under its language

    @classmethod
    def of(cls, langs: list[str], count: np.ndarray, floor: float = -math.inf) -> TextModel:
        """From counts (2^BUCKETS, languages)."""
        # smoothed by the trigram's share over all languages
        base = (count.sum(1) + 0.5) / (count.sum() + 0.5 * len(count))
        p = (count + 20 * len(langs) * base[:, None]) / (count.sum(0) + 20 * len(langs))
        p = 0.98 * p + 0.02 / len(count)
        return cls(langs, np.log(p).astype(np.float32), floor)

    def sums(self, gram: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(texts, languages) log likelihoods."""
        out = np.zeros((len(first) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(first))  # their stretches follow one another without gaps
        if len(full) and len(self.langs):
            out[full] = np.add.reduceat(self.table[gram].astype(np.float64), first[:-1][full], axis=0)
        return out


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of (lang, text) rows."""
    for b in batches:
        for lo, hi, data, offs in R.slices(b.column(1), _SLICE):
            gram, first = counted(data, offs)
            langs = b.column(0).slice(lo, hi - lo).to_pylist()
            for lang in set(langs):
                mine = np.repeat([x == lang for x in langs], np.diff(first))
                bucket, n = np.unique(gram[mine], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bucket), pa.string()), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["lang", "bucket", "n"])


def _sample_means(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: TextModel = shared.value
        for b in batches:
            for lo, hi, data, offs in R.slices(b.column(1), _SLICE):
                gram, first = counted(data, offs)
                n = np.diff(first)
                k = [model.langs.index(x) for x in b.column(0).slice(lo, hi - lo).to_pylist()]
                mean = model.sums(gram, first)[np.arange(hi - lo), k] / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([pa.array(mean[n >= JUDGED])], names=["mean"])

    return run


def _likelihood_batches(shared):
    """id columns, declared, ... and text last: text becomes ll array<double>, letters, fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: TextModel = shared.value
        width = len(model.langs)
        for b in batches:
            k = b.num_columns - 1
            for lo, hi, data, offs in R.slices(b.column(k), _SLICE):
                gram, first = counted(data, offs)
                grams = np.diff(first)
                mean = model.sums(gram, first) / np.maximum(grams, 1)[:, None]
                ll = mean * np.minimum(grams, EVIDENCE)[:, None]
                solid = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data >= 0x80)
                letters = np.concatenate([[0], np.cumsum(solid)])
                letters = letters[offs[1:]] - letters[offs[:-1]]
                fits = (mean.max(1) >= model.floor) | (grams < JUDGED) if width else np.ones(hi - lo, bool)
                flat = pa.array(np.round(ll, 6).ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in b.columns[:k]), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * width), flat), pa.array(letters > 0), pa.array(fits)],
                    names=[*b.schema.names[:k], "ll", "letters", "fits"],
                )

    return run


def _page_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pages = b.column(2).to_pylist()
        declared = [m[1].lower() if (m := _DECLARED.search(h or "")) else None for h in pages]
        text = [unescape(_DROP.sub(" ", h or "")) for h in pages]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(declared, pa.string()), pa.array(text, pa.string())], names=["id", "url", "declared", "text"])


def from_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, declared, host, text of raw pages: markup language, address and visible text."""
    slim = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = slim.mapInArrow(_page_batches, "id bigint, url string, declared string, text string")
    host = F.lower(F.nullif(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    return out.select("id", "declared", host.alias("host"), "text")


def from_documents(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    host = F.col(host_col).cast("string") if host_col in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.lit(None).cast("string").alias("declared"), host.alias("host"), F.col(text_col).cast("string").alias("text"))


def fit_sample(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = FIT_ROWS) -> TextModel:
    """Fit on at most ``rows`` labelled rows, chosen by a hash of their ids.

    The driver gets counts per trigram bucket and language; the texts stay in the cluster.
    """
    known = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(id_col).alias("o"))
    low = known.select("o").orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    if low is None:
        return TextModel([], np.zeros((1 << BUCKETS, 0), np.float32), -math.inf)
    sample = stage(known.filter(F.col("o") <= low).orderBy("o").limit(rows).select("lang", "text"), "language-sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    got = sample.mapInArrow(_sample_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros((1 << BUCKETS, len(langs)))
    place = {x: i for i, x in enumerate(langs)}
    count[got["bucket"].to_numpy(), [place[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    model = TextModel.of(langs, count)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    worst, = sample.mapInArrow(_sample_means(shared), "mean double").agg(F.min("mean")).first()
    drop(sample)
    return TextModel(model.langs, model.table, -math.inf if worst is None else worst - MARGIN)


def _vector(col: str | Column, n: int) -> list[Column]:
    col = F.col(col) if isinstance(col, str) else col
    return [col[i] for i in range(n)]


def identify(rows: DataFrame, model: TextModel, keys: list[str]) -> DataFrame:
    """keys, lang, confidence, accepted for rows of (keys..., declared, host, text)."""
    n = len(model.langs)
    if not n:
        return rows.select(*keys, F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(True).alias("accepted"))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 65,536 buckets a language
    host = F.coalesce(F.col("host"), F.lit(""))
    parts = F.split(host, r"\.")
    slim = rows.select(
        *keys,
        "declared",
        host.alias("host"),
        F.when(F.size(parts) > 2, F.array_join(F.slice(parts, -2, 2), ".")).otherwise(host).alias("domain"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit("")).alias("suffix"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    scored = slim.mapInArrow(_likelihood_batches(shared), f"{kinds}, ll array<double>, letters boolean, fits boolean")
    ll = _vector("ll", n)
    top = F.greatest(*ll) if n > 1 else ll[0]
    total = sum((F.exp(x - top) for x in ll), F.lit(0.0))
    usable = F.col("letters") & F.col("fits")
    # expected counts in millionths: integer sums do not depend on the order
    own = [F.when(usable, F.round(F.exp(x - top) / total * _UNIT)).otherwise(0).cast("bigint") for x in ll]
    scored = stage(scored.withColumn("own", F.array(*own)), "language-rows")

    def sums(df: DataFrame, col: str, *by: str) -> DataFrame:
        vec = F.array(*[F.sum(F.col(col)[i]) for i in range(n)])
        return df.groupBy(*by).agg(vec.alias("v"), F.sum("rows").alias("rows"), F.sum("hosts").alias("hosts"))

    hosts = stage(sums(scored.withColumns({"rows": F.lit(1).cast("bigint"), "hosts": F.lit(1).cast("bigint")}), "own", "host", "domain", "suffix").withColumn("hosts", F.lit(1).cast("bigint")), "language-hosts")
    domains = sums(hosts, "v", "domain", "suffix")
    suffixes = stage(sums(domains, "v", "suffix"), "language-suffixes")
    everything = suffixes.agg(*[F.sum(F.col("v")[i]).alias(f"g{i}") for i in range(n)]).first()
    overall = [int(x or 0) for x in everything]
    named = lambda df, name, *by: df.select(*by, F.col("v").alias(name), F.col("hosts").alias("size"))
    n_hosts, = hosts.agg(F.count(F.lit(1))).first()
    # a domain of blogs or a suffix may hold any share of all hosts
    chain = hosts.select("host", "domain", "suffix", "rows", F.col("v").alias("vh"))
    chain = join_groups(chain, named(domains, "vd", "domain", "suffix"), ["domain", "suffix"], "size", n_hosts).drop("size")
    chain = join_groups(chain, named(suffixes, "vs", "suffix"), ["suffix"], "size", n_hosts).select("host", "rows", "vh", "vd", "vs")
    # bounded: languages known times declarations of two or three letters
    best = F.array_position(F.col("own"), F.array_max("own")).cast("int") - 1
    told = scored.filter(usable & F.col("declared").isNotNull()).groupBy("declared", best.alias("l")).count()
    told = F.broadcast(told.groupBy("declared").agg(F.map_from_entries(F.collect_list(F.struct("l", "count"))).alias("says")))
    by_lang = {r["l"]: r["c"] for r in scored.filter(usable & F.col("declared").isNotNull()).groupBy(best.alias("l")).agg(F.count(F.lit(1)).alias("c")).collect()}
    count, = scored.agg(F.count(F.lit(1))).first()
    joined = join_groups(scored.drop("domain", "suffix"), chain, ["host"], "rows", count).join(told, "declared", "left")

    strength = F.lit(STRENGTH * _UNIT)
    prior = [(F.lit(float(overall[i])) - F.col("own")[i] + _UNIT) / (F.lit(float(sum(overall) + n * _UNIT)) - F.aggregate("own", F.lit(0).cast("bigint"), lambda a, x: a + x)) for i in range(n)]
    for level in ("vs", "vd", "vh"):
        left = [F.col(level)[i] - F.col("own")[i] for i in range(n)]
        all_ = sum(left, F.lit(0))
        prior = [(left[i] + strength * prior[i]) / (all_ + strength) for i in range(n)]
    says = [F.coalesce(F.try_element_at(F.col("says"), F.lit(i)), F.lit(0)) for i in range(n)]
    told_log = [F.when(F.col("declared").isNull(), 0.0).otherwise(F.log((says[i] + 0.5) / F.lit(by_lang.get(i, 0) + 0.5 * (n + 1)))) for i in range(n)]
    score = [ll[i] + F.log(prior[i]) + told_log[i] for i in range(n)]
    joined = joined.withColumn("score", F.array(*score))
    high = F.array_max("score")
    joined = joined.withColumn("at", F.array_position("score", high).cast("int")).withColumn("confidence", F.round(1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - high)), 6))
    ok = usable & (F.col("confidence") >= LEAST)
    names = F.array(*[F.lit(x) for x in model.langs])
    return joined.select(*keys, F.when(ok, names[F.col("at") - 1]).otherwise(F.lit("und")).alias("lang"), "confidence", ok.alias("accepted"))
