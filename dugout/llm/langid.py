"""Language identification: text likelihoods, declared language, address suffix and host priors, fused by Bayes' rule.

*Text*: letter trigrams, hashed to ``CELLS`` cells and counted by language over all labelled documents; a text's
log likelihood counts as that of at most ``EVIDENCE`` trigrams, since neighbouring trigrams are not independent.
``und`` stands for text of no known language: its trigrams are even over the cells.
*Declared language* and *address suffix*: how often each value stands with each language, learned by a grouped
sum of the text-only posteriors of all rows. *Host*: a prior for each host, smoothed towards its domain's, that
towards its suffix's, that towards the prior of all rows; a row's own share is taken out of the sums first.
All sums are grouped aggregations with partial sums, so a host that holds a third of all rows is one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dugout.llm.common import slices, stored, text_bytes

CELLS, EVIDENCE, SMOOTH = 1 << 14, 60, 0.5
#: Weight of the wider level in the prior of a narrower one, in rows.
PULL = 5.0
UNKNOWN = "und"
#: Labels that a driver's table can hold (64 KB each); more are an error, none is left out.
MOST_LANGUAGES = 1024
#: Languages whose counts a task holds at once.
_HELD = 64
_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each letter trigram, its text). ASCII other than letters is space; trigrams with two spaces or only one letter drop out."""
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = _FOLD[raw]
    code = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    letter = b != 32
    whole = letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    whole &= owner[:-2] == owner[2:]
    cell = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 14)
    return cell[whole].astype(np.int64), owner[:-2][whole]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cell counts by language of a task, as one row for each language."""
    total: dict[str, np.ndarray] = {}

    def out():
        cells = np.arange(CELLS)
        for name, counts in total.items():
            some = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array([name] * int(some.sum()), pa.string()), pa.array(cells[some], pa.int32()), pa.array(counts[some])], ["lang", "cell", "n"])
        total.clear()

    for batch in slices(batches, "text"):
        names, index = np.unique(np.array([x or "" for x in batch.column("lang").to_pylist()], object), return_inverse=True)
        cell, owner = trigrams(*text_bytes(batch.column("text")))
        key, counts = np.unique(index[owner] * CELLS + cell, return_counts=True)
        cuts = np.searchsorted(key, np.arange(len(names) + 1) * CELLS)
        for i, name in enumerate(names):
            if name not in total:
                if len(total) >= _HELD:
                    yield from out()
                total[name] = np.zeros(CELLS, np.int64)
            part = slice(cuts[i], cuts[i + 1])
            total[name][key[part] - i * CELLS] += counts[part]
    yield from out()


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict:
    """Trigram log likelihoods by language, from every labelled row; a null or blank label teaches nothing.

    Every label is learned. More than ``MOST_LANGUAGES`` labels raise a ``ValueError``.
    """
    rows = docs.select(F.col(text).alias("text"), F.lower(F.trim(F.col(lang))).alias("lang")).where("lang <> ''")
    languages = sorted(r["lang"] for r in rows.where(F.col("lang") != UNKNOWN).select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} language labels; clean the labels first, none is left out here")
    counts = rows.where(F.col("lang") != UNKNOWN).mapInArrow(_counted, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    places = docs.sparkSession.createDataFrame(list(enumerate(languages)), "at int, lang string")
    known = counts.join(F.broadcast(places), "lang").select("at", "cell", "n").toPandas()  # MOST_LANGUAGES * CELLS rows at most
    table = np.zeros((len(languages) + 1, CELLS))
    table[known["at"].to_numpy(int), known["cell"].to_numpy(int)] = known["n"]
    table += SMOOTH
    table[-1] = 1
    return {"languages": [*languages, UNKNOWN], "log": np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)}


def _normal(logs: np.ndarray) -> np.ndarray:
    """Probabilities of each row from log weights."""
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _arrays(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def text_scores(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with two arrays, a place for each of the model's languages: log likelihoods ``text_log`` (zeros without
    letters), and ``own``, the probabilities by them alone."""
    names = [c for c in docs.columns if c not in ("text_log", "own")]
    docs = docs.select(*names)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log = np.ascontiguousarray(model["log"])
        for batch in slices(batches, text):
            cell, owner = trigrams(*text_bytes(batch.column(text)))
            n = batch.num_rows
            seen = np.bincount(owner, minlength=n)
            total = np.stack([np.bincount(owner, row[cell], n).astype(float) for row in log], axis=1)
            total *= (np.minimum(1, EVIDENCE / np.maximum(seen, 1)))[:, None]
            yield pa.RecordBatch.from_arrays([*batch.columns, _arrays(total), _arrays(_normal(total))], [*names, "text_log", "own"])

    empty = F.array().cast("array<double>")
    return docs.mapInArrow(scored, docs.withColumns({"text_log": empty, "own": empty}).schema)


def _fused(languages: list[str], share: np.ndarray):
    """The fusion of all evidence of a batch of rows."""
    n = len(languages)

    def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy().reshape(-1, n)

    def named(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return np.array([bool(x) for x in batch.column(name).to_pylist()], bool)[:, None]

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own, log = matrix(batch, "own"), matrix(batch, "text_log")
            prior = np.broadcast_to(share, own.shape)
            for sums, level in (("at_suffix", "suffix"), ("at_domain", "domain"), ("at_host", "host")):
                rest = np.maximum(matrix(batch, sums) - own, 0)
                narrow = (rest + PULL * prior) / (rest.sum(axis=1, keepdims=True) + PULL)
                prior = np.where(named(batch, level), narrow, prior)
            # How often the declared value stands with each language, the row's own share taken out.
            rest = np.maximum(matrix(batch, "said") - own, 0)
            given = np.log((rest + PULL * share) / (rest.sum(axis=1, keepdims=True) + PULL)) - np.log(share)
            posterior = _normal(log + np.where(named(batch, "declared"), given, 0) + np.log(prior))
            best, alone = posterior.argmax(axis=1), own.argmax(axis=1)
            letters = log.max(axis=1) < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([languages[i] for i in best], pa.string()), pa.array(posterior[np.arange(len(best)), best]),
                 pa.array([languages[i] if x else None for i, x in zip(alone, letters, strict=True)], pa.string()), batch.column("declared"), batch.column("host")],
                ["key", "lang", "probability", "text_lang", "declared", "host"])

    return fuse


def _added(rows: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """Sums of an array column place by place."""
    sums = rows.groupBy(*keys).agg(*[F.sum(F.element_at(column, i + 1)).alias(f"s{i}") for i in range(n)])
    return sums.select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("sums"))


def host_of(url: Column) -> Column:
    """Lower-case host of an address; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def declared_in(html: Column) -> Column:
    """Primary subtag of the language an ``<html>`` tag declares; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def identify(rows: DataFrame, model: dict, key: str, text: str, declared: Column, host: Column) -> DataFrame:
    """One row per row of ``rows``: key, lang, probability, text_lang, declared, host.

    Any of text, declared language and host may be null or empty: it is then no evidence. Without any evidence, a
    language is whatever most rows have, with that share as probability. Equal probabilities go to the first
    language by name. Rows that repeat are each counted and returned; an empty table gives an empty result.
    """
    languages = model["languages"]
    n = len(languages)
    kind = rows.schema[key].dataType.simpleString()
    base = rows.select(F.col(key).cast(kind).alias("key"), F.col(text).alias("text"), F.coalesce(declared, F.lit("")).alias("declared"),
                       F.coalesce(host, F.lit("")).alias("host"))
    base = text_scores(base, model).drop("text")
    base = base.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    base = stored(base, "evidence")

    whole = _added(base, [], "own", n).first()
    share = [(x or 0.0) + SMOOTH for x in (whole["sums"] if whole else [None] * n)]
    share = np.array(share) / sum(share)
    hosts = _added(base, ["host", "domain", "suffix"], "own", n)
    domains = _added(hosts, ["domain", "suffix"], "sums", n)
    suffixes = _added(domains, ["suffix"], "sums", n)
    table = hosts.withColumnRenamed("sums", "at_host")
    table = table.join(domains.withColumnRenamed("sums", "at_domain"), ["domain", "suffix"]).join(suffixes.withColumnRenamed("sums", "at_suffix"), "suffix")

    # How often a declared value stands with each language.
    said = _added(base, ["declared"], "own", n).select("declared", F.col("sums").alias("said"))
    fused = base.join(table.select("host", "at_host", "at_domain", "at_suffix"), "host").join(said, "declared")
    found = fused.mapInArrow(_fused(languages, share), f"key {kind}, lang string, probability double, text_lang string, declared string, host string")
    return found.withColumnRenamed("key", key)
