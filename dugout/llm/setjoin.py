"""Documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more, by a token-group matrix.

Every step is exact: what is set aside cannot have a link. Sets are worked on once, however many rows hold them.

1. *Sets*: each text becomes its sorted distinct shingle hashes; equal sets share a 128-bit digest.
2. *Sieve*: two linked sets share a known number of tokens among the first ones (by hash) of each. A set with
   too few tokens that any other set has cannot have a link. Tokens that repeat within a task are settled there;
   only the lone ones are shuffled, so a token costs at most two rows a task however frequent it is. First the
   sieve runs over a part of each set, then over the whole sets of those that are left.
3. *Groups*: what is left is partitioned into groups of similar sets, by the smallest token, then (for sets that
   found no link) by the smallest token of another order. A group larger than ``GROUP`` is cut, and the cuts
   share a few leaders. Inside a group the links are found by counting owners of common tokens; a spanning
   forest of them is kept, not the pairs.
4. *Token-group matrix*: rows (token, group) over the first tokens of the members, those that the fewest components
   hold first. A token that leads from one component to another makes two groups meet; the sets of one go to the other as
   queries if it holds a component larger than theirs. For this the components of one family (by the largest component
   that they share a token with) stand in few groups; a family of more than ``FAMILY`` groups first meets one group a token,
   so that the copies of one text are one component before any two groups meet. A group holds the union of its members' tokens; a
   query whose overlap with the union is too small for any link stops there, and only qualifying groups are
   opened and compared member by member. Sets of one component need no further link between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dugout.llm.common import free_name, short_shuffles, slices, stored, text_bytes
from dugout.llm.components import components
from dugout.llm.words import mix, shingle_sets

#: Similarity 80/100; linked when 100 * intersection >= 80 * union.
SHARE, WHOLE = 80, 100
#: Most sets in one group, leaders aside, and most queries that meet a group in one task.
GROUP, QUERIES = 256, 2048
#: Groups of one family beyond which its sets first ask one group a token.
FAMILY = 32
_SALT = np.uint64(0x6A09E667F3BCC909)


def least_overlap(n: int) -> int:
    """Tokens that a set of ``n`` shares with a linked one at least; also the least size of that one."""
    return (SHARE * n + WHOLE - 1) // WHOLE


def sieve_depth(n: int, whole: bool) -> int:
    """Common tokens that the sieve asks for, beyond which it need not look."""
    return least_overlap(n) if whole else max(1, n // 10)


def sieve_length(n: int, whole: bool) -> int:
    return n if whole else n - least_overlap(n) + sieve_depth(n, False)


def sieve_least(n: int, whole: bool) -> int:
    """Tokens shared with other sets that a set needs in its sieved part: the depth of its smallest partner."""
    return least_overlap(n) if whole else sieve_depth(least_overlap(n), False)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _sieved(sets: list[np.ndarray], keys: list[bytes], whole: bool) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """For each set: tokens known here to be shared, the lone ones, and (at one owner each) the shared ones to announce."""
    first: dict[bytes, int] = {}
    owners = [i for i, k in enumerate(keys) if len(sets[i]) and first.setdefault(k, i) == i]
    parts = [sets[i][: sieve_length(len(sets[i]), whole)] for i in owners]
    none = np.zeros(0, np.uint64)
    known, lone, told = [0] * len(sets), [none] * len(sets), [none] * len(sets)
    if not parts:
        return known, lone, told
    tokens = np.concatenate(parts)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(tokens, kind="stable")
    t = tokens[order]
    same = t[1:] == t[:-1]
    shared = np.zeros(len(t), bool)
    shared[1:] |= same
    shared[:-1] |= same
    head = shared.copy()
    head[1:] &= ~same
    flag, start = np.empty(len(t), bool), np.empty(len(t), bool)
    flag[order], start[order] = shared, head
    counts = np.bincount(owner, flag, len(parts)).astype(int)
    bounds = np.cumsum([0] + [len(p) for p in parts])
    for j, i in enumerate(owners):
        a, b = bounds[j], bounds[j + 1]
        known[i], lone[i], told[i] = int(counts[j]), tokens[a:b][~flag[a:b]], tokens[a:b][start[a:b]]
    return known, lone, told


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


_SIEVE_FIELDS = ("digest", "n", "known", "lone", "told")
_SIEVE = "digest binary, n int, known int, lone array<bigint>, told array<bigint>"
#: Tokens that a task holds at once when it works on stored sets.
_TOKENS = 1 << 20
#: Bytes of text whose tokens are settled together by the first sieve.
_BYTES = 4 << 20


def _sieve_columns(sets: list[np.ndarray], keys: list[bytes], whole: bool) -> list[pa.Array]:
    known, lone, told = _sieved(sets, keys, whole)
    sizes = [len(s) for s in sets]
    return [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(known, pa.int32()), _lists(lone), _lists(told)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's id with the digest and the size of its set."""
    for batch in slices(batches, "text", _BYTES):
        sets = shingle_sets(*text_bytes(batch.column("text")))
        columns = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "digest", "n"])


def _first_sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", _BYTES):
        sets = shingle_sets(*text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_arrays(_sieve_columns(sets, [_digest(s) for s in sets], False), list(_SIEVE_FIELDS))


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's whole set, and its smallest token in a second order."""
    for batch in slices(batches, "text", _BYTES):
        sets = [s for s in shingle_sets(*text_bytes(batch.column("text"))) if len(s)]
        other = [int(mix(s ^ _SALT).min().view(np.int64)) for s in sets]
        columns = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), _lists(sets), pa.array(other, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["digest", "n", "tokens", "key2"])


def _second_sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint64)
        keys = batch.column("digest").to_pylist()
        start = 0
        while start < batch.num_rows:
            stop = max(int(np.searchsorted(ends, ends[start] + _TOKENS, side="right")) - 1, start + 1)
            sets = [values[ends[i] : ends[i + 1]] for i in range(start, min(stop, batch.num_rows))]
            yield pa.RecordBatch.from_arrays(_sieve_columns(sets, keys[start : start + len(sets)], True), list(_SIEVE_FIELDS))
            start += len(sets)


def _survivors(sieved: DataFrame, whole: bool) -> DataFrame:
    """Digests (by their first eight bytes: two sets that share these only make the sieve wider) that may have a link.

    A token's rows are one for each task where it is lone and one for each where it is shared, so the window over
    a token holds as many rows as there are tasks' slices, not as many as there are documents. ``sieved`` is read
    once and its tokens are moved, never stored: a set's own row (``n``, ``known``) goes with them, its key as the token.
    """
    key = F.xxhash64("digest")
    tokens = F.posexplode(F.concat(F.array(key), "lone", "told")).alias("at", "token")
    rows = sieved.where("n > 0").select(key.alias("key"), "n", "known", F.size("lone").alias("lone"), tokens)
    own = F.col("at") == 0
    rows = rows.select(F.when(F.col("at") <= F.col("lone"), F.col("key")).alias("key"), "token", F.when(own, F.col("n")).alias("n"), F.when(own, F.col("known")).alias("known"))
    token = Window.partitionBy("token")
    several = F.min("key").over(token) < F.max("key").over(token)
    announced = F.count(F.lit(1)).over(token) > F.count("key").over(token)
    seen = rows.select("key", "n", "known", (F.coalesce(several, F.lit(False)) | announced).alias("shared"))
    seen = seen.where("key is not null and (shared or n is not null)")
    total = seen.groupBy("key").agg(F.sum(F.coalesce("known", F.lit(1))).alias("known"), F.min("n").alias("n"))
    part = F.floor((F.lit(SHARE) * F.col("n") + WHOLE - 1) / WHOLE)
    least = part if whole else F.greatest(F.lit(1), F.floor(part / 10))
    return total.where(F.col("known") >= least).select("key")


def _links_of(tokens: np.ndarray, owner: np.ndarray, sizes: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Which owners are linked with ``query``; ``tokens`` sorted, ``owner`` alongside."""
    low, high = np.searchsorted(tokens, query, "left"), np.searchsorted(tokens, query, "right")
    width = high - low
    hit = np.repeat(low - np.cumsum(width) + width, width) + np.arange(width.sum())
    common = np.bincount(owner[hit], minlength=len(sizes))
    return WHOLE * common >= SHARE * (sizes + len(query) - common)


def _matrix(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owner[order], np.array([len(s) for s in sets])


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Links inside one group that join all sets that its links join; (src, dst)."""
    sets = [np.asarray(t).view(np.uint64) for t in group["tokens"]]
    names = group["digest"].tolist()
    tokens, owner, sizes = _matrix(sets)
    left, out = np.ones(len(sets), bool), []
    for i in range(len(sets)):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(_links_of(tokens, owner, sizes, sets[j]) & left).tolist():
                left[k] = False
                todo.append(k)
                out.append((names[j], names[k]))
            if not left.any():
                break
    return pd.DataFrame(out, columns=["src", "dst"])


def _open(key, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Links from queries to members of one group, one for each component: first the bound by the union, then the members."""
    if not len(members) or not len(queries):
        return pd.DataFrame([], columns=["src", "dst"])
    sets = [np.asarray(t).view(np.uint64) for t in members["held"]]
    names, component = members["member"].tolist(), members["component"].to_numpy()
    tokens, owner, sizes = _matrix(sets)
    union = tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))]
    out = []
    for name, query in zip(queries["digest"], queries["tokens"], strict=True):
        query = np.asarray(query).view(np.uint64)
        at = np.minimum(np.searchsorted(union, query), len(union) - 1)
        if int((union[at] == query).sum()) < least_overlap(len(query)):
            continue
        linked = np.flatnonzero(_links_of(tokens, owner, sizes, query))
        first = np.unique(component[linked], return_index=True)[1]
        out += [(name, names[k]) for k in linked[first].tolist()]
    return pd.DataFrame(out, columns=["src", "dst"])


def _homes(rows: DataFrame, key: str) -> DataFrame:
    """(digest, key, home, cuts, low, mid, high): every set's group; a key with many sets is cut by a hash of the digest."""
    counts = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("members"), F.min("digest").alias("low"), F.max("digest").alias("high"),
        F.min(F.struct(F.xxhash64("digest").alias("h"), F.col("digest").alias("d")))["d"].alias("mid"))
    counts = counts.withColumn("cuts", F.ceil(F.col("members") / (GROUP // 2)).cast("int"))
    placed = rows.select(key, "digest").join(counts, key)
    cut = F.expr("cast(pmod(xxhash64(digest, 7), cuts) as int)")
    return placed.withColumn("home", F.xxhash64(key, cut))


def _group_forest(near: DataFrame, homes: DataFrame, key: str) -> DataFrame:
    """Spanning links inside every group; leaders stand in each cut of their key, so that its cuts hang together."""
    crowded = homes.where("members > 1")
    leaders = crowded.where("cuts > 1").select(key, "cuts", "low", "mid", "high").distinct()
    leaders = leaders.select(key, F.explode(F.expr("sequence(0, cuts - 1)")).alias("cut"), F.array("low", "mid", "high").alias("all"))
    leaders = leaders.select(F.xxhash64(key, "cut").alias("home"), F.explode("all").alias("digest"))
    rows = crowded.select("home", "digest").unionByName(leaders).distinct()
    rows = rows.join(near.select("digest", "tokens"), "digest")
    return rows.groupBy("home").applyInPandas(_forest, "src binary, dst binary")


def similar_sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, the row's own included. A null or empty text, or one
    without words, has no shingles, is linked with nothing and is its own component. Equal texts are one set, so
    repeated rows and ids change nothing. A null id takes part and is never the smallest unless all are null. An
    empty table gives an empty result; other columns are not looked at.
    """
    with short_shuffles(docs.sparkSession):
        return _similar_sets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))


def _similar_sets(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = stored(docs.mapInArrow(_digests, f"doc_id {kind}, digest binary, n int"), "sets")
    ids = sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))

    wanted = ids.withColumn("key", F.xxhash64("digest")).join(_survivors(docs.select("text").mapInArrow(_first_sieve, _SIEVE), False), "key", "left_semi")
    # Stored before the texts move, so that the sieve's shuffles are gone by then; the texts are as much to move as its tokens.
    wanted = stored(wanted.select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]), "left_semi").select("text")
    full = stored(texts.mapInArrow(_whole_sets, "digest binary, n int, tokens array<bigint>, key2 bigint"), "sets")

    left = stored(_survivors(full.select("digest", "tokens").mapInArrow(_second_sieve, _SIEVE), True), "left")
    near = full.withColumn("key", F.xxhash64("digest")).join(left, "key", "left_semi").drop("key")
    near = stored(near.dropDuplicates(["digest"]).withColumn("key1", F.element_at("tokens", 1)), "sets")

    homes = stored(_homes(near, "key1"), "homes")
    links = stored(_group_forest(near, homes, "key1"), "links")
    found = links.select(F.col("src").alias("digest")).unionByName(links.select(F.col("dst").alias("digest")))
    alone = near.select("digest", "key2").join(found, "digest", "left_anti")
    links = links.unionByName(stored(_group_forest(near, _homes(alone, "key2"), "key2"), "links"))

    more, whole = _cross_links(_labelled(near, homes, links), near, False)
    links = links.unionByName(more)
    if not whole:
        links = links.unionByName(_cross_links(_labelled(near, homes, links), near, True)[0])

    labels = components(links)
    each = ids.join(labels, ids["digest"] == labels["node"], "left").select("digest", "doc_id", F.coalesce("root", "digest").alias("component"))
    least = each.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    each = each.join(least, "component").select("digest", "component_id")
    rows = sets.select("doc_id", "digest", "n").join(each, "digest", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def _labelled(near: DataFrame, homes: DataFrame, links: DataFrame) -> DataFrame:
    """Every set, without its tokens, with its home and the component that ``links`` put it in."""
    labels = components(links)
    known = near.select("digest", "n").join(labels, near["digest"] == labels["node"], "left")
    known = known.select("digest", "n", F.xxhash64(F.coalesce("root", "digest")).alias("component"))
    return known.join(homes.select("digest", "home"), "digest")


def _hub_meets(matrix: DataFrame) -> DataFrame:
    """Of the groups that hold a token, all ask one, which holds the largest component: at most a row a (token, group)."""
    hub = matrix.groupBy("token").agg(F.max(F.struct("top", "home", "smallest", "largest")).alias("hub"))
    meets = matrix.select("token", F.col("home").alias("asking"), "low").join(hub, "token")
    return meets.select(*(f"hub.{c}" for c in ("home", "top", "smallest", "largest")), "asking", "low").where("low < top")


def _all_meets(matrix: DataFrame) -> DataFrame:
    """Any two groups that hold a token, and each with itself."""
    other = matrix.select("token", *(F.col(c).alias(f"o_{c}") for c in matrix.columns[1:]))
    meets = matrix.join(other, "token").where(
        f"home <= o_home and (low < o_top or o_low < top) and {WHOLE} * largest >= {SHARE} * o_smallest and {WHOLE} * o_largest >= {SHARE} * smallest")

    def way(home: str, asking: str):
        """What an asking group has to know of a home: its largest component and the sizes of its sets."""
        parts = [F.col(f"{home}{c}").alias(c) for c in ("home", "top", "smallest", "largest")]
        return F.struct(*parts, F.col(f"{asking}home").alias("asking"), F.col(f"{asking}low").alias("low"))

    return meets.select(F.inline(F.array(way("", "o_"), way("o_", "")))).where("low < top")


def _cross_links(known: DataFrame, near: DataFrame, again: bool) -> tuple[DataFrame, bool]:
    """(links between sets of different components, whether these are all), through the token-group matrix.

    They are not all where a family has many groups: then those to one group a token, unless this is done ``again``.

    Tokens go by the number of components that hold them, fewest first; two linked sets share one of the first
    ``n - least_overlap(n) + 1`` of each. A token of one component leads nowhere and only takes up a place.
    """
    # Of two components the smaller asks, so a large one that many groups hold is asked and does not ask back.
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("sets"))
    ranked = stored(known.join(sizes, "component").withColumn("rank", F.struct("sets", "component")).select("digest", "n", "component", "rank", "home"), "ranked")
    # A token moves with its digest alone; what else is known of a set joins the few tokens that are left.
    held = near.select("digest", "tokens")
    spread = held.join(ranked.select("digest", "component"), "digest").select("component", F.explode("tokens").alias("token"))
    spread = spread.distinct().groupBy("token").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
    own = Window.partitionBy("digest")
    rows = held.select("digest", F.explode("tokens").alias("token")).join(stored(spread, "spread"), "token")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy("spread", "token"))).withColumn("crossing", F.count(F.lit(1)).over(own))
    rows = rows.join(ranked.drop("component"), "digest").where(f"place <= crossing - int(ceil({SHARE} * n / {WHOLE}D)) + 1")
    rows = stored(rows.select("digest", "n", "rank", "home", "token"), "crossing")
    # Components go together by the largest one that they share a token with: the copies of one text, told apart by
    # their smallest tokens, then stand in few groups.
    tops = rows.groupBy("token").agg(F.max("rank").alias("family"))
    family = rows.join(tops, "token").groupBy("rank").agg(F.max("family").alias("family"))
    placed = rows.select("digest", "n", "rank", "home").distinct().join(family, "rank")
    cuts = placed.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / (GROUP // 2)).alias("cuts"))
    placed = placed.join(cuts, "family").withColumn("home", F.xxhash64("family.component", F.expr("pmod(xxhash64(home), cuts)")))
    placed = stored(placed.select("digest", "n", "rank", "home", "cuts"), "homes")
    whole = again or (placed.agg(F.max("cuts")).first()[0] or 0) <= FAMILY
    placed = placed.drop("cuts")
    matrix = rows.select("token", "digest").join(placed, "digest").groupBy("token", "home").agg(
        F.min("n").alias("smallest"), F.max("n").alias("largest"), F.min("rank").alias("low"), F.max("rank").alias("top"))
    meets = _all_meets(matrix) if whole else _hub_meets(matrix)
    meets = meets.groupBy("home", "asking").agg(F.max("top").alias("top"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
    meets = stored(meets, "meets")
    meets = meets.join(placed.withColumnRenamed("home", "asking"), "asking")
    meets = meets.where(f"rank < top and {WHOLE} * largest >= {SHARE} * n and {WHOLE} * n >= {SHARE} * smallest").select("home", "digest")
    busy = meets.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("blocks"))
    asks = meets.join(busy, "home").select("home", F.expr("cast(pmod(xxhash64(digest, 3), blocks) as int)").alias("block"), "digest")
    asks = asks.join(near.select("digest", "tokens"), "digest")
    members = placed.select("home", "digest", F.col("rank.component").alias("component")).join(busy, "home")
    members = members.join(near.select(F.col("digest").alias("member"), F.col("tokens").alias("held")), F.col("digest") == F.col("member"))
    members = members.select(F.col("home").alias("at"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("part"), "member", "component", "held")
    opened = members.groupBy("at", "part").cogroup(asks.groupBy("home", "block")).applyInPandas(_open, "src binary, dst binary")
    return stored(opened, "links"), whole


def drop_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, all columns kept: that of the smallest id (nulls last), then digest.

    A document is an id with a text; rows that repeat both are one document and stay or go together. Rows that
    share only an id are documents of their own. A text without words is similar to nothing and stays.
    """
    sha = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), sha.alias("sha"))
    found = similar_sets(docs.select(key.alias("doc_id"), F.col(text).alias("text")))
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.id").alias("_gone"), F.col("doc_id.sha").alias("_gone_sha"))
    gone = stored(gone.distinct(), "gone")
    own = free_name(docs, "sha")
    rows = docs.withColumn(own, sha)
    return rows.join(gone, rows[doc_id].eqNullSafe(gone["_gone"]) & (rows[own] == gone["_gone_sha"]), "left_anti").drop(own)
