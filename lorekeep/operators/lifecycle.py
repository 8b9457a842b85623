"""Record lifecycle: visibility, rule gate, duplicates, capped core, retention plans, edits, access touches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scores import DAY_MS, STABLE_TYPES
from ..functions.text import char_bigrams, estimated_tokens, fingerprint, jaccard, text_of
from .ordered import cut, running

# States that leave the core, and those that leave retrieval.
DEAD = ("archived", "superseded", "deleted")
NOT_CORE = (*DEAD, "dormant")


def is_core(status: Column | str = "status") -> Column:
    """Null counts as active."""
    return ~F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit("active")).isin(*NOT_CORE)


def is_retrievable(status: Column | str = "status") -> Column:
    """Core and dormant records."""
    return ~F.coalesce(F.col(status) if isinstance(status, str) else status, F.lit("active")).isin(*DEAD)


def layer(df: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """Rows of one layer: ``active``, ``dormant``, ``all`` (retrievable) or ``archived`` (everything)."""
    tests = {"active": is_core(), "dormant": F.col("status") == "dormant", "all": is_retrievable(), "archived": F.lit(True)}
    rows = df.where(tests[name])
    return rows.where(F.col("type") == kind) if kind else rows


# Words that point at a context, and what anchors a text without it.
DEIXIS = r"(?i)(这个|这些|这条|这段|这句|这点|这样|这种|这方面|这角度|那个|那些|上述|上面(?:说|提|讲)?的|前面(?:说|提|讲)?的|刚才(?:说|提|讲)?的|如上|此事|本次讨论|你说的|我说的|上文)|(?<![A-Za-z0-9_])(?:this|these|those|the above)(?![A-Za-z0-9_])"
ANCHOR = r"[A-Za-z][A-Za-z0-9._/-]{1,}|[「『《\"'`\[(][^\s」』》\"'`\])]{2,}[」』》\"'`\])]"


def unresolved(title: Column, content: Column, self_contained: int = 30) -> Column:
    """Points at a context, has no anchor and is short."""
    body = F.trim(text_of(content))
    blob = F.concat_ws("\n", text_of(title), body)
    return blob.rlike(DEIXIS) & ~blob.rlike(ANCHOR) & (F.length(F.regexp_replace(body, r"\s+", "")) <= self_contained)


def changelog(title: Column, content: Column) -> Column:
    """Release notes, commit or patch titles, lists of changed files, activity reports.

    A title that begins with a version needs a body that is a report, and then the report decides by itself.
    """
    t, c = F.trim(text_of(title)), text_of(content)
    lines = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda x: x != "")
    paths = F.size(F.filter(lines, lambda x: x.rlike(r"^[-*]\s+\S+") & x.rlike(r"[./\\]")))
    prose = F.length(F.regexp_replace(F.regexp_replace(c, r"(?m)^[-*].*$", ""), r"\s+", ""))
    blob = F.concat_ws("\n", t, c)
    reports = F.regexp_count(blob, F.lit(r"(?i)验收\s*\d+\s*/\s*\d+|全套 smoke|git 快进|同步至 v\d"))
    return (
        ((paths >= 3) & (prose < 40))
        | blob.rlike(r"改了\s*\d+\s*个文件")
        | blob.rlike(r"(?i)本次\s*session\s*改动")
        | t.rlike(r"(?i)^(git\s+)?commit\b|^PR\s*#\s*\d+|\b(changelog|release notes)\b|\bpatch\s*#\s*\d+")
        | (t.rlike("^(本次完成|本次工作|完成情况|验收清单|工作总结)") & c.rlike("验收|PASS|git 快进|改了"))
        | (reports >= 3)
        | ((reports >= 2) & ~c.rlike("根因|以后"))
    )


def rule_gate(df: DataFrame) -> DataFrame:
    """Add ``reason`` (null: admitted) and ``route``; rows have ``type, title, content, source_kind``."""
    kind, user = F.col("type"), F.coalesce(F.col("source_kind") == "user_explicit", F.lit(False))
    shortest = F.when(user, 12).otherwise(20)
    reason = (
        F.when(kind == "change", "type_change")
        .when(kind == "issue", "type_issue")
        .when((kind == "context") & ~user, "context_not_user_explicit")
        .when(~F.coalesce(kind.isin("context", *STABLE_TYPES), F.lit(False)), "type_forbidden")
        .when(F.length(F.trim(text_of("content"))) < shortest, "content_too_short")
        .when(unresolved(F.col("title"), F.col("content")), "unresolved_reference")
        .when(changelog(F.col("title"), F.col("content")), "changelog_genre")
    )
    route = F.when(F.col("reason").isin("type_change", "changelog_genre"), "timeline").when(F.col("reason") == "type_issue", "todo")
    return df.withColumn("reason", reason).withColumn("route", route)


def with_fingerprint(df: DataFrame) -> DataFrame:
    return df.withColumn("fingerprint", fingerprint(F.col("type"), F.col("title"), F.col("content")))


def first_of_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """``key, fingerprint, keeper`` (the least key of equal fingerprints) ``, duplicate`` of every row.

    Texts are read once; the least key is pre-aggregated where the rows are, so a fingerprint of a third of all rows is a row a task.
    """
    rows = cut(with_fingerprint(df).select(key, "fingerprint"))
    least = rows.groupBy("fingerprint").agg(F.min(key).alias("keeper"))
    return rows.join(least, "fingerprint").withColumn("duplicate", F.col(key) != F.col("keeper"))


#: Places of members in the products of sets (fewest first), members that have a bit of their own, rows of a stripe, and rows of a tile within a task.
PLACES, BITS, STRIPE, HOT = (128, 256, 512), 1024, 1 << 16, 2048


def _members(g: Column) -> Column:
    """A set whose members have at most two letters as one text, two letters each; equal sets give equal texts."""
    return F.array_join(F.transform(F.array_sort(g), lambda w: F.rpad(w, 2, "\n")), "")


class _Sets:
    """Sets (``n, members``, see :func:`_members`) within a task: a bound of what two share by products, and what they share.

    The most frequent members have a place of their own, others share the rest, so many that random sets meet there once at most if places suffice.
    The product of two sets' counts is at least the size of what they share, so members that fall together add pairs and lose none.
    """

    def __init__(self, table: pa.Table, share: float) -> None:
        self.n = n = table.column("n").to_numpy().astype(np.int64)
        letters = np.frombuffer("".join(table.column("members").to_pylist()).encode("utf-32-le"), np.uint32).reshape(-1, 2).astype(np.int64)
        code = pa.array(letters[:, 0] << 32 | letters[:, 1]).dictionary_encode().indices.to_numpy()
        many = np.bincount(code)
        often, rank = np.sort(many)[::-1], np.empty(len(many), np.int64)
        rank[np.argsort(-many, kind="stable")] = np.arange(len(many))
        at, code = np.repeat(np.arange(len(n)), n), rank[code]
        ways = [min((often[k:].sum() ** 2 / len(n) ** 2 / (p - k), p, k) for k in (p // 4, p // 2, p * 3 // 4)) for p in PLACES]
        _, places, own = next((w for w in ways if w[0] < 1), min(ways))
        place = np.where(code < own, code, own + code % (places - own))
        self.grid, self.bits, self.bound = np.empty((len(n), places), np.float32), np.empty((len(n), BITS // 64), np.uint64), (-share * n).astype(np.float32)[:, None]
        ends = np.concatenate([[0], np.cumsum(n)])
        for i in range(0, len(n), HOT):
            j = min(i + HOT, len(n))
            row, here = at[ends[i] : ends[j]] - i, slice(ends[i], ends[j])
            self.grid[i:j] = np.bincount(row * places + place[here], minlength=(j - i) * places).reshape(j - i, places)
            flags, first = np.zeros((j - i, BITS), bool), code[here] < BITS
            flags[row[first], code[here][first]] = True
            self.bits[i:j] = np.packbits(flags, axis=1).view(np.uint64)
        # members without a bit, by set and code
        self.codes, seldom = len(many), code >= BITS
        self.seldom = np.sort(at[seldom] * self.codes + code[seldom])
        self.first = np.searchsorted(self.seldom, np.arange(len(n) + 1) * self.codes)

    def near(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows of two tiles that may share ``share`` of both sizes together."""
        ones = lambda rows: np.ones((len(rows), 1), np.float32)
        product = np.hstack([self.grid[one], ones(one), self.bound[one]]) @ np.hstack([self.grid[other], self.bound[other], ones(other)]).T
        p, q = np.divmod(np.flatnonzero(product.ravel() >= -0.01), len(other))
        return one[p], other[q]

    def shared(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many members the sets of each pair share."""
        both = np.bitwise_count(self.bits[p] & self.bits[q]).sum(axis=1, dtype=np.int64)
        if len(self.seldom):
            n = self.first[p + 1] - self.first[p]
            pair = np.repeat(np.arange(len(p)), n)
            own = self.seldom[np.arange(len(pair)) + np.repeat(self.first[p] - np.cumsum(n) + n, n)] % self.codes + q[pair] * self.codes
            hit = self.seldom[np.minimum(np.searchsorted(self.seldom, own), len(self.seldom) - 1)] == own
            both += np.bincount(pair[hit], minlength=len(p))
        return both


def _similar(table: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of two stripes that meet (rows in the order of ``n``) the pairs of rows with a similarity of ``least`` and more, and it, tile by tile."""
    stripe, sets = table.column("stripe").to_numpy(), _Sets(table, least / (1 + least))
    x, y, n = table.column("x")[0].as_py(), table.column("y")[0].as_py(), sets.n
    tiles = [[own[i : i + HOT] for i in range(0, len(own), HOT)] for own in (np.flatnonzero(stripe == x), np.flatnonzero(stripe == y))]
    for i, one in enumerate(tiles[0]):
        for j, other in enumerate(tiles[1]):
            if (x == y and j < i) or n[one[-1]] < least * n[other[0]] or n[other[-1]] < least * n[one[0]]:
                continue
            p, q = sets.near(one, other)
            if x == y and i == j:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 1 << 16):
                a, b = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
                both = sets.shared(a, b)
                told = both / np.maximum(n[a] + n[b] - both, 1)
                keep = told >= least
                yield a[keep], b[keep], told[keep]


def _in_stripes(sets: DataFrame, near: Callable[[pa.Table], pa.Table], shape: StructType) -> DataFrame:
    """``near`` for every two stripes of a type's sets (``id, type, members`` and more), with ``n, stripe, x, y`` in the order of ``n``.

    A type's sets are dealt into stripes, and any two stripes meet in one task, where products are taken tile by tile: memory is bounded by two stripes,
    and rows are repeated as often as there are stripes, whatever the sets hold.
    """
    width = max(64, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    many = sets.groupBy(F.col("type").alias("_type")).agg(F.greatest(F.ceil(F.count("*") / STRIPE), F.lit(8)).cast("int").alias("stripes"))
    dealt = sets.withColumn("n", F.expr("cast(length(members) div 2 as int)")).join(F.broadcast(many), F.col("type").eqNullSafe(F.col("_type"))).withColumn("stripe", F.pmod(F.xxhash64("id"), F.col("stripes")).cast("int"))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).select("*", F.least("stripe", "o").alias("x"), F.greatest("stripe", "o").alias("y")).drop("_type", "stripes", "o")
    return cells.repartition(width, "type", "x", "y").groupBy("type", "x", "y").applyInArrow(lambda table: near(table.sort_by("n").combine_chunks()), shape)


def _candidates(sets: DataFrame, least: float) -> DataFrame:
    """``a, b``: each pair of sets (``id, type, g``, of members of at most two letters) of a type once that has similarity ``least``."""
    kind = sets.schema["id"].dataType

    def near(table: pa.Table) -> pa.Table:
        found = [np.zeros((2, 0), np.int64), *(np.stack([p, q]) for p, q, _ in _similar(table, least))]
        (a, b), ids = np.concatenate(found, axis=1), table.column("id")
        return pa.table({"a": ids.take(pa.array(a)), "b": ids.take(pa.array(b))})

    return _in_stripes(sets.select("id", "type", _members(F.col("g")).alias("members")), near, StructType([StructField("a", kind), StructField("b", kind)]))


def _best(sets: DataFrame, least: float) -> DataFrame:
    """``a, prior, similarity``: for each set (``id, type, members``) that ``asks`` the most similar other one of its type that has a ``prior``, from ``least`` on.

    Of equally similar ones the least ``prior`` is taken. Where two stripes meet, a set has one row of them, however many are similar.
    """
    shape = StructType([StructField("a", sets.schema["id"].dataType), StructField("prior", sets.schema["prior"].dataType), StructField("similarity", DoubleType())])

    def near(table: pa.Table) -> pa.Table:
        priors, asks = table.column("prior"), table.column("asks").to_numpy()
        has, order = priors.is_valid().to_numpy(), pc.sort_indices(priors).to_numpy()
        rank, best, prior = np.empty(len(order), np.int64), np.zeros(len(order)), np.full(len(order), len(order))
        rank[order] = np.arange(len(order))
        for p, q, told in _similar(table, least):
            for a, b in ((p, q), (q, p)):
                ok = asks[a] & has[b]
                x, r, s = a[ok], rank[b[ok]], told[ok]
                o = np.lexsort((r, -s, x))
                o = o[np.diff(x[o], prepend=-1) > 0]  # the best of each set
                x, r, s = x[o], r[o], s[o]
                better = (s > best[x]) | ((s == best[x]) & (r < prior[x]))
                best[x[better]], prior[x[better]] = s[better], r[better]
        found = np.flatnonzero(best)
        return pa.table({"a": table.column("id").take(pa.array(found)), "prior": priors.take(pa.array(order[prior[found]])), "similarity": best[found]})

    first = F.min(F.struct((-F.col("similarity")).alias("s"), "prior"))
    return _in_stripes(sets, near, shape).groupBy("a").agg(first.alias("b")).select("a", "b.prior", (-F.col("b.s")).alias("similarity"))


def near_titles(df: DataFrame, key: str, least: float = 0.85) -> DataFrame:
    """Pairs ``a < b`` of distinct titles of one type with bigram similarity of at least ``least``.

    Titles with equal bigram sets are one class, named by its least key. Classes of a type meet stripe by
    stripe (see :func:`_candidates`); only pairs that may be similar are compared as sets.
    """
    grams = df.select(key, "type", F.array_sort(char_bigrams("title")).alias("g"))
    classes = cut(grams.groupBy("type", "g").agg(F.min(key).alias("id")))
    pairs = _candidates(classes, least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sets = classes.select("id", "g")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    return both.withColumn("similarity", jaccard(F.col("ga"), F.col("gb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def core_cap(df: DataFrame, key: str, max_items: int, max_tokens: int, now_ms: int, groups: tuple[str, ...] = (), spared: tuple = ()) -> DataFrame:
    """Add ``evicted``: core records that go, worst first, until at most ``max_items`` and ``max_tokens`` stay.

    In eviction order a record goes iff more than ``max_items`` records, or more than ``max_tokens``
    tokens, stand from it to the end, so suffix sums replace the loop. Only those near the cap can
    stay: the order is cut by a distributed top-k first, without a global window over all rows.
    Keys in ``spared`` (those that the call itself writes) go last of all, pinned records before them.
    Needs ``type, title, content, importance, created_ms, status``; optional ``pinned, user_authored, accessed_ms, updated_ms``.
    """
    has = lambda c, other: F.coalesce(F.col(c), other) if c in df.columns else other
    recent = (has("accessed_ms", F.lit(0)) > 0) & (F.lit(now_ms) - has("accessed_ms", F.lit(0)) <= 7 * DAY_MS)
    held = F.col(key).isin(*spared) if spared else F.lit(False)
    order = [
        held.cast("int"),
        has("pinned", F.lit(False)).cast("int"),
        has("user_authored", F.lit(False)).cast("int"),
        recent.cast("int"),
        F.round(F.coalesce("importance", F.lit(0.0)) * 10).cast("int"),
        has("updated_ms", F.coalesce("created_ms", F.lit(0))),
    ]
    names = [f"_o{i}" for i in range(len(order))]
    ranked = df.where(is_core()).select(key, *groups, *(o.alias(n) for o, n in zip(order, names, strict=True)), estimated_tokens(F.concat(text_of("title"), text_of("content"))).alias("_tokens"))
    best_first = [F.desc(n) for n in names] + [F.desc(key)]
    if groups:
        w = Window.partitionBy(*groups).orderBy(*best_first)
        near = ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max_items)
    else:
        near = ranked.orderBy(*best_first).limit(max_items)
        w = Window.orderBy(*best_first)
        near = near.withColumn("_rank", F.row_number().over(w))
    used = F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("_used", used).where(F.col("_used") <= max_tokens).select(F.col(key).alias("_kept"))
    return df.join(kept, df[key] == kept["_kept"], "left").withColumn("evicted", is_core() & F.col("_kept").isNull()).drop("_kept")


def vacuum_plan(df: DataFrame, key: str, now_ms: int, retain_days: int = 180, min_retained: int = 50) -> DataFrame:
    """Add ``evict``: the oldest dead, unreferenced, unpinned records past their time, but ``min_retained`` dead stay."""
    referenced = df.select(F.col("superseded_by").alias("_ref")).where("_ref is not null").distinct() if "superseded_by" in df.columns else None
    dead = df.where(~is_core() & (F.coalesce("status", F.lit("active")) != "dormant"))
    spare = max(0, dead.count() - min_retained)
    old = dead.where(F.lit(now_ms) - F.col("touched_ms") > retain_days * DAY_MS)
    if "pinned" in df.columns:
        old = old.where(~F.coalesce("pinned", F.lit(False)))
    if referenced is not None:
        old = old.join(referenced, old[key] == referenced["_ref"], "left_anti")
    gone = old.orderBy("touched_ms", key).limit(spare).select(F.col(key).alias("_gone"))
    return df.join(gone, df[key] == gone["_gone"], "left").withColumn("evict", F.col("_gone").isNotNull()).drop("_gone")


def timeline_trim(events: DataFrame, key: str, now_ms: int, retain_days: int, max_events: int) -> DataFrame:
    """Events that stay: anchors (``init`` and the latest summary) and the newest unexpired up to ``max_events`` in all.

    Newest first, an event stays while fewer than ``max_events`` are kept, anchors among them; so
    with ``a`` anchors before it, the r-th unexpired other stays iff r + a is at most ``max_events``.
    """
    latest = events.where("event_type = 'session_summary'").orderBy(F.desc("occurred_ms"), F.asc(key)).limit(1).select(F.col(key).alias("_latest"))
    marked = events.join(F.broadcast(latest), events[key] == latest["_latest"], "left")
    anchor = (F.col("event_type") == "init") | F.col("_latest").isNotNull()
    fresh = F.lit(now_ms) - F.col("occurred_ms") <= retain_days * DAY_MS
    rows = marked.withColumn("anchor", anchor).where(F.col("anchor") | fresh)
    # Only the newest max_events of the eligible can pass; anchors beyond them stay anyway.
    near = rows.orderBy(F.desc("occurred_ms"), F.asc(key)).limit(max_events)
    return near.unionByName(rows.where("anchor")).dropDuplicates([key]).drop("_latest")


def access_touch(touches: DataFrame, key: str, at: str, throttle_ms: int = 300_000) -> DataFrame:
    """Accepted touches: the first of a key, then each that comes ``throttle_ms`` or more after the last accepted.

    The last accepted one depends on all before, so a key's times are walked in order; a key's rows
    arrive sorted in batches and one number is carried, whatever their count.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for rows in frames:
            keep = []
            for k, t in zip(rows[key], rows[at], strict=True):
                if k != now or last is None or t - last >= throttle_ms:
                    keep.append(True)
                    now, last = k, t
                else:
                    keep.append(False)
            yield rows[keep]

    ordered = touches.select(key, at).where(F.col(key).isNotNull() & F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at)
    return ordered.mapInPandas(walk, ordered.schema)


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace rows of the same key; new keys are added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete(base: DataFrame, ids: list, key: str) -> DataFrame:
    """Rows without the ids, and without references to them."""
    rows = base.where(~F.col(key).isin(ids))
    return rows.withColumn("superseded_by", F.when(~F.col("superseded_by").isin(ids), F.col("superseded_by"))) if "superseded_by" in base.columns else rows


def supersede(base: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Records named in ``pairs`` (old, new) become superseded by the new one."""
    return base.join(pairs.withColumnRenamed("old", key).groupBy(key).agg(F.min("new").alias("_new")), key, "left").withColumn("status", F.when(F.col("_new").isNotNull(), "superseded").otherwise(F.col("status"))).withColumnRenamed("_new", "superseded_by")


def lookup(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Records whose id is or starts with ``prefix``, with ``outcome``: ok, E_NOT_FOUND has no rows, E_AMBIGUOUS_ID has several."""
    found = df.where(F.col(key).cast("string").startswith(prefix))
    exact = found.where(F.col(key).cast("string") == prefix)
    chosen = found if exact.isEmpty() else exact
    n = chosen.limit(2).count()
    return chosen.withColumn("outcome", F.lit("ok" if n == 1 else "E_AMBIGUOUS_ID"))


def evaluate_admission(incoming: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Add ``outcome``: rejected (by the gate, with its reason and route), duplicate (of ``existing``, by fingerprint), or inserted."""
    known = with_fingerprint(store.where(is_retrievable())).groupBy("fingerprint").agg(F.min(key).alias("existing"))
    rows = with_fingerprint(rule_gate(incoming)).join(known, "fingerprint", "left")
    outcome = F.when(F.col("reason").isNotNull(), "rejected").when(F.col("existing").isNotNull(), "duplicate").otherwise("inserted")
    return rows.withColumn("outcome", outcome)


def best_prior(incoming: DataFrame, store: DataFrame, key: str, least: float = 0.72) -> DataFrame:
    """``key, prior, similarity``: for each incoming record the stored one of its type, another than itself, with the most similar title, from ``least`` on.

    Sets of bigrams are classes first, so a title of many records is met once; classes meet stripe by stripe (see
    :func:`_best`). Of equally similar ones the least key is taken.
    """
    both = incoming.select(key, "type", "title", F.lit(True).alias("new")).unionByName(store.where(is_core()).select(key, "type", "title", F.lit(False).alias("new")))
    grams = both.select(key, "new", "type", _members(char_bigrams("title")).alias("members"))
    # of a class the two least stored keys, for one of them may be the record itself; none of another class is as similar as they are
    stored = F.array_sort(F.collect_set(F.when(~F.col("new"), F.col(key))))
    classes = cut(grams.groupBy("type", "members").agg(F.slice(stored, 1, 2).alias("stored"), F.max("new").alias("asks")).withColumn("id", F.monotonically_increasing_id()))
    best = _best(classes.select("id", "type", "members", "asks", F.get("stored", F.lit(0)).alias("prior")), least)
    told = classes.where("asks").join(best, F.col("id") == F.col("a"), "left").where("size(stored) > 0 or prior is not null")
    told = told.select(F.col("type").alias("_type"), F.col("members").alias("_members"), "stored", "prior", "similarity")
    asked = grams.where("new").join(told, F.col("type").eqNullSafe(F.col("_type")) & (F.col("members") == F.col("_members")))
    own = F.get(F.filter("stored", lambda x: x != F.col(key)), F.lit(0))
    return asked.select(key, F.coalesce(own, "prior").alias("prior"), F.when(own.isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity")).where("prior is not null")


def within_budget(df: DataFrame, size: str, budget: int, order: list) -> DataFrame:
    """The first rows in ``order`` whose sizes sum to at most ``budget``, over all rows: sums of ranges of the order go before running sums within."""
    return running(df, order, size).where(F.col("_used") <= budget).drop("_used")


def housekeep(memories: DataFrame, key: str, max_items: int, max_tokens: int, now_ms: int) -> DataFrame:
    """Statuses filled in, core records over the cap put to sleep; no row is dropped."""
    filled = memories.withColumn("status", F.coalesce("status", F.lit("active")))
    return core_cap(filled, key, max_items, max_tokens, now_ms).withColumn("status", F.when(F.col("evicted"), "dormant").otherwise(F.col("status"))).drop("evicted")


def edited(memories: DataFrame, key: str, target: str, patch: dict[str, str], now_ms: int) -> DataFrame:
    """One record with fields of ``patch`` replaced; unknown fields are refused, the time of change is set."""
    if unknown := set(patch) - {"title", "content", "type", "importance", "status", "pinned"}:
        raise ValueError(f"fields that can't be edited: {sorted(unknown)}")
    here, kinds = F.col(key) == target, dict(memories.dtypes)
    columns = {c: F.when(here, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in patch.items()}
    return memories.withColumns(columns | {"updated_ms": F.when(here, F.lit(now_ms)).otherwise(F.col("updated_ms") if "updated_ms" in memories.columns else F.lit(None))})
