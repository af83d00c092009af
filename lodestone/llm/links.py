"""Exact joins of documents whose shingle sets have a Jaccard similarity of at least a threshold.

Size-aware heavy-light join. Exact copies are one class first. Small sets enumerate fixed-size
subsets: two small sets link only if they share a subset as large as their least overlap. Large
sets scan inverted lists of their prefixes: in one global order, linked sets share one of their
first elements. The boundary between the two comes from a cost model over counted statistics. Lists
that lead to the same set are verified together, with whole sets, and links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrow import Output, Seen, columns_of, slices, tidy, tidy_table
from lodestone.llm.components import connected
from lodestone.llm.shared import removed, written
from lodestone.llm.shingles import Words, class_of, distinct, mix

#: Sets of more elements than this are never enumerated.
LARGEST_SMALL = 12
#: In the cost model, checking one candidate costs as much as so many keys.
CHECK_COST = 8
#: Frequent shingles: the most that one task reports, the count that it reports from, the count that
#: matters over all, and the most that are broadcast (about 10 MB). They only order the lists.
LOCAL_FREQUENT, LOCAL_LEAST, LEAST_FREQUENT, MOST_FREQUENT = 2_000, 4, 5, 400_000
#: Small sets of one size that a task keeps for the cost model; the others are counted.
SMALL_SETS = 10_000
#: Elements and members of a group that are verified at once; larger groups are split into blocks.
BLOCK_ELEMENTS, BLOCK_MEMBERS = 500_000, 1_024
#: Keys of one bucket and elements of one verifying task, about.
BUCKET_KEYS, TASK_ELEMENTS = 300_000, 1_000_000
#: Rows of a list, up to which each is held against each other by size and place.
CLOSE = 32
#: Keys that a task deals at once.
FLUSH_KEYS = 1 << 18


class Threshold:
    """Jaccard similarity of at least ``percent`` of a hundred, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a: int, b: int) -> int:
        """The least number of shared elements of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def compatible(self, a: int, b: int) -> bool:
        return 100 * min(a, b) >= self.percent * max(a, b)

    def prefix(self, n: int) -> int:
        """Of how many first elements one is shared with every linked set."""
        return n - -(-self.percent * n // 100) + 1

    def partners(self, n: int, most: int) -> list[int]:
        return [b for b in range(1, most + 1) if self.compatible(n, b) and self.overlap(n, b) <= min(n, b)]

    def subsets(self, n: int, most: int) -> int:
        return sum(comb(n, self.overlap(n, b)) for b in self.partners(n, most))

    def linked(self, shared: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (a + b - shared)


def choose_boundary(sizes: list[tuple[int, int, float]], threshold: Threshold) -> int:
    """The largest size up to which subsets cost no more than lists.

    ``sizes`` are (size, classes, sets that share an element, on average). A list costs its keys and
    CHECK_COST for each candidate.
    """
    best, of = 0, {size: (count, shared) for size, count, shared in sizes}
    for most in range(1, LARGEST_SMALL + 1):
        inside = [(n, *of[n]) for n in range(1, most + 1) if n in of]
        enumerated = sum(count * threshold.subsets(n, most) for n, count, _ in inside)
        scanned = sum(count * threshold.prefix(n) * (1 + CHECK_COST * shared) for n, count, shared in inside)
        if inside and enumerated <= scanned:
            best = most
    return best


class Frequent:
    """The most frequent elements of a stream in bounded memory, and the smallest class with each."""

    def __init__(self, hold: int = 1 << 18, keep: int = 1 << 16):
        self.hold, self.keep, self.parts, self.held = hold, keep, [], 0
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, elements: np.ndarray, owner: int) -> None:
        self.parts.append((elements, owner))
        self.held += len(elements)
        if self.held >= self.hold:
            self.fold()

    def fold(self) -> None:
        element, count, owner = self.known
        element = np.concatenate([element, *(e for e, _ in self.parts)])
        count = np.concatenate([count, np.ones(self.held, np.int64)])
        owner = np.concatenate([owner, *(np.full(len(e), o, np.int64) for e, o in self.parts)])
        self.parts, self.held = [], 0
        if not len(element):
            return
        order = np.argsort(element, kind="stable")
        element, count, owner = element[order], count[order], owner[order]
        at = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
        element, count, owner = element[at], np.add.reduceat(count, at), np.minimum.reduceat(owner, at)
        keep = np.flatnonzero(count >= 2)
        if len(keep) > self.keep:
            keep = keep[np.argpartition(-count[keep], self.keep)[: self.keep]]
            keep.sort()
        self.known = (element[keep], count[keep], owner[keep])

    def top(self, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.fold()
        element, count, owner = self.known
        keep = np.flatnonzero(count >= least)
        if len(keep) > most:
            keep = keep[np.lexsort((element[keep], -count[keep]))[:most]]
        return element[keep], count[keep], owner[keep]


FACTS = "kind int, doc_id long, n long, cid long"
FACTS_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64())])


def _facts(docs: DataFrame) -> DataFrame:
    """One pass over the texts. kind 0: a document, its set's size and class (null: no set); 1: a
    frequent shingle, its count and smallest class; 2: a small size, its classes and shared elements."""

    def run(batches):
        seen, frequent, small, out = Seen(), Frequent(), {}, Output(FACTS_ARROW)
        for batch in slices(batches):
            for doc_id, elements in zip(batch.column(0).to_pylist(), Words(batch.column(1), lower=True).sets(), strict=True):
                n = len(elements)
                cid = class_of(elements) if n else None
                if n and seen.new(cid):
                    frequent.add(elements, cid)
                    if n <= LARGEST_SMALL:
                        count, parts = small.setdefault(n, (0, []))
                        small[n] = (count + 1, parts)
                        if count < SMALL_SETS:
                            parts.append(elements)
                if out.add(0, doc_id, n, cid):
                    yield out.batch()
        element, count, owner = frequent.top(LOCAL_FREQUENT, LOCAL_LEAST)
        for row in zip(element.view(np.int64).tolist(), count.tolist(), owner.tolist(), strict=True):
            out.add(1, *row)
        known, counts, _ = frequent.known
        for n, (count, sets) in small.items():
            elements = np.concatenate(sets)
            at = np.minimum(np.searchsorted(known, elements), max(0, len(known) - 1))
            shared = counts[at][known[at] == elements].sum() if len(known) else 0
            out.add(2, n, count, int(shared * count / len(sets)))
        yield out.batch()

    return docs.mapInArrow(tidy(run), FACTS)


class Order:
    """The global order of elements: rare ones by hash, then frequent ones by their count.

    Any fixed order keeps the join exact; this one keeps frequent shingles out of prefixes.
    ``group`` gives a frequent element's group, so that its list needn't meet in one task.
    """

    def __init__(self, element: np.ndarray, count: np.ndarray, owner: np.ndarray):
        by_hash = np.argsort(element)
        self.element, self.owner = element[by_hash], owner[by_hash]
        self.rank = np.empty(len(element), np.int64)
        self.rank[np.lexsort((element, count))] = np.arange(len(element))
        self.rank = self.rank[by_hash]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[element >> np.uint64(44)] = True

    @classmethod
    def of(cls, frequent: DataFrame) -> Order:
        """From element, n and cid; of more than MOST_FREQUENT elements the most frequent count."""
        top = frequent.where(f"n >= {LEAST_FREQUENT}").orderBy(F.desc("n"), "element").limit(MOST_FREQUENT).toArrow()
        element, count, owner = (top.column(c).to_numpy() for c in ("element", "n", "cid"))
        return cls(element.view(np.uint64), count, owner)

    def first(self, elements: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a sorted set's first elements: the rare ones, and the groups of the frequent ones."""
        rare, groups = elements, np.zeros(0, np.int64)
        if len(self.element):
            maybe = np.flatnonzero(self.maybe[elements >> np.uint64(44)])
            if len(maybe):
                at = np.minimum(np.searchsorted(self.element, elements[maybe]), len(self.element) - 1)
                hit = self.element[at] == elements[maybe]
                if hit.any():
                    at = at[hit]
                    rare = np.delete(elements, maybe[hit])
                    if len(rare) < most:
                        groups = self.owner[at[np.argsort(self.rank[at])][: most - len(rare)]]
        return rare[:most], groups


def _subset_keys(elements: np.ndarray, most: int, threshold: Threshold) -> np.ndarray:
    """A key for each fixed-size subset of a small set and each size of a small partner."""
    n, mixed = len(elements), mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    keys = []
    for b in threshold.partners(n, most):
        low, high, size = min(n, b), max(n, b), threshold.overlap(n, b)
        chosen = np.array(list(combinations(range(n), size)), np.int64)
        keys.append(mix(mixed[chosen].sum(axis=1, dtype=np.uint64) + np.uint64(1 + low * 64 + high)))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _keys(docs: DataFrame, order: Order, boundary: int, buckets: int, threshold: Threshold) -> DataFrame:
    """Each class's keys, packed by bucket: bucket, known and data, rows of a key, a class, its size and the key's place.

    With ``known`` the key is a group's name, and nothing has to meet: those rows are dealt by class.
    """
    schema = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("data", pa.binary())])

    def packed(out, keys, owners, sizes, known):
        key, owner, size = np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes)
        bucket = ((mix(owner.view(np.uint64) if known else key) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rows = np.stack([key[by].view(np.int64), owner[by], size[by]], axis=1)
        ends = np.cumsum(np.bincount(bucket, minlength=buckets))
        begin = 0
        for b, end in enumerate(ends.tolist()):
            if end > begin:
                data = rows[begin:end].tobytes()
                if out.add(b, known, data, size=len(data)):
                    yield out.batch()
            begin = end

    def run(batches):
        seen, out, held = Seen(), Output(schema), 0
        pending: dict[bool, tuple[list, list, list]] = {False: ([], [], []), True: ([], [], [])}

        def hold(known, key, cid, n, place):
            for column, values in zip(pending[known], (key, np.full(len(key), cid, np.int64), (n << 32) + place), strict=True):
                column.append(values)
            return len(key)

        def flush():
            for known, columns in pending.items():
                if columns[0]:
                    yield from packed(out, *columns, known)
                    for column in columns:
                        column.clear()

        for batch in slices(batches):
            for elements in Words(batch.column(1), lower=True).sets():
                n = len(elements)
                cid = class_of(elements) if n else None
                if not n or not seen.new(cid):
                    continue
                if n <= boundary:
                    subsets = _subset_keys(elements, boundary, threshold)
                    held += hold(False, subsets, cid, n, np.zeros(len(subsets), np.int64))
                if n > boundary or threshold.compatible(n, boundary + 1):
                    rare, known = order.first(elements, threshold.prefix(n))
                    held += hold(False, rare, cid, n, np.arange(len(rare)))
                    if len(known):
                        known = np.unique(known).view(np.uint64)
                        held += hold(True, known, cid, n, np.zeros(len(known), np.int64))
                if held >= FLUSH_KEYS:
                    yield from flush()
                    held = 0
        yield from flush()
        yield out.batch()

    return docs.mapInArrow(tidy(run), "bucket int, known boolean, data binary")


def _rows(table: pa.Table, known: bool) -> np.ndarray:
    """The distinct rows of one kind in a bucket (key or group, class, size and place), in their order by key, size, place, class."""
    packed = table.filter(pa.compute.equal(table.column("known"), known)).column("data").to_pylist()
    rows = np.concatenate([np.zeros((0, 3), np.int64), *(np.frombuffer(data, np.int64).reshape(-1, 3) for data in packed)])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new]


def _begins(changes: np.ndarray) -> np.ndarray:
    """Where runs begin, from whether each row but the first differs from the one before it."""
    return np.flatnonzero(np.concatenate([[True], changes]))


def _frequent_keys(keys: DataFrame) -> DataFrame:
    """Keys whose lists have LEAST_FREQUENT classes or more: element, n and the smallest class."""

    def of_bucket(table: pa.Table) -> pa.Table:
        key, cid, _ = _rows(table, False).T
        at = _begins(key[1:] != key[:-1]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(at, len(key)))
        least = np.minimum.reduceat(cid, at) if len(key) else cid
        often = size >= LEAST_FREQUENT
        return pa.table({"element": key[at][often], "n": size[often], "cid": least[often]})

    return keys.groupBy("bucket").applyInArrow(tidy_table(of_bucket), "element long, n long, cid long")


def may_link(key: np.ndarray, n: np.ndarray, place: np.ndarray, threshold: Threshold) -> np.ndarray:
    """Of rows in the order of key and size, those that may have a linked partner in their list.

    The first element that linked sets share leaves each of them as many elements, from its place
    on, as they share at least. Rows are held against those after them one distance at a time; lists
    of more than CLOSE rows keep all of them.
    """
    alive = np.zeros(len(key), bool)
    low = np.arange(len(key))
    for step in range(1, CLOSE + 1):
        low = low[low + step < len(key)]
        low = low[key[low] == key[low + step]]
        if not len(low):
            return alive
        high = low + step
        near = 100 * n[low] >= threshold.percent * n[high]
        left = np.minimum(n[low] - place[low], n[high] - place[high])
        near &= left * (100 + threshold.percent) >= threshold.percent * (n[low] + n[high])
        alive[low[near]] = alive[high[near]] = True
    longer = low + CLOSE
    return alive | np.isin(key, key[longer])


def _memberships(keys: DataFrame, threshold: Threshold) -> DataFrame:
    """Each class with the groups that it is to be verified in.

    Of a list stay those rows that may have a partner by size and place. In the order of sizes it
    breaks where neighbours are too unlike in size to link; each part of two or more is a group,
    named by its smallest class.
    """

    def of_bucket(table: pa.Table) -> pa.Table:
        pairs = [_rows(table, True)[:, :2]]
        rows = _rows(table, False)
        rows = rows[may_link(rows[:, 0], rows[:, 2] >> 32, rows[:, 2] & 0xFFFFFFFF, threshold)]
        key, cid, n = rows[:, 0], rows[:, 1], rows[:, 2] >> 32
        if len(key):
            at = _begins((key[1:] != key[:-1]) | (100 * n[:-1] < threshold.percent * n[1:]))
            size = np.diff(np.append(at, len(key)))
            shared = np.repeat(size, size) > 1
            pairs.append(np.stack([np.repeat(np.minimum.reduceat(cid, at), size)[shared], cid[shared]], axis=1))
        pairs = np.concatenate(pairs)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
        return pa.table({"grp": pairs[new, 0], "cid": pairs[new, 1]})

    return keys.groupBy("bucket").applyInArrow(tidy_table(of_bucket), "grp long, cid long").distinct()


def _class_texts(docs: DataFrame) -> DataFrame:
    """A text of each class, once in each task: cid, text."""
    schema = pa.schema([("cid", pa.int64()), ("text", pa.string())])

    def run(batches):
        seen = Seen()
        for batch in slices(batches):
            rows, names = [], []
            for i, elements in enumerate(Words(batch.column(1), lower=True).sets()):
                if len(elements) and seen.new(cid := class_of(elements)):
                    rows.append(i)
                    names.append(cid)
            if rows:
                texts = batch.column(1).take(pa.array(rows, pa.int64())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), texts], schema=schema)

    return docs.mapInArrow(tidy(run), "cid long, text string")


MEMBER = "task int, grp long, i int, j int, block int, cid long, grps array<long>, data binary"


def _members(texts: DataFrame, tasks: int) -> DataFrame:
    """A row with the whole set for each group and pair of blocks that a class takes part in.

    ``texts`` has cid, text and ``of``: structs of a group and its number of blocks.
    """
    schema = pa.schema([("task", pa.int32()), ("grp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("cid", pa.int64()), ("grps", pa.list_(pa.int64())), ("data", pa.binary())])

    def run(batches):
        out = Output(schema)
        for batch in slices(batches):
            for cid, of, elements in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), Words(batch.column(1), lower=True).sets(), strict=True):
                data, groups = elements.tobytes(), sorted(x["grp"] for x in of)
                for x in of:
                    group, blocks = x["grp"], x["blocks"]
                    block = (cid * 0x9E3779B97F4A7C15 >> 40) % blocks
                    for other in range(blocks):
                        i, j = min(block, other), max(block, other)
                        task = hash((group, i, j)) % tasks
                        if out.add(task, group, i, j, block, cid, groups, data, size=len(data)):
                            yield out.batch()
        yield out.batch()

    return texts.select("cid", "text", "of").mapInArrow(tidy(run), MEMBER)


def _overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set, its number of shared elements with every earlier one, from inverted lists."""
    sizes = [len(s) for s in sets]
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(element, kind="stable")
    element, owner = element[by], owner[by]
    at = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    length = np.diff(np.append(at, len(element)))
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))  # where each set's elements stand in the lists
    begin = np.repeat(at, length)
    ends = np.cumsum(sizes)
    for k in range(1, len(sets)):
        mine = place[ends[k] - sizes[k] : ends[k]]
        start, count = begin[mine], mine - begin[mine]  # a list is in the order of the sets: the earlier ones stand before
        total = int(count.sum())
        if not total:
            continue
        step = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        yield k, np.bincount(owner[step + np.arange(total)], minlength=k)


def linked_pairs(sets: list[np.ndarray], block: list[int], across: bool, threshold: Threshold) -> Iterator[tuple[int, int]]:
    """Pairs of positions of linked sets; with ``across``, only those of two different blocks."""
    size, where = np.array([len(s) for s in sets]), np.array(block)
    for k, shared in _overlaps(sets):
        hit = threshold.linked(shared, size[:k], size[k])
        if across:
            hit &= where[:k] != where[k]
        for other in np.flatnonzero(hit).tolist():
            yield other, k


def _verified(members: DataFrame, threshold: Threshold) -> DataFrame:
    """Links of classes, as a star for each group: cid, root and n_links.

    A pair that meets in several groups counts in the smallest of them alone.
    """

    def of_task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("grp", "ascending"), ("i", "ascending"), ("j", "ascending"), ("cid", "ascending")])
        grp, i, j, block, cid = (table.column(c).to_numpy() for c in ("grp", "i", "j", "block", "cid"))
        grps, data = table.column("grps"), table.column("data")
        new = np.flatnonzero(np.concatenate([[True], (grp[1:] != grp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(grp) else []
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(new, [*new[1:], len(grp)], strict=True):
            if b - a < 2:
                continue
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in data.slice(a, b - a)]
            names, groups = cid[a:b].tolist(), [None] * (b - a)
            root, count = list(range(b - a)), [0] * (b - a)

            def find(x, root=root):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def of(x, a=a, groups=groups):
                if groups[x] is None:
                    groups[x] = frozenset(grps[int(a) + x].as_py())
                return groups[x]

            touched = set()
            for x, y in linked_pairs(sets, block[a:b].tolist(), bool(i[a] != j[a]), threshold):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
                touched |= {x, y}
                if min(of(x) & of(y)) == grp[a]:
                    count[x] += 1
                    count[y] += 1
            for x in touched:
                for column, value in zip(out, (names[x], names[find(x)], count[x]), strict=True):
                    column.append(value)
        return pa.table({"cid": pa.array(out[0], pa.int64()), "root": pa.array(out[1], pa.int64()), "n_links": pa.array(out[2], pa.int64())})

    return members.groupBy("task").applyInArrow(tidy_table(of_task), "cid long, root long, n_links long")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def similar_documents(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose sets of five-word shingles have a Jaccard similarity of ``percent``.

    A row for each document: doc_id, n_shingles, cid (a number of its set; null without words),
    component_id (the smallest doc_id that links reach) and n_links (other sets that link with its
    own). A null, empty or wordless text has no shingles and is linked with nothing; a text of fewer
    than five words is one shingle. Repeated rows, also with one doc_id, are copies of one class. A
    null doc_id is kept and is smallest of a component only if all are null. An empty table gives no
    rows; other columns are ignored. Classes and shingles are told apart by 64-bit hashes.
    """
    spark, threshold = docs.sparkSession, Threshold(percent)
    docs = columns_of(docs, id_col, text_col)
    docs = docs.select(docs.doc_id.cast("long"), "text")
    facts = written(_facts(docs))
    seen_often = facts.where("kind = 1").groupBy(F.col("doc_id").alias("element")).agg(F.sum("n").alias("n"), F.min("cid").alias("cid"))
    order = Order.of(seen_often)
    sizes = facts.where("kind = 2").groupBy("doc_id").agg(F.count("*").alias("tasks"), F.sum("n").alias("n"), F.sum("cid").alias("shared")).collect()
    boundary = choose_boundary([(r.doc_id, r.n, r.shared / max(1, r.n * r.doc_id) * r.tasks) for r in sizes], threshold)
    rows = facts.where("kind = 0")
    elements = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(_partitions(spark), ceil(elements * (100 - percent) / 100 / BUCKET_KEYS))

    # The lists' own lengths tell which shingles are frequent; those then stand last, and the lists are made anew.
    scanned = written(_frequent_keys(_keys(docs, order, 0, buckets, threshold)))
    order = Order.of(scanned.unionByName(seen_often).groupBy("element").agg(F.max("n").alias("n"), F.min("cid").alias("cid")))
    groups = written(_memberships(_keys(docs, order, boundary, buckets, threshold), threshold))
    classes = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    sized = groups.join(classes.select("cid", "n"), "cid")
    weight = sized.groupBy("grp").agg(F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ELEMENTS), F.ceil(F.col("k") / BLOCK_MEMBERS)).cast("int").alias("blocks")
    weight = written(weight.select("grp", "n", blocks))
    load = weight.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0] or 0
    tasks = max(_partitions(spark), ceil(load / TASK_ELEMENTS))
    of = groups.join(weight.select("grp", "blocks"), "grp").groupBy("cid").agg(F.collect_list(F.struct("grp", "blocks")).alias("of"))
    texts = _class_texts(docs).join(of, "cid").dropDuplicates(["cid"])
    links = written(_verified(_members(texts, tasks), threshold))

    roots = connected(links, "cid", "root")
    rooted = classes.join(roots, classes.cid == roots.vertex, "left").select("cid", "doc_id", F.coalesce("root", "cid").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    counted = links.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    found = written(rooted.select("cid", "root").join(smallest, "root").join(counted, "cid", "left").select("cid", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    for table in (scanned, groups, weight, links):
        removed(table)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(found, "cid", "left")
    return out.select("doc_id", "n_shingles", "cid", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Documents without their near copies: of each component the document with the smallest doc_id stays.

    All columns of ``docs`` are kept. Documents without words stay. Rows with one doc_id and one text
    are one document; of a doc_id that stands for several texts, all texts stay where one does.
    """
    kept = similar_documents(docs, percent).where("doc_id <=> component_id").select(F.col("doc_id").alias("id__kept")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(F.col("id__kept")), "left_semi").dropDuplicates(["doc_id", "text"])
