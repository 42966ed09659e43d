"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its 5-word shingles. Tokens (shingles) are ordered rare first. Of a set of n tokens a partner
may lack n - ceil(threshold * n) =: t at most, so a prefix in which signatures survive any t losses must share one with
any partner's prefix. Rare tokens are signatures by themselves. Frequent ones (FREQUENT sets or more) are indexed by
pairs: they fall into groups by hash, c of them in a group give their pairs, and a pair survives until c - 1 are lost.
The prefix extends until t + 1 = rare tokens + sum of (c - 1) over groups. How many groups there are depends on the
size band, so that a group holds a few tokens of a prefix; a set is indexed for its own band and for the band of the
largest partner. All pairs that share a signature are compared exactly.

Sets that are equal are one class throughout. A token that only one class has can't be shared, so only the others
return to their classes: they are all that prefixes and exact overlaps need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import distinct, input_bytes, local_roots, mix64, set_keys, shingled, stored, table, tidy, word_hashes
from weftline.llm.components import connected_components
from weftline.llm.streams import consecutive, several

#: The threshold in hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A token in so many classes or more is frequent: indexed in pairs.
FREQUENT = 64
#: Input bytes for each bucket of tokens, and tokens of a bucket that are sorted at once.
BUCKET_BYTES = 16 << 20
SORTED = 1 << 20
#: Texts taken from a batch at once.
SLICE = 512
#: Classes compared as one tile, and tokens taken in one product of matrices.
TILE = 1024
COLUMNS = 2048
#: Rows of groups compared at once, and members of a group up to which pairs are counted token by token.
COMPARED = 4096
PAIRS = 64
#: Ids (8 bytes each) that are broadcast, at most.
BROADCAST_ROWS = 1_000_000

_CLASS = np.uint64(61)
_LOW = np.uint64((1 << 48) - 1)


def _pack(x: np.ndarray) -> bytes:
    """The low 48 bits of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


_BLOB = ["part", "kind", "keys", "counts", "tokens"]
_BLOB_KINDS = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_BLOB_DDL = "part int, kind int, keys binary, counts binary, tokens binary"
#: Kinds of blob: tokens of classes; documents; documents without an id or a shingle; classes.
TOKENS, DOCUMENTS, ALONE, CLASSES = range(4)


def token_blobs(documents: DataFrame, buckets: int) -> DataFrame:
    """documents (doc_id, text) -> blobs. A token goes to the bucket of its anchor, so that neighbours of a text travel together and a class's key is sent to fewer buckets. A class that a task has met before adds no tokens again, so a group of copies sends its tokens once from each task."""

    def dealt(kind: int, by: np.ndarray, *columns: np.ndarray) -> list[tuple]:
        """A row for each bucket that has some of the columns' values."""
        to = _dealt(by, buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to[order])) + 1, [len(to)]]) if len(to) else [0]
        return [(int(to[order[a]]), kind, *[c[order[a:b]].tobytes() for c in columns]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                _, own, tokens, anchor = shingled(*word_hashes(batch.column(1)))
                first = distinct(own, tokens)
                own, tokens, anchor = own[first], tokens[first], anchor[first]
                sizes, keys = set_keys(own, tokens, batch.num_rows)
                sizes = sizes.astype(np.uint32)
                given = np.asarray(batch.column(0).is_valid())
                ids = np.asarray(batch.column(0).fill_null(0), np.int64)
                linked = given & (sizes > 0)
                rows = dealt(ALONE, ids[~linked], ids[~linked], sizes[~linked], given[~linked])
                rows += dealt(DOCUMENTS, ids[linked], keys[linked], sizes[linked], ids[linked])
                rows += dealt(CLASSES, keys[linked], keys[linked], sizes[linked], ids[linked])
                new = np.zeros(batch.num_rows, bool)
                new[[i for i in np.flatnonzero(linked) if not ((k := int(keys[i])) in met or met.add(k))]] = True
                some = new[own]
                if some.any():
                    own, tokens = own[some], tokens[some]
                    bucket = _dealt(anchor[some], buckets)
                    order = np.argsort(bucket, kind="stable")  # and by class within it
                    own, tokens, bucket = own[order], tokens[order], bucket[order]
                    cut = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1])])
                    heads = np.flatnonzero(cut)
                    counts = np.diff(np.concatenate([heads, [len(own)]])).astype(np.uint32)
                    groups = np.concatenate([[0], np.flatnonzero(np.diff(bucket[heads])) + 1, [len(heads)]])
                    ends = np.concatenate([heads, [len(own)]])
                    for a, b in zip(groups[:-1], groups[1:], strict=True):
                        rows.append((int(bucket[heads[a]]), TOKENS, keys[own[heads[a:b]]].tobytes(), counts[a:b].tobytes(), _pack(tokens[ends[a] : ends[b]])))
                yield _rows(rows, _BLOB, _BLOB_KINDS)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _BLOB_DDL)


def _shared(keys: np.ndarray, tokens: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (key, token) pairs, those whose token two keys or more have, tokens with their frequency's order in the top bits. Taken in shares of about SORTED tokens by the token's value."""
    out = []
    shares = -(-len(tokens) // SORTED)
    share = (tokens % np.uint64(max(1, shares))).astype(np.uint16) if shares > 1 else None
    for i in range(shares):
        own = slice(None) if share is None else share == i
        t, k = tokens[own], keys[own]
        order = np.argsort(t, kind="stable")
        t, k = t[order], k[order]
        new = np.concatenate([[True], t[1:] != t[:-1]])
        several = ~(new & np.concatenate([new[1:], [True]]))  # a run of one is out at once
        t, k = t[several], k[several]
        if not len(t):
            continue
        order = np.lexsort((k, t))  # the same class may come from several tasks
        t, k = t[order], k[order]
        once = np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        t, k = t[once], k[once]
        _, run_of, many = np.unique(t, return_inverse=True, return_counts=True)
        many = many[run_of]
        several = many > 1
        t, k, many = t[several], k[several], many[several]
        level = np.where(many >= FREQUENT, 7, np.minimum(6, np.log2(np.maximum(many, 2)).astype(np.int64))).astype(np.uint64)
        out.append((k, level << _CLASS | np.uint64(part & 0x1FFF) << np.uint64(48) | t))
    if not out:
        return keys[:0], tokens[:0]
    return np.concatenate([k for k, _ in out]), np.concatenate([t for _, t in out])


def shared_tokens(blobs: DataFrame, parts: int) -> DataFrame:
    """Of each bucket, the tokens that two classes or more have, sent to the parts of their classes. A token carries the order of its frequency in its top bits: the class is rare first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in consecutive(batches, 2):
            part, kind = bucket.column(0)[0].as_py(), bucket.column(1)[0].as_py()
            if kind in (DOCUMENTS, ALONE):
                yield from bucket.to_batches()
                continue
            keys = np.concatenate([np.frombuffer(x, np.int64) for x in bucket.column(2).to_pylist()])
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in bucket.column(3).to_pylist()])
            if kind == CLASSES:
                ids = np.concatenate([np.frombuffer(x, np.int64) for x in bucket.column(4).to_pylist()])
                order = np.lexsort((ids, keys))
                first = np.concatenate([[True], np.diff(keys[order]) != 0])
                keys, counts, tokens = keys[order][first], counts[order][first], ids[order][first]
            else:
                tokens = _unpack(b"".join(x.as_py() for x in bucket.column(4)))
                del bucket
                keys, tokens = _shared(np.repeat(keys, counts), tokens, part)
                counts = np.zeros(0, np.uint32)
            to = _dealt(keys, parts)
            order = np.lexsort((tokens, keys, to))
            to, keys, tokens = to[order], keys[order], tokens[order]
            counts = counts[order] if kind == CLASSES else counts
            cuts = np.flatnonzero(np.diff(to)) + 1 if len(to) else np.zeros(0, int)
            rows = []
            for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True):
                if b > a:
                    rows.append((int(to[a]), kind, keys[a:b].tobytes(), counts[a:b].tobytes() if kind == CLASSES else b"", tokens[a:b].tobytes()))
            yield _rows(rows, _BLOB, _BLOB_KINDS)

    return blobs.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), _BLOB_DDL)


_SETS = ["kind", "id", "key", "n", "tokens"]
_SETS_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def gathered(blobs: DataFrame, parts: int) -> DataFrame:
    """(kind, id, key, n, tokens): a row for each document, and for each class its smallest doc_id, size and shared tokens, in order."""

    def out(kind: int, ids: np.ndarray, keys: np.ndarray, n: np.ndarray, valid: np.ndarray | None = None, tokens: list | None = None) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, mask=None if valid is None else ~valid), pa.array(keys), pa.array(n.astype(np.int32)), pa.array(tokens or [None] * len(ids), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, _SETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, tokens = None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for part in consecutive(batches, 2):
            number, kind = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            if kind in (DOCUMENTS, ALONE):
                for k, n, t in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    n = np.frombuffer(n, np.uint32)
                    if kind == DOCUMENTS:
                        yield out(kind, np.frombuffer(t, np.int64), np.frombuffer(k, np.int64), n)
                    else:
                        yield out(kind, np.frombuffer(k, np.int64), np.zeros(len(n), np.int64), n, np.frombuffer(t, bool))
            elif kind == TOKENS:
                at, keys = number, np.concatenate([np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()])
                tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in part.column(4).to_pylist()])
                order = np.lexsort((tokens, keys))
                keys, tokens = keys[order], tokens[order]
            else:
                if at != number:
                    keys, tokens = np.zeros(0, np.int64), np.zeros(0, np.uint64)
                own, n, ids = (np.concatenate([np.frombuffer(x, t) for x in part.column(i).to_pylist()]) for i, t in ((2, np.int64), (3, np.uint32), (4, np.int64)))
                order = np.lexsort((ids, own))
                own, n, ids = own[order], n[order], ids[order]
                first = np.concatenate([[True], own[1:] != own[:-1]])
                own, n, ids = own[first], n[first], ids[first]
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                for s in range(0, len(own), SLICE):
                    e = s + SLICE
                    yield out(kind, ids[s:e], own[s:e], n[s:e], None, [tokens[a:b].tobytes() for a, b in zip(low[s:e], high[s:e], strict=True)])

    return blobs.repartitionById(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(tidy(run), "kind int, id long, key long, n int, tokens binary")


def missing(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def bands(n: int, percent: int = PERCENT) -> set[int]:
    """The size bands (powers of two) of a set and of its largest partner."""
    return {n.bit_length(), (100 * n // percent).bit_length()}


def signatures(n: int, tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of a set with n tokens, of which `tokens` (in order) are shared by other classes: tokens, and hashes of pairs in a band."""
    need = missing(n, percent) + 1 - (n - len(tokens))
    if need <= 0 or n < 3:
        return tokens[:0]
    rare = tokens[: np.searchsorted(tokens, np.uint64(7) << _CLASS)]
    if len(rare) >= need:
        return rare[:need]
    often, need, out = tokens[len(rare) :], need - len(rare), [rare]
    for band in bands(n, percent):
        groups = max(1, 1 << max(0, band - 5))
        group = (mix64(often) % np.uint64(groups)).astype(np.int64)
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        by = np.argsort(group[:end], kind="stable")
        t, g = often[:end][by], group[:end][by]
        for k in range(1, end):
            same = g[k:] == g[:-k]
            if not same.any():
                break
            with np.errstate(over="ignore"):
                a, b = np.minimum(t[k:][same], t[:-k][same]), np.maximum(t[k:][same], t[:-k][same])
                out.append(mix64(mix64(a) + b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band)))
    return np.concatenate(out)


def linked(sizes: np.ndarray, tokens: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of sets whose Jaccard reaches the threshold, by products of incidence matrices, COLUMNS tokens at a time."""
    _, column, many = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    kept = many[column] > 1
    row, column = row[kept], (np.cumsum(many > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(tokens), len(tokens)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(tokens), COLUMNS), np.float32)
        part[row[low:high], column[low:high] - at] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    i, j = np.nonzero(100 * common >= percent * (sizes[:, None] + sizes[None] - common))
    return i[i < j], j[i < j]


def near_pairs(group: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of one group whose Jaccard reaches the threshold, over many groups at once.

    sizes: of the members' whole sets; tokens: (member, token) rows in the order of members, no pair twice. Only tokens that
    another member of the group has can be common, and a member with too few of them has no partner: such members go, and
    with them what only they shared, until none goes. Of what is left, tokens of few members give all their pairs, to be
    counted; larger groups are compared by products of matrices.
    """
    owner, token = tokens
    owner = owner.astype(np.int64)
    need = -(-percent * sizes.astype(np.int64) // 100)
    order = np.lexsort((token, group[owner]))
    owner, token = owner[order], token[order]
    while True:
        g = group[owner]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (g[1:] != g[:-1])])[: len(owner)]
        several = ~(new & np.concatenate([new[1:], [True]])[: len(owner)])
        held = several & (np.bincount(owner[several], minlength=len(sizes)) >= need)[owner]
        if held.all():
            break
        owner, token = owner[held], token[held]
    if not len(owner):
        return owner, owner
    members = np.unique(owner)
    many = np.bincount(group[members])
    wide = many[group[owner]] > PAIRS
    left, right = [], []
    for number in np.unique(group[owner[wide]]):
        own = wide & (group[owner] == number) if len(np.flatnonzero(many > PAIRS)) > 1 else wide
        of, by = owner[own], np.argsort(owner[own], kind="stable")
        some, counts = np.unique(of, return_counts=True)
        i, j = linked(sizes[some].astype(np.int64), np.split(token[own][by], np.cumsum(counts)[:-1]), percent)
        left.append(some[i])
        right.append(some[j])
    owner, token = owner[~wide], token[~wide]
    if len(owner):
        g = group[owner]
        run = np.cumsum(np.concatenate([[False], (token[1:] != token[:-1]) | (g[1:] != g[:-1])]))
        pairs = []
        for k in range(1, len(owner)):
            same = run[k:] == run[:-k]
            if not same.any():
                break
            a, b = owner[:-k][same], owner[k:][same]
            pairs.append(np.minimum(a, b) * len(sizes) + np.maximum(a, b))
        pair, common = np.unique(np.concatenate(pairs), return_counts=True)
        a, b = pair // len(sizes), pair % len(sizes)
        near = 100 * common >= percent * (sizes[a].astype(np.int64) + sizes[b] - common)
        left.append(a[near])
        right.append(b[near])
    return np.concatenate([*left, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.zeros(0, np.int64)]).astype(np.int64)


def class_sets(documents: DataFrame) -> DataFrame:
    """The stored rows of gathered()."""
    parts = max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(documents) // BUCKET_BYTES))
    return stored(gathered(shared_tokens(token_blobs(documents, parts), parts), parts), "shingle-sets")


def posted_by(classes: DataFrame, signatures_of: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """classes (key, n, tokens) -> (sig, key) for each of a class's signatures."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.unique(signatures_of(n, np.frombuffer(t, np.uint64))) for n, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            keys = np.repeat(np.asarray(batch.column(0)), [len(x) for x in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(keys)], ["sig", "key"])

    return classes.where(F.length("tokens") > 0).select("key", "n", "tokens").mapInArrow(index, "sig long, key long")


def linked_classes(posted: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Components (id, component) of classes under the links among all that share a posting list.

    Lists with the same least member, their head, are one group, since near copies share many lists: each class goes there
    once with its tokens, and a group is compared as a whole, so a pair counts once however many lists it shares. What
    comes out is a spanning forest of the links found, no more rows than members. A group of more than TILE members is
    cut in tiles by a hash, and each pair of tiles is a group of its own.
    """
    posted = stored(posted, "postings")
    heads = posted.groupBy("sig").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1").select("sig", "head")
    members = stored(posted.join(heads, "sig").select("head", "key").distinct(), "heads")
    tiles = members.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    own = members.join(tiles, "head").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    own = own.select("head", "key", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    rows = own.select("head", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "key").join(classes.select("key", "n", "tokens"), "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups, number in several(batches, 3, COMPARED):
            keys, blobs = np.asarray(groups.column(3)), groups.column(5).to_pylist()
            tokens = np.frombuffer(b"".join(blobs), np.uint64)
            owner = np.repeat(np.arange(len(keys)), [len(b) // 8 for b in blobs])
            del blobs
            left, right = near_pairs(number, np.asarray(groups.column(4), np.int64), (owner, tokens), percent)
            root = local_roots(len(keys), left, right)
            moved = np.flatnonzero(root != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays([pa.array(keys[moved]), pa.array(keys[root[moved]])], ["a", "b"])

    dealt = rows.select("head", "i", "j", "key", "n", "tokens").repartition("head", "i", "j").sortWithinPartitions("head", "i", "j", "key")
    links = dealt.mapInArrow(tidy(compare), "a long, b long")
    return stored(connected_components(links), "components")


def assigned(sets: DataFrame, component: DataFrame) -> DataFrame:
    """(id, key, n, component_id) of each document that has a class: component_id is the smallest id in the component of its class."""
    named = sets.where(F.col("kind") == CLASSES).select("key", "id").join(component.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_key = named.join(smallest, "component").select("key", "component_id")
    return sets.where(F.col("kind") == DOCUMENTS).select("id", "key", "n").join(of_key, "key")


def jaccard_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_shingles, component_id; two documents link when 100 * intersection >= percent * union.

    component_id is the smallest doc_id reachable by links, itself included. Null and blank texts have no shingles and
    link with nothing, fewer than five words are one shingle, equal sets always link. A null doc_id links with nothing and
    has a null component_id; rows that repeat a doc_id are rows of their own. An empty table gives no rows. Texts may be of
    any length. Shingles are compared by 48 bits of hash and their bucket's number, whole sets by 64 bits: two different
    sets are taken for equal with a probability of the number of pairs of sets / 2^64.
    """
    sets = class_sets(documents)
    classes = sets.where(F.col("kind") == CLASSES).select("key", "n", "tokens")
    posted = posted_by(classes, lambda n, tokens: signatures(n, tokens, percent))
    docs = assigned(sets, linked_classes(posted, classes, percent))
    alone = sets.where(F.col("kind") == ALONE)
    out = docs.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
    return out.union(alone.select("id", F.col("n").cast("long"), "id"))


def one_of_each(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents without those that a smaller doc_id of their component stands for, and without rows that repeat a doc_id and its component; null doc_ids stay. The ids to drop are broadcast up to BROADCAST_ROWS, else joined."""
    found = stored(jaccard_components(documents, percent), "jaccard")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    out = documents.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti")
    again = found.where("component_id = doc_id and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.head(1):
        rest = out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(again, "doc_id", "left_anti").unionByName(rest)
    return out.select(documents.columns)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))



OP5_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles, md5(array_to_string(list_sort(sh), chr(10))) as same from s),
c as (select same, min(doc_id) as rep, any_value(n_shingles) as n from n where n_shingles > 0 group by same),
t as (select doc_id, md5_number_lower(unnest(sh)) as tok from s where doc_id in (select rep from c)),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from t a join t b on a.tok = b.tok and a.doc_id <> b.doc_id group by all),
e as (select a, b from p join c x on x.rep = a join c y on y.rep = b where 100 * common >= 75 * (x.n + y.n - common)),
r as (select rep, rep as seen from c union select r.rep, e.b from r join e on e.a = r.seen),
m as (select rep, min(seen) as component_id from r group by rep)
select n.doc_id, n.n_shingles, coalesce(m.component_id, n.doc_id) as component_id
from n left join c on n.same = c.same and n.n_shingles > 0 left join m on m.rep = c.rep
"""
