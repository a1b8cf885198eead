"""Set-similarity join on word shingles by token-combination prefixes, and the groups it links.

Documents link when ``100 * |x & y| >= percent * |x | y|`` for their sets of distinct 5-word shingles.

1. Documents with equal sets form a *class*; the join works on classes, so exact copies never meet in pairs.
2. Document frequencies. Documents are dealt to blocks; a block sends each range of its shingle names as one
   compressed value (about 3 bytes a shingle), one task per range adds them up and answers every block. So each
   shingle's frequency is known where its document is, nothing of it is broadcast, and a frequent shingle is one entry
   per block. (Copies in one block count once, in different blocks again; that moves a shingle in the order, no more.)
3. Prefixes. Shingles are ordered by frequency, then name. For sizes a <= b a link needs an overlap of
   o = ceil(percent (a + b) / (100 + percent)), which is at least ceil(2 percent a / (100 + percent)) for the smaller
   set and ceil(percent b / 100) for the larger; the first shared shingle stands in the first n - o + 1 of each.
   *Rare* shingles there are indexed one by one; one of frequency 1 has no partner and is left out.
   If the first shared shingle is *frequent*, then so are all: the prefixes, extended by m, share m + 1 frequent ones.
   Frequent shingles are dealt to m parts by a hash, so two shared ones fall into one part, and the pairs
   within each part are the keys. m is a power of two that grows with the set (its size / 32), which
   keeps the number of pairs in proportion to the set; the larger set uses the m of all sizes that it can meet.
4. Stars. Each key's class with the shortest part before the key (so the least of its own) is compared with the others
   of the key: candidates are fewer than index rows. Links are verified on whole texts and classes they connect form
   groups. Then all pairs of a key that are still in different groups are candidates: classes outside the key's largest
   group against all. Size and place in the prefix bound the overlap of each pair and drop most of them.
5. Groups are the connected components of all verified links. Two fixed steps, whatever the data, so the plan has a
   fixed size; a pair inside one group is compared only if it is in a star.

The operator returns groups, which is what links are wanted for here; it makes no list of all links.

Defined cases: null, empty or blank text has no shingles, links with nothing and is its own group; with under
five words the whole sequence is the one shingle; repeated rows are copies; ids decide nothing but names of groups, so
they may be null or repeated (a class or group without any id has null there); an empty table gives an empty one; a long
text is one row of a block and its keys leave in batches; ties go to the smaller class name; extra columns are ignored.
Classes go by a 64-bit name of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import answer, ask, batch, block_texts, components, cut, cut_few, document_blocks, mix, shingle_set, utf8

K_WORDS = 5
#: Bytes of text in a block, bytes of a name when frequencies are counted, and of a frequency (clipped).
BLOCK_BYTES = 1 << 20
_NAME, _COUNT = 5, 2
_SHIFT = np.uint64(64 - 8 * _NAME)


def class_name(shingles: np.ndarray) -> int:
    """One 64-bit name for a set of shingles; 0 for the empty set."""
    if not len(shingles):
        return 0
    return int((mix(shingles + np.uint64(len(shingles))).sum(dtype=np.uint64) | np.uint64(1)).view(np.int64))


def _block_sets(sizes: list[int], packed: bytes) -> tuple[list[np.ndarray], list[int], list[int]]:
    """(sets, their names, the texts that are the first of their class and have two shingles or more)."""
    sets = [shingle_set(x, K_WORDS) for x in block_texts(sizes, packed)]
    names = [class_name(s) for s in sets]
    first = {c: i for i, c in reversed(list(enumerate(names))) if len(sets[i]) > 1}
    return sets, names, sorted(first.values())


# --- document frequencies ----------------------------------------------------------------------------


def _ask(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, sizes, packed in zip(*(b.column(c).to_pylist() for c in ("block", "sizes", "packed")), strict=True):
                sets, _, first = _block_sets(sizes, packed)
                if first:
                    names, counts = np.unique(np.concatenate([sets[i] for i in first]) >> _SHIFT, return_counts=True)
                    buckets, blobs = ask(names, counts, _NAME, bits)
                    yield batch({"bucket": (buckets, pa.int64()), "block": ([block] * len(blobs), pa.int64()), "blob": (blobs, pa.binary())})

    return run


def _answer(bits: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blobs = answer([x.as_py() for x in table.column("blob")], bucket, _NAME, bits, _COUNT)
        return pa.table({"block": table.column("block"), "bucket": pa.array([bucket] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


# --- prefixes ----------------------------------------------------------------------------------------


def parts_of(n: int) -> int:
    """The number of parts that frequent shingles of a set of n are dealt to."""
    return 1 << max(0, (n // 32).bit_length() - 1)


def combinations(tokens: np.ndarray, places: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first place, second place) of all pairs of tokens in one of m parts; tokens stand in global order."""
    part = (mix(tokens) % np.uint64(m)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    tokens, places, part = tokens[order], places[order], part[order]
    left, right, step = [], [], 1
    live = np.arange(len(part))
    while len(live := live[live + step < len(part)]) and len(live := live[part[live] == part[live + step]]):
        left.append(live)
        right.append(live + step)
        step += 1
    if not left:
        return tokens[:0], places[:0], places[:0]
    i, j = np.concatenate(left), np.concatenate(right)
    return mix(tokens[i] * np.uint64(3) + tokens[j] * np.uint64(5) + np.uint64(m)), places[i], places[j]


def prefix_keys(shingles: np.ndarray, count: np.ndarray, percent: int, common: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place, may be the smaller set's, lead) of one set with its frequencies.

    Shared shingles before ``place`` are at most ``lead``: none before a rare key, for it stands for the first shared
    one; before a pair of frequent ones only frequent ones of other parts.
    """
    n = len(shingles)
    small = n - -(-2 * percent * n // (100 + percent)) + 1
    large = n - -(-percent * n // 100) + 1
    order = np.argsort(count, kind="stable")  # names ascend already
    alone = int((count <= 1).sum())
    if alone >= large:
        return
    tokens, count = shingles[order], count[order]
    rare = np.arange(alone, int(np.searchsorted(count[:large], common, "right")))
    yield tokens[rare], rare, rare < small, np.zeros(len(rare), np.int64)
    own, all_rare = parts_of(n), int(np.searchsorted(count, common, "right"))
    for m in sorted({own, parts_of(n - large + 1)}):
        frequent = np.flatnonzero(count[: large + m] > common)
        key, first, second = combinations(tokens[frequent], frequent, m)
        yield key, first, (second < small + m) & (m == own), (first - all_rare) * (m > 1)


def _postings(percent: int, common: int):
    def keys(out: list[tuple]) -> pa.RecordBatch:
        key, cls, n, place, small, lead = (np.concatenate(x) for x in zip(*out, strict=True))
        return batch({"kind": (np.ones(len(key), np.int8), pa.int8()), "key": (key.view(np.int64), pa.int64()), "cls": (cls, pa.int64()), "n": (n, pa.int64()), "place": (place, pa.int64()), "small": (small, pa.bool_()), "lead": (lead, pa.int64()), "doc_id": ([None] * len(key), pa.int64()), "block": ([None] * len(key), pa.int64()), "text_hash": ([None] * len(key), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids, sizes, packed, answers in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "sizes", "packed", "answers")), strict=True):
                sets, names, first = _block_sets(sizes, packed)
                size = len(ids)
                hashes = np.array([xxhash.xxh64_intdigest(x, 42) for x in block_texts(sizes, packed)], np.uint64).view(np.int64)  # as Spark's xxhash64
                yield batch({"kind": (np.zeros(size, np.int8), pa.int8()), "key": ([None] * size, pa.int64()), "cls": (names, pa.int64()), "n": ([len(s) for s in sets], pa.int64()), "place": (np.arange(size), pa.int64()), "small": ([None] * size, pa.bool_()), "lead": ([None] * size, pa.int64()), "doc_id": (ids, pa.int64()), "block": ([block] * size, pa.int64()), "text_hash": (hashes, pa.int64())})
                if not first:
                    continue
                known = np.unique(np.concatenate([sets[i] for i in first]) >> _SHIFT)
                total = np.concatenate([np.frombuffer(_unpack(x["blob"]), np.uint8).reshape(_COUNT, -1).T.copy().view("<u2").ravel() for x in sorted(answers, key=lambda x: x["bucket"])])
                out, held = [], 0
                for i in first:
                    count = total[np.searchsorted(known, sets[i] >> _SHIFT)]
                    for key, place, small, lead in prefix_keys(sets[i], count, percent, common):
                        out.append((key, np.full(len(key), names[i], np.int64), np.full(len(key), len(count), np.int64), place, small, lead))
                        held += len(key)
                        if held > 200_000:
                            yield keys(out)
                            out, held = [], 0
                if out:
                    yield keys(out)

    return run


def _unpack(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


# --- candidates and verification ---------------------------------------------------------------------


def _fits(x: str, y: str, percent: int) -> str:
    """Whether classes x and y of one key can link by it; either may be the smaller."""
    before = f"({x}.n < {y}.n or ({x}.n = {y}.n and {x}.cls < {y}.cls))"
    return f"""
        {x}.cls <> {y}.cls and 100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)
        and case when {before} then {x}.small else {y}.small end
        and (least({x}.lead, {y}.lead) + least({x}.n - {x}.place, {y}.n - {y}.place)) * {100 + percent} >= {percent} * ({x}.n + {y}.n)
    """


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            ids_a, ids_b, good = b.column("a").to_pylist(), b.column("b").to_pylist(), []
            for a, x, y in zip(ids_a, utf8(b.column("text_a")), utf8(b.column("text_b")), strict=True):
                if a != last:
                    last, held = a, shingle_set(x, K_WORDS)
                other = shingle_set(y, K_WORDS)
                both = len(np.intersect1d(held, other, assume_unique=True))
                good.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch({"a": (ids_a, pa.int64()), "b": (ids_b, pa.int64()), "good": (good, pa.bool_())})

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for sizes, packed, wanted in zip(*(b.column(c).to_pylist() for c in ("sizes", "packed", "wanted")), strict=True):
            texts = block_texts(sizes, packed)
            yield batch({"cls": ([w["cls"] for w in wanted], pa.int64()), "text": ([texts[w["place"]] for w in wanted], pa.binary())})


def verify(pairs: DataFrame, docs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) among candidate pairs of classes; only texts of classes in a pair leave their blocks."""
    pairs = cut_few(pairs)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    rows = docs.where("n > 1").select("cls", "block", "place").join(wanted, "cls", "left_semi")
    rows = rows.groupBy("cls").agg(F.min(F.struct("block", "place")).alias("at")).select("cls", "at.*")
    rows = cut_few(rows.groupBy("block").agg(F.collect_list(F.struct("cls", "place")).alias("wanted")))
    texts = cut_few(blocks.select("block", "sizes", "packed").join(rows, "block").mapInArrow(_texts, "cls long, text binary"))
    with_b = pairs.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b")), "b")
    with_both = with_b.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return cut_few(with_both.mapInArrow(_verified(percent), "a long, b long, good boolean").where("good").select("a", "b"))


def _pair(x: str, y: str) -> list:
    return [F.least(f"{x}.cls", f"{y}.cls").alias("a"), F.greatest(f"{x}.cls", f"{y}.cls").alias("b")]


# --- the operator ------------------------------------------------------------------------------------


def _groups(docs: DataFrame, percent: int = 80, common: int = 100) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cls, block, place, text_hash) of each row, and (cls, component) of each class that links."""
    if not 67 <= percent <= 100:
        raise ValueError("prefixes hold two shared shingles only from 67 percent on")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = document_blocks(docs, BLOCK_BYTES)
    volume = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(4, (volume >> 22).bit_length())  # under a million shingles in a range
    answers = blocks.mapInArrow(_ask(bits), "bucket long, block long, blob binary").groupBy("bucket").applyInArrow(_answer(bits), "block long, bucket long, blob binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
    schema = "kind byte, key long, cls long, n long, place long, small boolean, lead long, doc_id long, block long, text_hash long"
    made = cut(blocks.join(answers, "block", "left").mapInArrow(_postings(percent, common), schema))
    rows = made.where("kind = 0").select("doc_id", "n", "cls", "block", "place", "text_hash")

    index = made.where("kind = 1").groupBy("key", "cls").agg(*(F.first(c).alias(c) for c in ("n", "place", "small", "lead")))
    centers = index.groupBy("key").agg(F.count("*").alias("c"), F.min_by(F.struct("cls", "n", "place", "small", "lead"), F.struct(F.col("place") / F.col("n"), "cls")).alias("center")).where("c > 1")
    index = cut_few(index.join(centers.select("key", "center"), "key"))

    stars = index.select("*", F.col("center").alias("z")).alias("y").where(_fits("z", "y", percent)).select(*_pair("z", "y")).distinct()
    links = verify(stars, rows, blocks, percent)
    groups = cut_few(components(links))
    index = index.drop("center").join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("grp", F.coalesce("component", "cls")).drop("component")
    sizes = index.groupBy("key", "grp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("grp", F.struct("c", "grp")).alias("main"), F.count("*").alias("groups"))
    open_ = cut_few(index.join(sizes.where("groups > 1").select("key", "main"), "key"))
    some = open_.where("grp <> main").alias("x").join(open_.alias("y"), F.expr(f"x.key = y.key and x.grp <> y.grp and (y.grp = y.main or x.cls < y.cls) and {_fits('x', 'y', percent)}"))
    more = verify(some.select(*_pair("x", "y")).distinct(), rows, blocks, percent)
    held = groups.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    return rows, components(held.union(more))


def linked_groups(docs: DataFrame, **limits) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id is the smallest doc_id with an equal set.

    Both are null where all rows of a class, or of a group, have no doc_id.
    """
    rows, groups = _groups(docs, **limits)
    names = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("class_id"))
    names = cut_few(names.join(groups.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    lowest = names.groupBy("component").agg(F.min("class_id").alias("component_id"))
    names = names.join(lowest, "component").select("cls", "class_id", "component_id")
    out = rows.join(names, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def survivors(docs: DataFrame, **limits) -> DataFrame:
    """One row of each group of linked classes, and of each (doc_id, text) without shingles, with all columns.

    It is the row with the smallest doc_id, null ids last; ids decide nothing else, so they may be null or repeated. Rows
    are found again by doc_id and a 64-bit hash of the text; of rows that have both in common one stays.
    """
    rows, groups = _groups(docs, **limits)
    some = rows.where("n > 0").join(groups.withColumnRenamed("id", "cls"), "cls", "left").groupBy(F.coalesce("component", "cls").alias("component"))
    some = some.agg(F.min(F.struct(F.isnull("doc_id").alias("without_id"), F.coalesce("doc_id", F.lit(0)).alias("own_id"), "text_hash")).alias("r")).select("r.*")
    bare = rows.where("n = 0").select(F.isnull("doc_id").alias("without_id"), F.coalesce("doc_id", F.lit(0)).alias("own_id"), "text_hash")
    kept = cut_few(some.union(bare).distinct())
    # names that the rows' own columns do not have
    free = {c: c + "_" * next(n for n in range(1, 99) if c + "_" * n not in docs.columns) for c in ("without_id", "own_id", "text_hash")}
    keys, own = list(free.values()), F.col("doc_id").cast("long")
    named = docs.withColumns({free["without_id"]: F.isnull(own), free["own_id"]: F.coalesce(own, F.lit(0)), free["text_hash"]: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return named.join(kept.withColumnsRenamed(free), keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
