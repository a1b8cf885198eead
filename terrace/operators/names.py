"""Name dictionaries and mentions in text.

Names meet texts inside the tasks, without a shuffle of texts: in an automaton, or, where there are more than ``SMALL`` of them,
as sorted words of eight bytes. Only beyond ``MANY`` they meet by an equi-join on their first characters; never as a cross product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import terms, text

SMALL = 50_000
#: Bytes of names that go to every task as an automaton.
BYTES = 8 << 20
#: Names, and bytes of them, that go to every task as words of eight bytes; and bytes of texts that are searched at a time.
MANY, MANY_BYTES, PIECE = 4_000_000, 64 << 20, 1 << 20


def broadcast_if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def alias_dictionary(records: DataFrame, extra: DataFrame | None = None, one: str = "阿司匹林", other: str = "阿斯匹林") -> DataFrame:
    """(name, canonical, source) of ``records(ord, drug, aliases)``: real names beat aliases, then the first owner, then ``extra``.

    An alias that is another record's own name is dropped. ``extra(name, canonical)`` fills only free names.
    """
    variants = lambda c: F.explode(text.spelling_variants(c, one, other))
    own = records.select("ord", F.lit(0).alias("p"), "drug", variants(F.col("drug")).alias("v"))
    alias = records.select("ord", F.lit(1).alias("p"), "drug", F.explode("aliases").alias("a")).select("ord", "p", "drug", variants(F.col("a")).alias("v"))
    rows = own.union(alias).select("ord", "p", F.lower("v").alias("name"), F.col("drug").alias("canonical"))
    # of records with one name the last stays; of aliases the first
    w = Window.partitionBy("name").orderBy("p", F.when(F.col("p") == 0, -F.col("ord")).otherwise(F.col("ord")))
    kept = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    out = kept.select("name", "canonical", F.when(F.col("p") == 0, "knowledge_base").otherwise("knowledge_base_alias").alias("source"))
    if extra is not None:
        free = extra.select(F.lower("name").alias("name"), "canonical", F.lit("interaction_ref").alias("source")).dropDuplicates(["name"])
        out = out.unionByName(free.join(out, "name", "left_anti"))
    return out


def resolution_names(records: DataFrame, overrides: DataFrame | None = None, forms: Sequence[str] = terms.DOSAGE_FORMS, salts: Sequence[str] = terms.SALT_PREFIXES) -> DataFrame:
    """(kind, name, targets, sources) of ``records(drug, aliases)`` and ``overrides(alias, targets, source)``.

    kind is exact_name, alias (given, override or salt-stripped) or derived_base_name.
    """
    known = records.where("trim(drug) <> ''").select(F.trim("drug").alias("drug"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    drug = F.col("drug")
    exact, base, salt = text.lookup_name(drug), text.base_name(drug, forms), text.without_salt(drug, salts)
    salt_base = text.base_name(salt, forms)
    entry = lambda kind, name, source, cond: F.when(cond & (name != ""), F.struct(F.lit(kind).alias("kind"), name.alias("name"), F.lit(source).alias("source")))
    alias = lambda a: text.lookup_name(a)
    derived = F.array(
        entry("exact_name", exact, "knowledge", F.lit(True)), entry("derived_base_name", base, "derived", base != exact),
        entry("alias", salt, "derived_salt_short_name", salt != exact), entry("derived_base_name", salt_base, "derived", (salt != exact) & (salt_base != salt)),
    )
    given = F.flatten(F.transform("aliases", lambda a: F.array(
        entry("alias", alias(a), "source_alias", F.lit(True)), entry("alias", text.without_salt(a, salts), "derived_salt_short_name", text.without_salt(a, salts) != alias(a)),
    )))
    rows = known.select("drug", F.explode(F.concat(derived, given)).alias("e")).where("e is not null").select("e.kind", "e.name", F.col("drug").alias("target"), "e.source")
    if overrides is not None:
        wanted = overrides.select(text.lookup_name(F.col("alias")).alias("name"), F.explode("targets").alias("target"), F.coalesce(F.nullif("source", F.lit("")), F.lit("manual_review")).alias("source"))
        valid = wanted.where("name <> ''").join(known.select(F.col("drug").alias("target")).distinct(), "target", "left_semi")
        rows = rows.unionByName(valid.select(F.lit("alias").alias("kind"), "name", "target", "source"))
    return rows.groupBy("kind", "name").agg(F.array_sort(F.collect_set("target")).alias("targets"), F.array_sort(F.collect_set("source")).alias("sources"))


def alias_conflicts(names: DataFrame) -> DataFrame:
    return names.where((F.col("kind") == "alias") & (F.size("targets") > 1)).select("name", "targets")


def rejected_overrides(overrides: DataFrame, records: DataFrame) -> DataFrame:
    """Overrides with an empty alias or no known target."""
    rows = overrides.withColumn("_id", F.monotonically_increasing_id())
    good = rows.select("_id", "alias", F.explode("targets").alias("drug")).join(records.select("drug").distinct(), "drug", "left_semi")
    good = good.where(text.lookup_name(F.col("alias")) != "").select("_id").distinct()
    return rows.join(good, "_id", "left_anti").drop("_id")


def _blocks(value: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(rf"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _held(names: DataFrame, *columns: str) -> pa.Table | None:
    """The distinct names with ``columns``, if they are at most ``MANY`` and ``MANY_BYTES``; else None."""
    names = names.select("name", *columns).where("name is not null and name <> ''").distinct()
    size = names.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("name")), F.lit(0)).alias("b")).first()
    return names.toArrow() if size.n <= MANY and size.b <= MANY_BYTES else None


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _by_automaton(known: list[bytes]) -> Callable[[bytes, np.ndarray], Found]:
    import ahocorasick

    # a character for each byte: positions are those of bytes
    machine, sizes = ahocorasick.Automaton(), [len(n) for n in known]
    for i, name in enumerate(known):
        machine.add_word(name.decode("latin-1"), i)
    machine.make_automaton()

    def search(raw: bytes, ends: np.ndarray) -> Found:
        row, which, start, a = [], [], [], 0
        for r, z in enumerate(ends.tolist()):
            for end, i in machine.iter(raw[a:z].decode("latin-1")) if z > a else ():
                row.append(r)
                which.append(i)
                start.append(a + end + 1 - sizes[i])
            a = z
        return np.array(row, np.int64), np.array(which, np.int64), np.array(start, np.int64)

    return search


def _by_heads(known: list[bytes]) -> Callable[[bytes, np.ndarray], Found]:
    # a name of up to eight bytes is one number; a longer one is looked up where its first eight bytes stand
    sizes = np.array([len(n) for n in known], np.int64)
    words, width = np.frombuffer(b"".join(n[:8].ljust(8, b"\0") for n in known), "<u8"), np.minimum(sizes, 8)
    longer: dict[int, dict[int, dict[bytes, int]]] = {}
    for i in np.flatnonzero(sizes > 8).tolist():
        longer.setdefault(int(words[i]), {}).setdefault(len(known[i]), {})[known[i]] = i
    tables = []
    for w in np.unique(width).tolist():
        whole = np.flatnonzero(sizes == w)
        heads = np.unique(words[width == w])
        ids = np.full(len(heads), -1)
        ids[np.searchsorted(heads, words[whole])] = whole
        # most windows of a text are in no place that a head has
        bits = min(24, max(12, int(8 * len(heads)).bit_length()))
        place = lambda x, bits=bits: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        taken = np.zeros(1 << bits, bool)
        taken[place(heads)] = True
        tables.append((w, np.uint64((1 << 8 * w) - 1), heads, ids, place, taken))

    def search(raw: bytes, ends: np.ndarray) -> Found:
        padded = np.frombuffer(raw + b"\0" * 8, np.uint8)
        which, start = [], []
        for a in range(0, len(raw), PIECE):
            window = np.ndarray(min(PIECE, len(raw) - a), "<u8", padded, a, (1,))
            for w, mask, heads, ids, place, taken in tables:
                head = window & mask
                at = np.flatnonzero(taken[place(head)])
                head = head[at]
                i = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
                hit = heads[i] == head
                at, i, head = at[hit] + a, i[hit], head[hit]
                whole = ids[i] >= 0
                which.append(ids[i[whole]])
                start.append(at[whole])
                if w == 8 and longer:
                    more = [(n, p) for p, h in zip(at.tolist(), head.tolist(), strict=True) for size, of in longer.get(h, {}).items() if (n := of.get(raw[p : p + size])) is not None]
                    which.append(np.array([n for n, _ in more], np.int64))
                    start.append(np.array([p for _, p in more], np.int64))
        which, start = np.concatenate(which), np.concatenate(start)
        row = np.searchsorted(ends, start, "right")
        inside = start + sizes[which] <= ends[row]  # not over the end of a text
        return row[inside], which[inside], start[inside]

    return search


def _searches(known: pa.Array) -> Callable[[pa.Array], Iterator[tuple[int, bytes, np.ndarray, Found]]]:
    """A function that gives, for some texts at a time, the first one's number, their bytes, their ends, and (row, name, start)
    of every name in them, overlapping ones included; rows count from that number, starts are places in the bytes."""
    known_ = [n.encode() for n in known.to_pylist()]
    search = (_by_automaton if len(known_) <= SMALL and sum(map(len, known_)) <= BYTES else _by_heads)(known_) if known_ else None

    def run(texts: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray, Found]]:
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        r = 0
        while search and r < len(texts):
            z = max(r + 1, int(np.searchsorted(offsets, offsets[r] + PIECE, "right")) - 1)
            if offsets[z] > offsets[r]:
                raw, ends = data.slice(int(offsets[r]), int(offsets[z] - offsets[r])).to_pybytes(), offsets[r + 1 : z + 1] - offsets[r]
                yield r, raw, ends, search(raw, ends)
            r = z

    return run


def _once(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of the least ``at`` of each key."""
    order = np.lexsort((at, key))
    return order[np.diff(key[order], prepend=-1) != 0]


def _occurring(known: pa.Array, key: str, value: str, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(known)
        for b in batches:
            for r, raw, ends, (row, which, start) in searches(b.column(value)):
                if first:
                    one = _once(row * len(known) + which, start)
                    row, which, start = row[one], which[one], start[one]
                # characters before a place, less those before its text
                before = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)])
                start = before[start] - before[np.concatenate([[0], ends])[row]]
                for i in range(0, len(row), 50_000):
                    j = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(row[j] + r)), known.take(pa.array(which[j])), pa.array(start[j], pa.int32())], [key, "name", "start"])

    return run


def hits(texts: DataFrame, names: DataFrame, key: str, value: str, first: bool = False, block: int = 2) -> DataFrame:
    """(key, name, start): every occurrence of a name in a text, overlapping ones included; with ``first`` one of each name.

    A dictionary of at most ``MANY`` names and ``MANY_BYTES`` goes to each task, which finds all names in one pass over a
    text; no text is shuffled. Pieces of texts meet a larger one by a join on the longest beginning of ``block``, twice or
    four times as many characters that a name has. Repeated rows keep their own hits.
    """
    names = names.where(F.length("name") >= block).select("name").distinct()
    held = _held(names)
    if held is not None:
        kind, known = texts.schema[key].dataType.simpleString(), held.column("name").combine_chunks().cast(pa.string())
        return texts.select(key, value).mapInArrow(_occurring(known, key, value, first), f"`{key}` {kind}, name string, start int") if len(known) else texts.select(key, F.lit("").alias("name"), F.lit(0).alias("start")).limit(0)
    long = F.length("name")
    head = F.when(long >= 4 * block, F.substring("name", 1, 4 * block)).when(long >= 2 * block, F.substring("name", 1, 2 * block)).otherwise(F.substring("name", 1, block))
    texts = texts.select(F.xxhash64(key, value).alias("_text_id"), key, value)
    pieces = F.explode(F.concat(*[_blocks(F.col(value), block << i) for i in range(3)])).alias("_b")
    met = texts.select("_text_id", pieces).distinct().join(names.withColumn("_b", head), "_b").drop("_b")
    rows = texts.join(met, "_text_id").where(F.instr(F.col(value), F.col("name")) > 0)
    if first:
        return rows.select(key, "name", (F.instr(F.col(value), F.col("name")) - 1).alias("start"))
    return rows.select(key, "name", F.explode(occurrences(F.col(value), F.col("name"))).alias("start"))


def mentions(texts: DataFrame, names: DataFrame, key: str, value: str, block: int = 2) -> DataFrame:
    """(key, *names columns): every name of ``block`` characters or more that a text contains, once a text."""
    found = hits(texts, names, key, value, True, block).select(key, "name")
    return found.join(broadcast_if_small(names), "name").select(key, *names.columns)


def canonicals(texts: DataFrame, names: DataFrame, key: str, value: str, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, block: int = 2) -> DataFrame:
    """(key, canonicals array): whom the names(name, canonical) in each text stand for.

    Names become canonicals where they are found, so as many rows leave a task as came, however many names the dictionary
    has; ``then`` is applied to each batch of them. Beyond ``MANY`` names a text has several rows, which together say the same.
    """
    kind = texts.schema[key].dataType.simpleString()
    names = names.where((F.length("name") >= block) & F.col("canonical").isNotNull())
    held = _held(names, "canonical")
    if held is None:
        found = mentions(texts, names.select("name", "canonical"), key, value, block).select(key, F.array("canonical").alias("canonicals"))
        return found.unionByName(texts.select(key, F.array().cast("array<string>").alias("canonicals")))
    order = held.sort_by("name").combine_chunks()
    known, owners = order.column("name").combine_chunks().dictionary_encode(), order.column("canonical").combine_chunks().dictionary_encode()
    # several canonicals of a name stand together
    name_of, owner = known.indices.to_numpy(), owners.indices.to_numpy().astype(np.int64)
    words, whose, ends = known.dictionary, owners.dictionary.cast(pa.string()), np.searchsorted(name_of, np.arange(len(known.dictionary) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(words)
        for b in batches:
            pairs = [np.zeros(0, np.int64)]
            for r, _, _, (row, which, _) in searches(b.column(value)):
                n = ends[which + 1] - ends[which]
                of = np.repeat(ends[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append(np.unique((np.repeat(row, n) + r) * len(whose) + owner[of]))
            row, who = np.divmod(np.concatenate(pairs), max(len(whose), 1))
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(at), whose.take(pa.array(who)))], [key, "canonicals"])
            yield then(out) if then else out

    return texts.select(key, value).mapInArrow(run, f"`{key}` {kind}, canonicals array<string>")


def occurrences(value: Column, name: Column) -> Column:
    """Start positions (from 0) of a name, overlapping ones included."""
    at = F.sequence(F.lit(1), F.greatest(F.length(value) - F.length(name) + 1, F.lit(1)))
    return F.transform(F.filter(at, lambda i: F.substring(value, i, F.length(name)) == name), lambda i: i - 1)


def resolve(questions: DataFrame, names: DataFrame, oral: Sequence[str] = terms.ORAL_WORDS, non_oral: Sequence[str] = terms.NON_ORAL_FORMS) -> DataFrame:
    """(q, resolved array, groups array): longest names first, then exact, alias, base, then position; no overlaps.

    A name with one target is resolved; one with several is a group of candidates. Base names in an oral context
    keep only oral forms, if any is left.
    """
    asked = questions.select("q", text.lookup_name(F.col("message")).alias("_t"))
    ranked = names.withColumn("priority", F.when(F.col("kind") == "exact_name", 3).when(F.col("kind") == "alias", 2).otherwise(1)).select("name", "targets", "kind", "priority")
    found = hits(asked, ranked, "q", "_t").join(broadcast_if_small(ranked), "name")
    item = F.struct((-F.length("name")).alias("len"), (-F.col("priority")).alias("p"), "start", (F.col("start") + F.length("name")).alias("end"), "name", "targets", "kind")
    rows = found.groupBy("q").agg(F.array_sort(F.collect_list(item)).alias("m")).join(asked.select("q", text.contains_any(F.col("_t"), oral).alias("_oral")), "q")
    none = F.slice(F.col("m"), 1, 0)
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    chosen = F.aggregate("m", none, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    rows = rows.select("q", "_oral", chosen.alias("c"))
    rows = rows.select("q", "_oral", F.explode(F.array_sort("c", lambda a, b: a["start"] - b["start"])).alias("x")).select("q", "_oral", "x.*")
    usable = F.filter("targets", lambda t: ~text.contains_any(t, non_oral))
    rows = rows.withColumn("targets", F.when(F.col("_oral") & (F.col("kind") == "derived_base_name") & (F.size(usable) > 0), usable).otherwise(F.col("targets")))
    one = F.collect_set(F.when(F.size("targets") == 1, F.get("targets", F.lit(0))))
    group = F.struct("start", F.col("name").alias("mention"), F.col("targets").alias("candidates"), F.col("kind").alias("source"))
    found = rows.groupBy("q").agg(F.array_sort(one).alias("resolved"), F.array_sort(F.collect_list(F.when(F.size("targets") > 1, group))).alias("g"))
    keep = F.filter("g", lambda x, i: ~F.exists(F.slice("g", 1, i), lambda y: (y["mention"] == x["mention"]) & (y["candidates"] == x["candidates"])))
    found = found.select("q", "resolved", F.transform(keep, lambda x: F.struct(x["mention"].alias("mention"), x["candidates"].alias("candidates"), x["source"].alias("source"))).alias("groups"))
    empty = "array<struct<mention string, candidates array<string>, source string>>"
    return questions.select("q").join(found, "q", "left").select("q", F.coalesce("resolved", F.array().cast("array<string>")).alias("resolved"), F.coalesce("groups", F.array().cast(empty)).alias("groups"))


def negated(questions: DataFrame, names: DataFrame, patterns: Sequence[tuple[str, int]] = terms.NEGATIONS) -> DataFrame:
    """(q, canonical): names that lie wholly in the few characters after a negation."""
    body = F.col("message")
    tails = []
    for pattern, size in patterns:
        # each match with the characters after it; a lookahead keeps matches from eating one another's tails
        found = F.regexp_extract_all(body, F.lit(rf"{pattern}(?=((?s:.{{0,{size}}})))"), F.lit(1))
        tails.append(found)
    rows = questions.select("q", F.explode(F.array_distinct(F.concat(*tails))).alias("_tail")).withColumn("_tail", F.lower("_tail"))
    return canonicals(rows, names, "q", "_tail").select("q", F.explode("canonicals").alias("canonical")).distinct()


def combined(questions: DataFrame, names: DataFrame, pattern: str = terms.COMBINATION) -> DataFrame:
    """(q, canonical): names of any length, one character too, that stand whole on a side of a listing mark."""
    sides = F.concat(*[F.regexp_extract_all("message", F.lit(pattern), F.lit(i)) for i in (1, 2)])
    rows = questions.select("q", F.explode(F.array_distinct(sides)).alias("_w")).select("q", F.lower("_w").alias("name"))
    return rows.join(broadcast_if_small(names.select("name", "canonical")), "name").select("q", "canonical").distinct()


def extract(questions: DataFrame, names: DataFrame, patterns: Sequence[tuple[str, int]] = terms.NEGATIONS) -> DataFrame:
    """(q, drugs): canonical names that a message mentions, or lists as one character, without negated ones, sorted."""
    asked = questions.select("q", F.lower("message").alias("_t"))
    found = canonicals(asked, names, "q", "_t").select("q", F.explode("canonicals").alias("canonical")).union(combined(questions, names.where(F.length("name") < 2))).distinct()
    found = found.join(negated(questions, names, patterns), ["q", "canonical"], "left_anti")
    return questions.select("q").join(found.groupBy("q").agg(F.array_sort(F.collect_set("canonical")).alias("drugs")), "q", "left").select("q", F.coalesce("drugs", F.array().cast("array<string>")).alias("drugs"))


def context(questions: DataFrame, populations=terms.POPULATION_WORDS, conditions=terms.CONDITION_WORDS, risks=terms.RISK_FACTOR_WORDS) -> DataFrame:
    """questions with population (ages and words), conditions and risk_factors arrays."""
    body = F.col("message")
    by_age = F.filter(F.transform(text.ages(body), text.age_group), lambda x: x.isNotNull())
    by_word = F.filter(F.array(*[F.when(body.contains(w), F.lit(label)) for w, label in populations]), lambda x: x.isNotNull())
    return questions.withColumns({"population": F.array_distinct(F.concat(by_age, by_word)), "conditions": text.longest_present(body, conditions), "risk_factors": text.present(body, risks)})


PAYLOAD = (
    "age int, sex string, population array<string>, conditions array<string>, symptoms array<string>, "
    "medications array<struct<mention string, normalized string, status string, confidence double>>, "
    "ambiguous_entities array<struct<mention string, entity_type string, normalized string, reason string, user_message string>>"
)


def payload_mentions(payloads: DataFrame, names: DataFrame) -> DataFrame:
    """(q, mention, drug, ambiguous) of the medications in ``payloads(q, payload)``: a mention, then its normal form, is
    looked up; unmatched ones are ambiguous; past ones are left out."""
    rows = payloads.select("q", F.explode(text.json_object(F.col("payload"), PAYLOAD)["medications"]).alias("m")).select("q", "m.*")
    rows = rows.where("coalesce(status, '') <> 'past'").withColumns({"_m": text.lookup_name(F.coalesce("mention", F.lit(""))), "_n": text.lookup_name(F.coalesce("normalized", F.lit("")))})
    known = names.select("name", "canonical")
    rows = rows.join(known.toDF("_m", "by_mention"), "_m", "left").join(known.toDF("_n", "by_form"), "_n", "left")
    drug = F.coalesce("by_mention", "by_form")
    return rows.select("q", "mention", drug.alias("drug"), drug.isNull().alias("ambiguous")).distinct()


def united(resolved: Column, dictionary: Column) -> Column:
    """Names of the resolver and of the dictionary, sorted, each once; null is none."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(resolved, none), F.coalesce(dictionary, none)))
