"""SimHash fingerprints, links by multi-index hashing and their components.

A fingerprint's 64 bits are cut into two segments of 32. Two fingerprints within distance 2 differ by at most one bit in
the first segment, or not at all in the second: so the first table is probed with the Hamming ball of radius 1 (33
values), the second with the value itself, and every match is verified on the whole distance. Equal fingerprints are
one vertex from the start, so copies never form pairs, and links are one per pair of different fingerprints.

Edge cases: a null or empty text has no word and the fingerprint zero, which links like any other. Rows that repeat are
one vertex. A null id belongs to its fingerprint's component and never names one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, marked, shuffled

SEED = 42
PLAIN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Texts of a block, two of which a task compares at a time, and their characters; a block of long texts holds fewer.
BLOCK, BLOCK_CHARS = 128, 2_000_000
#: Shingles that are counted at a time where blocks meet.
SHARED = 4096
BITS = (((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1)).astype(np.int64)


def fingerprint(text: str | None, width: int) -> int:
    """The signed 64-bit fingerprint of a text's word shingles."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).astype(np.int64))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[: len(words) - width]].tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ BITS for i in range(8)])
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the fingerprint `fp` (long) of every row."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py(), width) for t in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_type}, fp long")


def links(points: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints (column fp, distinct) within distance 2."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    table = points.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), high.alias("v")), F.struct(F.lit(1).alias("seg"), low.alias("v")))).alias("t")).select(F.col("fp").alias("b"), "t.seg", "t.v")
    ball = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.struct(F.lit(0).alias("seg"), F.when(i == 32, high).otherwise(high.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).alias("v")))
    probes = points.select("fp", F.explode(F.concat(ball, F.array(F.struct(F.lit(1).alias("seg"), low.alias("v"))))).alias("t")).select(F.col("fp").alias("a"), "t.seg", "t.v")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return probes.join(shuffled(table), ["seg", "v"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def components(points: DataFrame, edges: DataFrame, vertex: str, most_rounds: int = 60) -> DataFrame:
    """Each vertex with its component's root and smallest label: alternating hooks of neighbours and pointer jumps, all as joins.

    points: (vertex, label), edges: (a, b). The labels of linked vertices only take part; each round is written to the
    shared folder, so a lost executor costs one round at most.
    """
    both = keep(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    touched = both.select(F.col("a").alias(vertex)).distinct()
    # work on vertex names: the label is resolved once at the end
    state = keep(touched.select(F.col(vertex).alias("v"), F.col(vertex).alias("c")), "state")
    for _ in range(most_rounds):
        reached = both.join(state.withColumnsRenamed({"v": "b", "c": "cb"}), "b").groupBy(F.col("a").alias("v")).agg(F.min("cb").alias("m"))
        hooked = state.join(reached, "v", "left").select("v", "c", F.least("c", "m").alias("m"))
        # every old root takes the smallest root that any of its members saw
        roots = hooked.groupBy("c").agg(F.min("m").alias("r"))
        after = keep(hooked.join(roots, "c").select("v", F.col("c").alias("old"), F.least("m", "r").alias("c")), "state")
        jump = after.join(after.select(F.col("v").alias("c"), F.col("c").alias("cc")), "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c"))
        after = keep(jump, "state")
        moved = after.filter(F.col("old") != F.col("c")).limit(1).count()
        state = after.select("v", "c")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    named = points.join(state.withColumnRenamed("v", vertex), vertex, "left").select(vertex, "label", F.coalesce("c", F.col(vertex)).alias("c"))
    return named.join(named.groupBy("c").agg(F.min("label").alias("component_id")), "c").select(vertex, F.col("c").alias("root"), "component_id")


def fingerprint_groups(prints: DataFrame, label: str) -> DataFrame:
    """fp, root and component_id of each fingerprint of prints: the smallest `label` reachable by links of at most two bits."""
    points = keep(prints.groupBy("fp").agg(F.min(label).alias("label")), "points")
    return components(points, links(points.select("fp")), "fp")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links of at most two bits) of every row."""
    prints = keep(fingerprints(docs, width), "fingerprints")
    groups = fingerprint_groups(prints, "doc_id")
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def plain_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and bytes beyond ASCII, A-Z lower-cased: neither case nor punctuation tells copies apart."""
    return PLAIN.findall(text.encode("utf-8", "replace").lower()) if text else []


def segments(text: str | None, width: int, slices: int, least: int) -> tuple[list[int], int]:
    """One segment for each slice of a text's shingles: a digest of the `least` smallest hashes of the slice. And how many shingles.

    Shingles fall into slices by their hash, so two texts that share most shingles agree on whole slices; a segment is
    then equal, not just close. Empty slices give a segment that is the digest of all words.
    """
    words = plain_words(text)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    whole = digest(joined, SEED) if words else 0
    hashes, slice_of = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(words) > width:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.r_[0, ends[: len(words) - width]].tolist()
        hashes = np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64))
        slice_of = hashes % np.uint64(slices)
    out = []
    for i in range(slices):
        own = hashes[slice_of == i][:least]
        out.append(digest(own.tobytes(), SEED) if len(own) else whole)
    return np.array(out, np.uint64).astype(np.int64).tolist(), max(1, len(hashes))


def shingles(text: str | None, width: int) -> set[bytes]:
    """The set of word shingles of a text."""
    words = plain_words(text)
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def common_shingles(shapes: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets of shingle digests share: products of incidence matrices, SHARED columns at a time.

    A shingle of one set only is left out, so the work follows what the sets have in common.
    """
    n = len(shapes)
    owner = np.repeat(np.arange(n), [len(s) for s in shapes])
    _, column, times = np.unique(np.concatenate(shapes), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((n, n), np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, SHARED):
        low, high = np.searchsorted(column, [start, start + SHARED])
        holds = np.zeros((n, SHARED), np.float32)
        holds[owner[low:high], column[low:high] - start] = 1
        both += (holds @ holds.T).astype(np.int64)
    return both


def like_in_blocks(low: int, high: int, slot: int, members: list[tuple], width: int, similarity: float) -> list[tuple[str, str]]:
    """Links (a, b) between members (h, component, block, segs, text) of blocks low and high that join their components.

    Pairs of one component, or of one block where low and high differ, are passed over, as are pairs whose first common
    slot is another one: they meet there.
    """
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while (up := root.get(c, c)) != c:
            root[c] = c = root.get(up, up)
        return c

    names, parts, block, segs, texts = zip(*members, strict=True)
    shapes = [np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles(t, width)], np.uint64) for t in texts]
    sizes = np.array([len(s) for s in shapes])
    both = common_shingles(shapes)
    part, block, segs = np.unique(parts, return_inverse=True)[1], np.array(block), np.array(segs)
    meets = (both >= similarity * (sizes[:, None] + sizes[None, :] - both)) & (part[:, None] != part[None, :])
    if low != high:
        meets &= block[:, None] != block[None, :]
    first, second = np.nonzero(np.tril(meets, -1))
    here = (segs[first] == segs[second]).argmax(axis=1) == slot
    out = []
    for i, j in zip(first[here].tolist(), second[here].tolist(), strict=True):
        a, b = find(parts[i]), find(parts[j])
        if a != b:
            out.append((names[i], names[j]))
            root[a] = b
    return out


def distinct_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, slices: int = 16, least: int = 4, print_width: int = 3) -> DataFrame:
    """One document of each group of near copies.

    Texts are linked by their fingerprints (of shingles of `print_width` words) at two bits or fewer, as in `near_duplicates`,
    and where their shingle sets have a Jaccard similarity of at least `similarity`; these shingles are of words without case
    and punctuation (`plain_words`).

    At such a similarity 64-bit SimHashes differ in about ten bits, beyond any small ball; so the fingerprint is made long for
    the second kind of link, one segment for each slice of the shingles, and the tables are probed with whole segments. Each text meets the first
    and the last text of each of its table entries; the first and the last of those that are like neither, and the member
    with the most links, meet all of the entry in a second round. What these heads leave in several components is
    compared in blocks of BLOCK texts, so no two texts that share a segment stay apart unverified. Every meeting is
    verified on the whole shingle sets, in blocks by 64-bit digests of the shingles; two texts whose fingerprints are linked
    already, or whose numbers of shingles rule the similarity out, need not meet. Of a group the smallest doc_id stays; texts
    without a word are one group. All columns of docs are returned.

    Segments and texts that meet no other are told apart by sieves (`marked`) and not shuffled: of the whole texts only
    those that share a segment are, and at the end those whose group has several rows.
    """
    text_id = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    # a row's id as text, so that joins and what follows them are dealt by one key, nulls too
    id_key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            segs, sizes = zip(*(segments(t, width, slices, least) for t in texts), strict=True) if texts else ((), ())
            prints = [fingerprint(t, print_width) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(segs, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64())], ["doc_id", "h", "segs", "size", "fp"])

    sketches = docs.select("doc_id", text_id.alias("h"), "text").mapInArrow(run, f"doc_id {doc_type}, h binary, segs array<long>, size long, fp long")
    points = keep(sketches.groupBy("h").agg(F.min("doc_id").alias("label"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("segs", "size", "fp"))), "points")
    # fingerprints first: texts of one of their components are linked to its smallest text id
    prints = keep(fingerprint_groups(points.select("fp", "h"), "h").select("fp", F.col("component_id").alias("near")), "prints")
    points = keep(points.join(prints, "fp").drop("fp"), "points")
    print_edges = points.filter(F.col("near") != F.col("h")).select(F.col("h").alias("a"), F.col("near").alias("b"))
    entries = points.select("h", "size", "near", F.posexplode("segs").alias("slot", "seg"))
    shared = keep(entries.groupBy("slot", "seg").agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "shared")
    entries = marked(entries, shared, "slot", "seg").filter("marked").drop("marked")
    whole_of = ("h", "size", "near")
    whole = F.struct(*whole_of)
    ends = entries.groupBy("slot", "seg").agg(F.min(whole).alias("low"), F.max(whole).alias("high")).filter("low.h <> high.h")
    # the members of entries with company; texts that share no segment with another are done with here
    members = keep(entries.join(ends, ["slot", "seg"]), "members")

    def against(heads: DataFrame, *which: str) -> DataFrame:
        """Pairs of each member of an entry with the entry's heads, but those that are linked already or cannot be alike."""
        each = heads.select("slot", "seg", F.explode(F.array(*which)).alias("to"))
        may = (F.col("near") != F.col("to.near")) & (F.least("size", "to.size") >= similarity * F.greatest("size", "to.size"))
        return members.select("slot", "seg", "h", "size", "near").join(each, ["slot", "seg"]).filter(may).select("h", F.col("to.h").alias("head")).distinct()

    ends = members.select("slot", "seg", "low", "high").dropDuplicates(["slot", "seg"])
    pairs = keep(against(shuffled(ends), "low", "high"), "pairs")
    # one row stands for its text: copies, of which a text may have any number, are dealt by their ids and left behind
    own = docs.select(text_id.alias("h"), id_key("doc_id").alias("id"), "text")
    involved = keep(members.select("h").distinct().join(points.select("h", id_key("label").alias("id")), "h"), "involved")
    own = marked(own, involved, "h", "id").filter("marked").drop("marked")
    texts = keep(own.join(shuffled(involved), ["h", "id"], "left_semi").groupBy("h", "id").agg(F.max("text").alias("text")).drop("id"), "texts")

    def alike(batches: Iterator[pa.RecordBatch]):
        last, shape = None, set()
        for batch in batches:
            kept = []
            for i, (head, a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if head != last:
                    last, shape = head, shingles(b.as_py(), width)
                own = shingles(a.as_py(), width)
                both = len(own & shape)
                if both >= similarity * (len(own) + len(shape) - both):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])

    def verified(met: DataFrame) -> DataFrame:
        both = met.join(texts.withColumnRenamed("text", "own"), "h").join(texts.withColumnsRenamed({"h": "head", "text": "of_head"}), "head")
        return keep(both.select("h", "head", "own", "of_head").mapInArrow(alike, "a binary, b binary"), "edges")

    first_edges = verified(pairs)
    # members that are like neither head of an entry give heads of a second round, with the member that has most links
    either = keep(first_edges.union(first_edges.select("b", "a")).distinct(), "either")
    low, high = (either.select(F.col("a").alias("h"), F.col("b").alias(n), F.lit(True).alias(f"like_{n}")) for n in ("first_h", "last_h"))
    unlike = members.filter((F.col("near") != F.col("low.near")) & (F.col("near") != F.col("high.near"))).select("*", F.col("low.h").alias("first_h"), F.col("high.h").alias("last_h"))
    unlike = unlike.join(shuffled(low), ["h", "first_h"], "left").join(shuffled(high), ["h", "last_h"], "left").filter("like_first_h is null and like_last_h is null")
    again = keep(unlike.groupBy("slot", "seg").agg(F.min(whole).alias("low"), F.max(whole).alias("high")), "again")
    linked = either.groupBy(F.col("a").alias("h")).agg(F.count("*").alias("links"))
    hubs = members.select("slot", "seg", "h", "size", "near").join(again.select("slot", "seg"), ["slot", "seg"], "left_semi").join(linked, "h").groupBy("slot", "seg").agg(F.max(F.struct("links", *whole_of)).alias("hub"))
    second = again.join(hubs, ["slot", "seg"], "left").select("slot", "seg", "low", "high", F.when(F.col("hub").isNull(), F.col("low")).otherwise(F.struct(*(F.col(f"hub.{c}").alias(c) for c in whole_of))).alias("hub"))
    edges = first_edges.union(print_edges).union(verified(against(second, "low", "high", "hub").join(pairs, ["h", "head"], "left_anti")))
    groups = keep(components(points.select("h", "label"), edges, "h"), "groups")

    # entries whose members are still in several components: all pairs across components but the largest one's own
    own = members.select("slot", "seg", "h").join(groups.select("h", F.col("root").alias("c")), "h").join(texts.select("h", F.length("text").alias("chars")), "h")
    parts = own.groupBy("slot", "seg", "c").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    main = F.max(F.struct("n", "c", "chars")).alias("main")
    sizes = parts.groupBy("slot", "seg").agg(main, F.sum("n").alias("n"), F.sum("chars").alias("chars")).filter("n > main.n")
    sizes = sizes.select("slot", "seg", "n", F.col("chars").alias("all_chars"), F.col("main.c").alias("main"), F.col("main.n").alias("n_main"), F.col("main.chars").alias("main_chars"))
    apart = own.join(sizes, ["slot", "seg"])
    blocks_of = lambda n, chars: F.ceil(F.greatest(n / BLOCK, chars / BLOCK_CHARS)).cast("int")
    mains, others = blocks_of(F.col("n_main"), F.col("main_chars")), blocks_of(F.col("n") - F.col("n_main"), F.col("all_chars") - F.col("main_chars"))
    is_main = F.col("c") == F.col("main")
    # blocks of the largest component are negative and meet the others only
    block = F.when(is_main, -1 - F.pmod(F.xxhash64("h"), mains)).otherwise(F.pmod(F.xxhash64("h"), others)).cast("int")
    meets = F.sequence(F.when(is_main, 0).otherwise(-mains), others - 1)
    dealt = apart.select("slot", "seg", "h", "c", block.alias("block"), F.explode(meets).alias("other"))
    dealt = dealt.select("slot", "seg", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "h", "c", "block")

    def compared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slot, _, low, high = (k.as_py() for k in key)
        got = like_in_blocks(low, high, slot, list(zip(*(table.column(c).to_pylist() for c in ("h", "c", "block", "segs", "text")), strict=True)), width, similarity)
        return pa.table({"a": pa.array([a for a, _ in got], pa.binary()), "b": pa.array([b for _, b in got], pa.binary())})

    filled = dealt.join(points.select("h", "segs"), "h").join(texts, "h")
    rest = keep(filled.groupBy("slot", "seg", "low", "high").applyInArrow(compared, "a binary, b binary"), "edges")
    if not rest.isEmpty():
        groups = components(points.select("h", "label"), edges.union(rest), "h")
    # of each component the text that holds its smallest id stays, a null only if there is no other; ties go to the smallest text id
    best = F.min(F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("label"), F.col("h").alias("h"))).alias("best")
    placed = keep(points.select("h", "label", "rows").join(groups.select("h", "root"), "h"), "placed")
    chosen = keep(placed.groupBy("root").agg(best, F.sum("rows").alias("rows")).select("root", "rows", "best.h", id_key("best.label").alias("id")), "chosen")
    crowded = placed.join(chosen.filter("rows > 1").select("root"), "root", "left_semi").select("h")
    names = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), text_id.alias("h"), id_key("doc_id").alias("id"))
    own = marked(own, keep(crowded, "crowded"), "h")
    # rows that are alone in their group stay where they are
    kept = own.filter("marked").join(chosen.select("h", "id"), ["h", "id"], "left_semi").dropDuplicates(["h", "id"])
    return own.filter("not marked").unionByName(kept).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
