"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight byte positions.  Two fingerprints at ``max_bits`` or
fewer differing bits agree in at least ``8 - max_bits`` of them (the guaranteed
minimum).  The bytes are indexed by position, two neighbouring positions to a
posting key; of the four such pairs at least ``4 - max_bits`` must agree, so the
index holds the combinations of that many pairs (for two bits: six lists of
four positional bytes).  Candidate pairs come from the postings; the positional
bytes they share are tallied, pairs below the guaranteed minimum go, and the
rest are verified by their Hamming distance.

A posting with more than ``posting_limit`` distinct fingerprints would hold a
quadratic number of pairs.  Its members are linked exactly in another way: each
emits itself and its 64 single-bit neighbours, and fingerprints that meet on a
value are at most two bits apart.  A value has at most 65 members, so that step
is linear, and no link is lost.

Exact copies collapse to one fingerprint before any pair is made, so a group of
copies of any size costs one row.  Components are found by alternating large
and small stars with a checkpoint after every round; nothing but a row count and
a checksum reaches the driver.

Defined results: null or empty text, or text of white space only, has the
fingerprint zero and is linked like any other; fewer words than a shingle give
one shingle of all words; repeated rows are rows of one component; a null
``doc_id`` keeps its row and gets the component of its text (null if no member
has an id); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import batches, columns, cut, texts

POSTING_LIMIT = 64
SALT = 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles, repeats included."""
    words = text.lower().split()  # bytes.split() parts at 0x20 and 0x09-0x0D exactly
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    width = min(shingle, len(words)) - 1
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[s : e - 1], seed) for s, e in zip(starts[:n], ends[width:], strict=True)), dtype=np.uint64, count=n
    ).astype(">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 16384):
        part = hashes[at : at + 16384]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``fp``, the fingerprint as a signed long."""
    rows = columns(docs, doc_id=id_col, text=text_col).withColumn("text_hash", F.xxhash64("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            fp = np.array([fingerprint(t, shingle) for t in texts(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255))


def _posting_key(fp: Column, pairs: tuple[int, ...]) -> Column:
    """The bytes at the positions of these pairs, in one long."""
    key = F.lit(0).cast("long")
    for p in pairs:
        for position in (2 * p, 2 * p + 1):
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, position))
    return key


def near_links(nodes: DataFrame, max_bits: int = 2, posting_limit: int = POSTING_LIMIT) -> DataFrame:
    """Links (a < b) between distinct fingerprints ``fp`` that keep every component
    of the graph "at most ``max_bits`` bits apart"; every link is such a pair."""
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    combos = list(combinations(range(4), 4 - max_bits))
    postings = nodes.select("fp", F.posexplode(F.array(*(_posting_key(F.col("fp"), c) for c in combos))).alias("k", "key"))
    sizes = postings.groupBy("k", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = cut(postings.join(sizes, ["k", "key"]))
    small = shared.where(F.col("members") <= posting_limit)
    a, b = small.select("k", "key", F.col("fp").alias("a")), small.select("k", "key", F.col("fp").alias("b"))
    same_bytes = reduce(lambda x, y: x + y, (F.when(_byte(F.col("a"), p) == _byte(F.col("b"), p), 1).otherwise(0) for p in range(8)))
    pairs = (
        a.join(b, ["k", "key"])
        .where(F.col("a") < F.col("b"))
        .where(same_bytes >= 8 - max_bits)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
        .distinct()
    )
    crowded = shared.where(F.col("members") > posting_limit).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))]
    meet = crowded.select("fp", F.explode(F.transform(F.array(*flips), lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    met = meet.groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    if max_bits < 2:  # a link is where one end is the meeting value; its smallest neighbour may be two bits off
        ends = met.where(F.array_contains("fps", F.col("key"))).select("key", F.explode("fps").alias("fp")).where("fp <> key")
        stars = ends.select(F.greatest("key", "fp").alias("b"), F.least("key", "fp").alias("a")).distinct()
    else:
        stars = met.select(F.explode("fps").alias("b"), F.array_min("fps").alias("a")).where("a < b")
    return pairs.unionByName(stars.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over undirected edges ``a``, ``b``.  Minima are pre-aggregated
    and joined back on (node, salt), so a hub's edges spread over tasks."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    out = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALT)).cast("int")).join(least, ["a", "salt"])
    if large:
        links = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        links = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return links.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node reachable, for every node with a link."""
    edges, seen = cut(links.select("a", "b").distinct()), None
    while True:
        edges = cut(_star(_star(edges, large=True), large=False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        seen = now


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, posting_limit: int = POSTING_LIMIT
) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id`` for every row: the smallest
    fingerprint and the smallest id reachable."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(near_links(nodes.select("fp"), max_bits, posting_limit))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(firsts, "root").select("fp", "root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    salted = fps.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
    return salted.join(classes, ["fp", "salt"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, posting_limit: int = POSTING_LIMIT
) -> DataFrame:
    """The input's rows of which each stands for one component: the one with its
    smallest id (where that id has several texts in the component, one of them)."""
    found = near_duplicates(docs, id_col, text_col, shingle, max_bits, posting_limit)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    firsts = own.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select(F.col("r.doc_id").alias("__id"), F.col("r.text_hash").alias("__hash"))
    hashed = docs.withColumn("__own", F.xxhash64(text_col))
    kept = hashed.join(firsts, hashed[id_col].eqNullSafe(firsts["__id"]) & (hashed["__own"] == firsts["__hash"]))
    return kept.dropDuplicates(["__id", "__hash"]).select(*docs.columns)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
