"""Self-join of texts by the Jaccard similarity of their word n-grams, with PartEnum signatures.

Sets of similar size share a band. In a band the n-gram domain is cut into more parts
than two similar sets can differ in elements, so they agree on some of the parts: each
part of a set that is not empty gives one signature, a hash of the part's number and of
the set's elements in it. Two sets of similarity t or more with at most k differing
elements share all but k of their signatures. Therefore

- a signature of one set alone cannot help, and a set with more than k of them has no
  partner at all: both leave after one shuffle;
- of the rest a set needs only its rarest signatures, k less those that were its own
  plus one, to meet every partner.

PartEnum itself enumerates subsets of parts, so that one shared signature makes a pair.
Here no subset is enumerated: each signature is one part, and the count of shared
signatures takes that place. The results are the same, as comparisons are exact.

Equal sets are one node from the start. In each group of nodes that share a signature the
most common node is compared with the others. Sets that this leaves unconnected and that
share enough elements with others of their group are compared in blocks, without a row for
a pair. Comparisons are exact, on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spinledger.llm.common import materialize
from spinledger.llm.components import components

#: Largest size of a band over its smallest.
BAND = 2
#: Most rows of an id list that every executor gets whole; beyond, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000
#: Sets on either side of a block of comparisons.
BLOCK = 256
_WORDS: dict[bytes, int] = {}
_REMEMBERED = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct ``n``-word shingles; one for a shorter text, none without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(_WORDS) > _REMEMBERED:
        _WORDS.clear()
    known = _WORDS
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word)
    hashes = np.array([known[word] for word in words], dtype=np.uint64)
    width, factor = min(n, len(words)), np.uint64(0x9E3779B97F4A7C15)
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * factor + hashes[k : len(words) - width + 1 + k]
    return np.unique(_mix(total))


class Bands:
    """Size bands for similarity ``percent`` / 100, and what sets may differ in them."""

    def __init__(self, percent: int):
        if not 0 < percent <= 100:
            raise ValueError("the similarity lies between 0 and 1")
        self._percent = percent
        self.largest = cache(self.largest)

    def partner(self, size: int) -> int:
        """Size of the largest set that can be similar to one of ``size``."""
        return 100 * size // self._percent

    def largest(self, band: int) -> int:
        if band == 0:
            return 1
        first = self.largest(band - 1) + 1
        return max(first * BAND - 1, self.partner(first - 1))  # so that partners lie at most one band away

    def of(self, size: int) -> int:
        band = 0
        while self.largest(band) < size:
            band += 1
        return band

    def differing(self, a: int, b: int) -> int:
        """Most elements that are in only one of two similar sets of these sizes."""
        return (a + b) * (100 - self._percent) // (100 + self._percent)

    def parts(self, band: int) -> int:
        """Parts of the domain: enough that sets seldom fill no more of them than they may differ in."""
        most = self.largest(band)
        share = (100 - self._percent) / (100 + self._percent)
        return int(np.ceil(2 * share * most * 1.16 + 0.5 * np.sqrt(most))) + 3


def signatures(elements: np.ndarray, bands: Bands) -> Iterator[tuple[int, int, np.ndarray]]:
    """For the set's own band and, where partners can lie there, the next: (0 or 1, needed, signatures).

    Two similar sets share at least ``needed`` of them, for either's number, in the band
    of the larger.
    """
    size = len(elements)
    own = bands.of(size)
    for step in (0, 1):
        band = own + step
        if step and bands.partner(size) <= bands.largest(own):
            return
        parts = np.uint64(bands.parts(band))
        part = (elements >> np.uint64(32)) * parts >> np.uint64(32)  # ascending, as the elements are
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        content = np.add.reduceat(_mix(elements + np.uint64(band)), first)
        found = _mix(content ^ _mix(part[first] + (np.uint64(band) << np.uint64(40))))
        needed = len(found) - bands.differing(size, min(bands.partner(size), bands.largest(band)))
        if needed < 1:  # so few parts are filled that two similar sets may share none: these sets meet in a signature of their own
            found, needed = np.append(found, _mix(np.array([band], dtype=np.uint64))), 1
        yield step, needed, found


def _fingerprint(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    digest = xxhash.xxh3_128_digest(elements.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, node, check) of each document; node and check identify its set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                elements = shingle_set(text, n)
                rows.append((len(elements), *_fingerprint(elements)))
            yield pd.DataFrame(rows, columns=["n_shingles", "node", "check"]).assign(doc_id=batch["doc_id"].to_numpy())

    return _narrow(docs).mapInPandas(run, "doc_id bigint, n_shingles bigint, node bigint, check bigint").select(
        "doc_id", "n_shingles", "node", "check"
    )


def signature_table(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(signature, node, needed): a task gives those of equal sets once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            found, nodes, needs, rows = [], [], [], 0
            for text in batch["text"]:
                elements = shingle_set(text, n)
                node = _fingerprint(elements)[0]
                if not len(elements) or node in seen:
                    continue
                seen.add(node)
                for step, needed, own in signatures(elements, bands):
                    found.append(own)
                    nodes.append(np.full(len(own), node))
                    needs.append(np.full(len(own), 2 * needed + step, dtype=np.int32))
                    rows += len(own)
                if rows > 500_000:
                    yield _signature_frame(found, nodes, needs)
                    found, nodes, needs, rows = [], [], [], 0
            if rows:
                yield _signature_frame(found, nodes, needs)

    return _narrow(docs).mapInPandas(run, "signature bigint, node bigint, needed int")


def _signature_frame(found: list, nodes: list, needs: list) -> pd.DataFrame:
    columns = {"signature": np.concatenate(found).view(np.int64), "node": np.concatenate(nodes), "needed": np.concatenate(needs)}
    return pd.DataFrame(columns)


def candidate_groups(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(grp, node): groups of at least two nodes, so that all similar nodes share one. ``needed`` holds 2 * needed + band step."""
    by_signature = Window.partitionBy("signature")
    met = (
        signature_table(docs, n, percent)
        .withColumn("often", F.count(F.lit(1)).over(by_signature))
        .withColumn("least", F.min("node").over(by_signature))
        .withColumn("most", F.max("node").over(by_signature))
        .filter("least <> most")
        .dropDuplicates(["signature", "node", "needed", "often"])
        .select("signature", "node", "needed", "often")
    )
    by_node = Window.partitionBy("node", "needed")
    rarest = (
        met.withColumn("shared", F.count(F.lit(1)).over(by_node))
        .withColumn("place", F.row_number().over(by_node.orderBy("often", "signature")))
        .filter("shared >= needed div 2 and place <= shared - needed div 2 + 1")
    )
    members = (
        rarest.withColumn("members", F.count(F.lit(1)).over(by_signature))
        .withColumn("grp", F.sum(F.xxhash64("node").cast("decimal(20,0)")).over(by_signature))
        .filter("members > 1")
    )
    return members.select(F.xxhash64("grp", "members").alias("grp"), "node").distinct()  # signatures of equal groups are one


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, elements) of the nodes ``wanted`` (doc_id, node), from the texts of these documents."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(text, n) for text in batch["text"]]
            same = [_fingerprint(x)[0] == node for x, node in zip(sets, batch["node"], strict=True)]
            frame = pd.DataFrame({"node": batch["node"], "elements": [x.tobytes() for x in sets]})
            yield frame[same]  # an id may have other texts as well

    return _narrow(docs).join(wanted, "doc_id").mapInPandas(run, "node bigint, elements binary")


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar, compared whole."""
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))
    shorter = F.least(F.length("left"), F.length("right")) * 100 >= percent * F.greatest(F.length("left"), F.length("right"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["left"], batch["right"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(right, "b").join(left, "a").filter(shorter).select("a", "b", "left", "right").mapInPandas(run, "a bigint, b bigint")


def jaccard_components(docs: DataFrame, n: int = 5, similarity: float = 0.75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document.

    Words are separated by ASCII white space, ASCII letters lower-cased. Documents link
    when the Jaccard similarity of their shingle sets is ``similarity`` (whole percent) or
    more; the component is the smallest id reachable. Null and empty texts have no set and
    no links. Rows with a null id take no part and get a null component; repeated rows and
    texts under one id each count, and the id stands for all of them. Other columns are
    not read.
    """
    percent = round(100 * similarity)
    spark = docs.sparkSession
    documents = materialize(set_table(docs, n), "sets")
    known = documents.filter("doc_id is not null and n_shingles > 0")
    nodes = materialize(known.groupBy("node", "check", "n_shingles").agg(F.min("doc_id").alias("rep")), "nodes")
    groups = materialize(candidate_groups(docs.filter("doc_id is not null"), n, percent), "groups")
    links = None
    if not groups.isEmpty():
        wanted = nodes.join(groups.select("node").distinct(), "node").select(F.col("rep").alias("doc_id"), "node")
        sets = materialize(_sets_of(docs, wanted, n).dropDuplicates(["node"]), "elements")
        often = groups.groupBy("node").agg(F.count(F.lit(1)).alias("n"))  # an original shares more with its copies than they with each other
        first = groups.join(often, "node").groupBy("grp").agg(F.max(F.struct("n", "node"))["node"].alias("a"))
        stars = groups.join(first, "grp").filter("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        stars = materialize(stars.distinct(), "stars")
        links = materialize(similar_pairs(stars, sets, percent), "links")
        open_sets = materialize(_open_sets(groups, links, sets, percent), "open_sets")
        if not open_sets.isEmpty():
            links = links.union(cross_links(open_sets, sets, percent))
    part = components(links) if links is not None else spark.createDataFrame([], "node bigint, component bigint")
    placed = nodes.join(part, "node", "left").withColumn("part", F.coalesce("component", "node"))
    first_of = placed.groupBy("part").agg(F.min("rep").alias("by_set"))
    same = placed.join(first_of, "part").select("node", "check", "n_shingles", "by_set")
    # ids with several texts join what their texts belong to
    joined = known.select("doc_id", "node", "check", "n_shingles").distinct().join(same, ["node", "check", "n_shingles"])
    if not joined.groupBy("doc_id").count().filter("count > 1").isEmpty():
        by_id = components(joined.select(F.col("doc_id").alias("a"), F.col("by_set").alias("b")))
        final = by_id.select(F.col("node").alias("doc_id"), F.col("component"))
    else:
        final = joined.select("doc_id", F.col("by_set").alias("component"))
    return documents.join(final, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _split_groups(placed: DataFrame) -> DataFrame:
    """The rows of groups whose nodes lie in several parts."""
    split = placed.groupBy("grp").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x <> y")
    return placed.join(split.select("grp"), "grp")


def _open_sets(groups: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(grp, node, part) of sets that may have links beyond their part.

    A set shares with no other set here what only it has here. With the rest of its
    elements it must reach the overlap that a partner as small as the group's smallest
    asks for; sets that cannot leave the group.
    """
    label = components(links)
    placed = groups.join(label, "node", "left").select("grp", "node", F.coalesce("component", "node").alias("part"))
    placed = materialize(_split_groups(placed), "split_groups")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                found = [np.frombuffer(x, np.int64) for x in batch["elements"][k : k + 200]]
                nodes = np.repeat(batch["node"][k : k + 200].to_numpy(), [len(x) for x in found])
                yield pd.DataFrame({"node": nodes, "element": np.concatenate(found)})

    own = sets.join(placed.select("node").distinct(), "node").select("node", "elements")
    single = own.mapInPandas(listed, "node bigint, element bigint").groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
    alone = single.filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    size = F.length("elements") / 8
    sized = own.join(alone, "node", "left").select("node", size.alias("size"), (size - F.coalesce("alone", F.lit(0))).alias("common"))
    placed = placed.join(sized, "node")
    least = placed.groupBy("grp").agg(F.min("size").alias("least"))
    able = placed.join(least, "grp").filter(f"common * {100 + percent} >= {percent} * (size + least)").drop("least")
    return _split_groups(able).select("grp", "node", "part")


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``x`` with each of ``y``."""
    common = np.intersect1d(np.concatenate(x), np.concatenate(y))
    total = np.zeros((len(x), len(y)))
    for k in range(0, len(common), 4096):
        part = common[k : k + 4096]
        total += np.stack([np.isin(part, s, assume_unique=True) for s in x]).astype(np.float32) @ np.stack(
            [np.isin(part, s, assume_unique=True) for s in y]
        ).T.astype(np.float32)
    return total


def _fresh(cells: DataFrame) -> DataFrame:
    """The columns under new identities, so that two sides of one table can be told apart."""
    return cells.select(*[F.col(c).alias(c) for c in ("cluster", "i", "j", "node", "part", "elements")])


def cross_links(open_sets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between parts: all sets outside a cluster's largest part against all of the cluster, in blocks.

    A cluster is what groups with a node in common make up. No pair becomes a row unless
    it links two parts, and then once for a node and a part.
    """
    first = open_sets.groupBy("grp").agg(F.min("node").alias("b"))
    of = components(open_sets.join(first, "grp").select(F.col("node").alias("a"), "b")).select("node", F.col("component").alias("cluster"))
    rows = materialize(open_sets.select("node", "part").distinct().join(of, "node").join(sets, "node"), "clusters")
    sizes = rows.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    plan = sizes.groupBy("cluster").agg(
        F.max(F.struct("n", "part"))["part"].alias("main"), blocks(F.sum("n")).alias("all_blocks"), blocks(F.sum("n") - F.max("n")).alias("some_blocks")
    )
    dealt = rows.join(plan.filter("some_blocks > 0"), "cluster")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = ["cluster", "i", "j"]
    some = _fresh(dealt.filter("part <> main").withColumns({"i": block("some_blocks"), "j": every("all_blocks")}))
    whole = _fresh(dealt.withColumns({"i": every("some_blocks"), "j": block("all_blocks")}))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        x, y = ([np.frombuffer(e, np.uint64) for e in side["elements"]] for side in (left, right))
        both = _overlaps(x, y)
        together = np.array([len(e) for e in x])[:, None] + np.array([len(e) for e in y])
        linked = (100 * both >= percent * (together - both)) & (left["part"].to_numpy()[:, None] != right["part"].to_numpy())
        i, j = np.nonzero(linked)
        found = pd.DataFrame({"a": left["node"].to_numpy()[i], "part": right["part"].to_numpy()[j], "b": right["node"].to_numpy()[j]})
        return found.drop_duplicates(["a", "part"])[["a", "b"]]

    return some.groupBy(*cell).cogroup(whole.groupBy(*cell)).applyInPandas(compare, "a bigint, b bigint")


#: The same over a view ``documents`` with unique ids.
ORACLE = """
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS s
  FROM word
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), numbered AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingle
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT c.a, c.b FROM common c JOIN size x ON x.doc_id = c.a JOIN size y ON y.doc_id = c.b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON reach.reached = edge.a
)
SELECT d.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(reach.reached) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN size USING (doc_id) GROUP BY d.doc_id
"""


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
