"""MinHash near-duplicates by an inverted join over signature coordinates.

Every document is posted under its (coordinate, value) pairs. Pairs that no other document has are
dropped; the rest are ordered from rare to frequent, and a document with r of them is posted only
under the first r - T + 1 (prefix), since a partner must share T of them. Long lists are never
expanded: a list is merged by skipping from its leader to its members, so it yields as many
candidates as it has members. The leader is the member whose values are the most frequent, which
in a group of copies is the one that most others were made from; further leaders come from what
the first have not reached, as long as they shrink it. Lists that then still span components are
compared in blocks of bounded size, outsiders of a list with its members, never the members of its
largest component with each other; short lists share a block. Every link is confirmed on the full
shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutroom.llm.words import Words, chunks, integer_id, mix, set_of
from cutroom.operators.components import connected_components
from cutroom.session import settle, ship

#: Coordinates that documents are posted under, and further ones of a byte each that candidates are counted on.
COORDINATES = 32
FINE = 96
#: Standard deviations that a linked pair's count of equal coordinates may fall short by.
SLACK = 4.3
#: Documents, and shingles, of a side of a block, about.
BLOCK = 4096
BLOCK_SHINGLES = 1_000_000
#: Rows of a block that are compared at once, and texts of a batch.
ROWS = 256
#: Bits of the filter that texts pass before they are shuffled; it sends 4 MB to each executor at any size.
FILTER_BITS = 1 << 25
_SEEDS = mix((np.arange(COORDINATES, dtype=np.uint64) + np.uint64(17)) * np.uint64(0x9E3779B97F4A7C15))
_ODD = mix(_SEEDS) | np.uint64(1)
_FINE_SEEDS = (mix((np.arange(FINE, dtype=np.uint64) + np.uint64(99)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_FINE_ODD = _FINE_SEEDS * np.uint32(0x9E3779B1) | np.uint32(1)


def least_matches(coordinates: int, similarity: float) -> int:
    """Equal coordinates that a pair of that similarity has, but for one in a hundred thousand."""
    return max(1, math.ceil(coordinates * similarity - SLACK * math.sqrt(coordinates * similarity * (1 - similarity))))


def _sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    for _, part in chunks(texts):
        words = Words(part, lower=True)
        rolled = words.shingles(k)
        for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            yield set_of(words.hash[a:b], k, rolled[a:b])


def _digest(items: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    if not len(items):
        return 0, 0
    return int(np.bitwise_xor.reduce(mix(items)).view(np.int64)), int(np.add.reduce(items).view(np.int64))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred rows, so that no more texts than those are Python's at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _signature(items: np.ndarray) -> np.ndarray:
    """Least hash under each coordinate's function, tagged with the coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        part = (items[at : at + 4096, None] ^ _SEEDS[None, :]) * _ODD[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return mix(least ^ _SEEDS)


def _fine(items: np.ndarray) -> np.ndarray:
    """A byte of the least hash under each further function."""
    least = np.full(FINE, np.iinfo(np.uint32).max, np.uint32)
    short = (items >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = (short[at : at + 1024, None] ^ _FINE_SEEDS[None, :]) * _FINE_ODD[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(255)).astype(np.uint8).view(np.int8)


def _sign_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            size, same_a, same_b, signature, fine = [], [], [], [], []
            for items in _sets((t.as_py() for t in batch.column("text")), k):
                size.append(len(items))
                a, b = _digest(items)
                same_a.append(a)
                same_b.append(b)
                signature.append(_signature(items).view(np.int64) if len(items) else None)
                fine.append(_fine(items) if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array(size, pa.int64()),
                    pa.array(same_a, pa.int64()),
                    pa.array(same_b, pa.int64()),
                    pa.array(signature, pa.list_(pa.int64())),
                    pa.array(fine, pa.list_(pa.int8())),
                ],
                ["doc_id", "key", "n_shingles", "same_a", "same_b", "signature", "fine"],
            )

    return run


def _size_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes = [len(items) for items in _sets((t.as_py() for t in batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_shingles"])

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            items = [x.view(np.int64) for x in _sets((t.as_py() for t in batch.column("text")), k)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(items, pa.list_(pa.int64()))], ["node", "items"])

    return run


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Distinct sorted keys, and the values of each."""
    if not len(keys):
        return [], []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return keys[np.append(0, cuts)].tolist(), np.split(values, cuts)


def _compare_list(value: int, left: np.ndarray, right: np.ndarray, of: dict[str, np.ndarray], matches: int, in_all: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Candidates (outsider, member) of one list, as places in the arrays.

    A pair is taken up only in the list of the first coordinate that both are posted under, and from its
    lesser node where both are outsiders. Equal coordinates of a pair are the bits of a number.
    """
    signature, posted, size = of["signature"], of["posted"], of["n_shingles"]
    before = np.uint32((1 << int(np.flatnonzero(signature[right[0]] == value)[0])) - 1)
    b = signature[right]
    for top in range(0, len(left), ROWS):
        part = left[top : top + ROWS]
        equal = np.zeros((len(part), len(right)), np.uint32)
        for c in range(COORDINATES):
            equal |= (signature[part, c][:, None] == b[:, c][None, :]).astype(np.uint32) << np.uint32(c)
        first = equal & posted[part][:, None] & posted[right][None, :] & before == 0
        first &= of["component"][part][:, None] != of["component"][right][None, :]
        first &= ~(of["outside"][right][None, :] & (of["node"][right][None, :] < of["node"][part][:, None]))
        p, q = np.nonzero(first)
        counted = np.bitwise_count(equal[p, q]).astype(np.int64)
        p, q = part[p], right[q]
        low, high = np.minimum(size[p], size[q]), np.maximum(size[p], size[q])
        fits = (counted >= matches) & (low * den >= high * num)
        p, q, counted = p[fits], q[fits], counted[fits]
        for at in range(0, len(p), 16_384):
            i, j = p[at : at + 16_384], q[at : at + 16_384]
            enough = counted[at : at + 16_384] + (of["fine"][i] == of["fine"][j]).sum(axis=1) >= in_all
            yield from zip(i[enough].tolist(), j[enough].tolist(), strict=True)


def _compare_block(matches: int, in_all: int, num: int, den: int):
    """Candidates of a block: a row for each node that has any, with an outsider's partners."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("value", kind="stable")
        of = {c: frame[c].to_numpy() for c in ("value", "side", "node", "component", "n_shingles", "outside", "posted")}
        of["posted"] = of["posted"].astype(np.uint32)
        of |= {c: np.stack(frame[c].to_numpy()) for c in ("signature", "fine")}
        partners: dict[int, set[int]] = {}
        for value, places in zip(*_grouped(of["value"], np.arange(len(frame))), strict=True):
            sides = of["side"][places]
            left, right = places[(sides == 0) | (sides == 2) & of["outside"][places]], places[sides > 0]
            if len(left) and len(right):
                for i, j in _compare_list(value, left, right, of, matches, in_all, num, den):
                    partners.setdefault(of["node"][i], set()).add(of["node"][j])
        met = set().union(*partners.values()) - partners.keys()
        x, y, block = (frame[c].iloc[0] for c in ("x", "y", "block"))
        rows = [(block, x, y, node, sorted(partners[node])) for node in sorted(partners)] + [(block, x, y, node, None) for node in sorted(met)]
        return pd.DataFrame(rows, columns=["block", "x", "y", "node", "partners"])

    return run


def _confirm_block(num: int, den: int):
    """Links of a block's candidates, on full sets; a document links at most once with what others have joined."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = dict(zip(frame.node, frame["items"], strict=True))
        root = dict(zip(frame.node, frame.node, strict=True))

        def top(doc: int) -> int:
            while root[doc] != doc:
                root[doc] = root[root[doc]]
                doc = root[doc]
            return doc

        links = []
        for doc, partners in zip(frame.node, frame.partners, strict=True):
            if partners is None:
                continue
            own = np.sort(sets[doc])
            for at in range(0, len(partners), ROWS):
                some = [o for o in partners[at : at + ROWS] if top(o) != top(doc)]
                if not some:
                    continue
                sizes = np.array([len(sets[o]) for o in some])
                items = np.concatenate([sets[o] for o in some])
                found = own[np.minimum(np.searchsorted(own, items), len(own) - 1)] == items
                both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
                for k in np.flatnonzero(both * den >= (len(own) + sizes - both) * num):
                    if top(some[k]) != top(doc):
                        root[top(some[k])] = top(doc)
                        links.append((doc, some[k]))
        return pd.DataFrame(links, columns=["src", "dst"]).astype("int64")

    return run


def _counted(pairs: DataFrame, signed: DataFrame, matches: int, in_all: int, num: int, den: int) -> DataFrame:
    """Pairs with enough equal coordinates and sizes that allow the similarity."""
    def of(name: str) -> DataFrame:
        return signed.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("signature", "fine", "n_shingles")])

    def equal(column: str) -> Column:
        same = F.zip_with(f"{column}_src", f"{column}_dst", lambda x, y: (x == y).cast("int"))
        return F.aggregate(same, F.lit(0), lambda a, x: a + x)

    low, high = F.least("n_shingles_src", "n_shingles_dst"), F.greatest("n_shingles_src", "n_shingles_dst")
    near = pairs.join(of("src"), "src").join(of("dst"), "dst").where(low * den >= high * num)
    return near.where((equal("signature") >= matches) & (equal("signature") + equal("fine") >= in_all)).select("src", "dst")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and a key of both: rows that repeat an id with another text are other documents."""
    doc, text = integer_id(docs, id_col), docs[text_col]
    return docs.select(doc.alias("doc_id"), text.alias("text"), text_key(doc, text).alias("key"))


def text_key(doc: Column, text: Column) -> Column:
    """16 bytes of an id and a text, nulls included."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))))


def _full_sets(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and items of the wanted nodes (node, key). Texts whose key is not in a bitmap of wanted keys are not shuffled."""
    bit = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    marks = wanted.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_marks"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_marks", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = texts.join(F.broadcast(marks), F.bitmap_bucket_number(bit) == F.col("_bucket"))  # FILTER_BITS / 8 bytes at most
    met = met.where(F.getbit(byte, (place % 8).cast("int")) == 1).select("key", "text").join(wanted, "key").select("node", "text")
    return met.mapInArrow(_set_batches(k), "node long, items array<long>").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, texts: DataFrame, reps: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    wanted = reps.join(pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_semi").select("node", "key")
    sets = _full_sets(texts, wanted, k)
    joined = pairs.join(sets.select(F.col("node").alias("src"), F.col("items").alias("a")), "src").join(
        sets.select(F.col("node").alias("dst"), F.col("items").alias("b")), "dst"
    )
    both = F.size(F.array_intersect("a", "b"))
    return joined.where(both * den >= (F.size("a") + F.size("b") - both) * num).select("src", "dst")


def _signed(texts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """What is known of every row, and one representative for each distinct set that has shingles: exact copies cost one posting in all."""
    signed = settle(
        texts.mapInArrow(_sign_batches(k), "doc_id long, key binary, n_shingles long, same_a long, same_b long, signature array<long>, fine array<tinyint>")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "same_a", "same_b").agg(first, F.first("signature").alias("signature"), F.first("fine").alias("fine"))
    # an id may be in several classes, with several texts: classes are known by a number
    return signed, settle(
        classes.select(F.monotonically_increasing_id().alias("node"), "rep.doc_id", "rep.key", "same_a", "same_b", "n_shingles", "signature", "fine")
    )


def _links(texts: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """src and dst of links between nodes, enough of them to connect all that are linked."""
    num, den = percent, 100
    matches, in_all = least_matches(COORDINATES, percent / 100), least_matches(COORDINATES + FINE, percent / 100)
    postings = reps.select("node", F.explode("signature").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = (
        postings.join(shared, "value")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("own"), F.sum("df").alias("weight"))
        .where(F.size("own") >= matches)
    )
    posted = settle(ranked.select("node", "weight", F.expr(f"transform(slice(own, 1, size(own) - {matches} + 1), p -> p.value)").alias("values")))
    prefix = posted.select("node", "weight", F.explode("values").alias("value"))

    def linked(pairs: DataFrame) -> DataFrame:
        return settle(_confirmed(settle(_counted(pairs.distinct(), reps, matches, in_all, num, den)), texts, reps, k, num, den))

    def placed(links: DataFrame) -> DataFrame:
        of = connected_components(links)
        return settle(prefix.join(of, "node", "left").select("value", "weight", "node", F.coalesce("component", "node").alias("component")))

    best = F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")
    leaders = prefix.groupBy("value").agg(best, F.count("*").alias("n")).where("n > 1").select("value", (-F.col("top.minus")).alias("src"))
    links = linked(prefix.join(leaders, "value").where("node <> src").select("src", F.col("node").alias("dst")))

    def largest(lists: DataFrame) -> DataFrame:
        """The component that most of an open list's members are in."""
        parts = lists.groupBy("value", "component").agg(F.count("*").alias("n"))
        return parts.groupBy("value").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")

    lists = placed(links)
    while True:  # a leader more for each list, from outside its largest component, while that pays
        spanning = settle(largest(lists))
        waiting = lists.join(spanning, "value").where("component <> main")
        n_waiting = waiting.select("node").distinct().count()
        if not n_waiting:
            return links
        top = F.max(F.struct("weight", (-F.col("node")).alias("minus"), "component")).alias("top")
        second = waiting.groupBy("value").agg(top).select("value", (-F.col("top.minus")).alias("src"), F.col("top.component").alias("mine"))
        found = linked(lists.join(second, "value").where("component <> mine").select("src", F.col("node").alias("dst")))
        n_found = found.count()
        if n_found:
            links = links.unionByName(found)
            lists = placed(links)
        if n_found * 4 < n_waiting:
            break
    # lists that still span components: their outsiders with all members, in blocks of bounded size
    posts = F.expr(f"aggregate(sequence(0, {COORDINATES - 1}), 0L, (all, c) -> all + if(array_contains(values, signature[c]), shiftleft(1L, c), 0L))")
    signs = reps.join(posted.select("node", "values"), "node").select("node", "n_shingles", "signature", "fine", posts.alias("posted"))
    members = lists.join(largest(lists), "value").withColumn("outside", F.col("component") != F.col("main")).join(signs, "node")

    def sides(of: Column) -> Column:
        return F.greatest(F.ceil(F.sum(F.when(of, 1)) / BLOCK), F.ceil(F.sum(F.when(of, F.col("n_shingles"))) / BLOCK_SHINGLES)).cast("int")

    shape = settle(members.groupBy("value").agg(sides(F.col("outside")).alias("xs"), sides(F.lit(True)).alias("ys"), F.count("*").alias("n"), F.sum("n_shingles").alias("weight")))
    short = shape.where("xs = 1 and ys = 1").agg(F.sum("n"), F.sum("weight")).first()
    shared_blocks = max(1, math.ceil((short[0] or 0) / BLOCK), math.ceil((short[1] or 0) / BLOCK_SHINGLES))
    members = members.drop("weight").join(shape.drop("n", "weight"), "value")
    hashed = F.xxhash64("node")
    carried = ("value", "node", "component", "n_shingles", "outside", "signature", "fine", "posted")
    alone = F.col("xs") * F.col("ys") == 1
    block = F.when(alone, F.pmod(F.xxhash64("value"), F.lit(shared_blocks))).otherwise(F.col("value")).alias("block")
    side = F.when(alone, 2).otherwise(1).alias("side")
    rights = members.select(block, F.explode(F.expr("sequence(0, xs - 1)")).alias("x"), F.pmod(hashed, F.col("ys")).cast("int").alias("y"), alone.alias("alone"), side, *carried)
    lefts = members.where(F.col("outside") & ~alone).select(
        block, F.pmod(hashed, F.col("xs")).cast("int").alias("x"), F.explode(F.expr("sequence(0, ys - 1)")).alias("y"), alone.alias("alone"), F.lit(0).alias("side"), *carried
    )
    candidates = settle(
        lefts.unionByName(rights).groupBy("block", "x", "y", "alone")
        .applyInPandas(_compare_block(matches, in_all, num, den), "block long, x int, y int, node long, partners array<long>")
    )
    wanted = reps.join(candidates.select("node").distinct(), "node", "left_semi").select("node", "key")
    late = settle(candidates.join(_full_sets(texts, wanted, k), "node").groupBy("block", "x", "y").applyInPandas(_confirm_block(num, den), "src long, dst long"))
    return links.unionByName(late)


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Group documents whose sets of k-word shingles have a Jaccard similarity of percent / 100 or more.

    Returns one row per input row: id_col, n_shingles, component_id (least id reachable by links),
    kept (the row's id is that id). Words are lower-cased in A-Z only; a text with fewer than k words
    is one shingle. Null or wordless texts have no shingles and link with nothing. Rows that repeat
    an id share its component; if their texts differ, each text links for that id. A null id links
    with nothing, gets a null component and is kept. Other columns are ignored, clashing names included.

    Similar sets share a coordinate with their similarity as chance: at 0.8, a link is missed where fewer
    than 16 of 32 coordinates are equal (3.3e-5) or fewer than 83 of all 128 (2.0e-5).
    """
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col).where("doc_id is not null")
    signed, reps = _signed(texts, k)
    links = _links(texts, reps, k, percent)
    for end in ("src", "dst"):
        links = links.join(reps.select(F.col("node").alias(end), F.col("doc_id").alias(f"{end}_doc")), end).drop(end).withColumnRenamed(f"{end}_doc", end)
    # every document of a class is linked with its representative
    same = ["n_shingles", "same_a", "same_b"]
    ties = signed.where("n_shingles > 0").select("doc_id", *same).join(reps.select(F.col("doc_id").alias("src"), *same), same)
    ties = ties.select("src", F.col("doc_id").alias("dst")).where("src <> dst")
    nodes = connected_components(links.unionByName(ties))
    of_none = _texts(docs, id_col, text_col).where("doc_id is null").mapInArrow(_size_batches(k), "doc_id long, n_shingles long")
    return (
        signed.select("doc_id", "n_shingles")
        .join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .unionByName(of_none, allowMissingColumns=True)
        .select(
            F.col("doc_id").alias(id_col),
            "n_shingles",
            F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one left of each group of near-duplicates, all columns kept.

    A document is a row's id and text together: rows that repeat both count once, those that repeat an id with
    another text are judged for themselves, null ids as well. The document of least id stays, null ids after
    all others. Null or wordless texts are near nothing.
    """
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    signed, reps = _signed(texts, k)
    of = connected_components(_links(texts, reps, k, percent))
    grouped = reps.join(of, "node", "left").groupBy(F.coalesce("component", "node").alias("component"))
    first = grouped.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep")).select("rep.key")
    kept = first.unionByName(signed.where("n_shingles = 0").select("key")).withColumnRenamed("key", "_key")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")  # no name of theirs can clash
    keyed = docs.select(row, text_key(integer_id(docs, id_col), docs[text_col]).alias("_key"))
    return keyed.join(kept, "_key", "left_semi").groupBy("_key").agg(F.first("row").alias("row")).select("row.*")
