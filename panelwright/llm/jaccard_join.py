"""Exact Jaccard join of word-shingle sets in metric space: pivots, Voronoi regions, windows, recursion.

The distance of two sets is one minus their Jaccard similarity, a metric. Documents at a distance of at most
``RADIUS`` link.

1. Equal texts become one text class. Shingle sets are hashed to 64 bits; equal sets become one class.
2. Unrelated documents are all at distance 1 of each other, and no pivot that is a document could part them.
   The pivots of the first level are therefore the shingles, as sets of one: a text lies nearest to those it
   holds, and of these equally near pivots the one that fewest texts hold is its home. A linked text lacks at
   most t = n - ceil(0.85 n) of its n shingles, so the window of a text is its first t + 1 pivots in that
   order: two linked texts meet in one. Texts with t + 1 shingles of their own are proved to be alone.
   To count the texts of a shingle, texts are dealt to chunks; each chunk sends its distinct shingles to the
   hash ranges and gets the numbers back in the same order.
3. Regions that share members are joined to groups, and a group is joined recursively: its pivots are some
   of its members, central ones first; every member goes to its nearest pivot and, because of the triangle
   inequality, to each earlier pivot that is at most twice the radius farther away. Members within the radius
   of a pivot are linked to it. A region whose members have one label is done, a small one is joined in one
   task by the same recursion, a larger one again by Spark.
4. Regions that their pivots hardly divide hold sets that are all close to each other. There only members
   without the most frequent label are left to be compared with all others, in blocks.
5. Links are contracted to components.

Nothing is approximate but the 64-bit hash of a shingle; counts only order the pivots.

Defined results: a null, empty or blank text has no shingles and is its own component. A row without an id
links like others, its component is the smallest id it reaches, null if there is none. Rows that share an
id are each judged by their own text. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import batch_of, joined_by_key, shingle_codes, spaced_words, text_rows, text_slices, word_codes, written
from panelwright.llm.minhash_join import connected

WIDTH = 4
#: Similarity of linked documents in hundredths, and their greatest distance.
PERCENT = 85
RADIUS = 1 - PERCENT / 100
#: Bytes of text in a chunk, and about how many of its shingles meet in a hash range.
CHUNK_BYTES, RANGE_CODES = 4_000_000, 4_000_000
#: Shingles of a group that one task joins, and of a block.
GROUP_CODES = 500_000
#: Pivots of a region: members of the highest mean number of texts for each shingle, and members at random.
CENTRAL, RANDOM = 4, 12
#: A region with more than this share of its parent's shingles is hardly divided.
SHARE = 0.8
#: Members that are compared without pivots.
LEAF = 24
#: A row that has more than one in so many of all rows is reduced to one before texts are dealt.
HOT_SHARE = 1000
_NO_ID = np.iinfo(np.int64).max
_SLACK = 1e-9


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle codes of each text, words lower-cased (A-Z only)."""
    import pyarrow.compute as pc

    words = spaced_words(pc.ascii_lower(texts))
    codes = word_codes(words)
    for i in range(len(words)):
        yield np.unique(shingle_codes(codes[words.bounds[i] : words.bounds[i + 1]], width))


def spare(n: int) -> int:
    """How many of n shingles a linked text may lack."""
    return n - -(-PERCENT * n // 100)


def similar(both, n, m):
    return 100 * both >= PERCENT * (n + m - both)


# -- the first level: shingles as pivots ----------------------------------------------------------


def _own_texts(rows: pa.Table, notes: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """One row for each text class that is at home in this chunk, by its key, and the sets."""
    keys = {(r, h) for r, h in zip(notes.column("rid").to_pylist(), notes.column("hash").to_pylist(), strict=True) if h is not None}
    places = {}
    for i, key in enumerate(zip(rows.column("rid").to_pylist(), rows.column("hash").to_pylist(), strict=True)):
        if key in keys:
            places.setdefault(key, i)
    kept = rows.take(pa.array([places[k] for k in sorted(places)], pa.int64()))
    sets = []
    for batch in kept.to_batches():
        sets += [codes for texts in text_slices(batch.column("text")) for codes in shingle_sets(texts)]
    return kept, sets


def _short(codes: np.ndarray) -> np.ndarray:
    """48 bits of the codes: what the first level tells shingles apart by. Sorted codes stay sorted."""
    return np.unique(codes >> np.uint64(16))


def _counted(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([_short(x) for x in sets]) if sets else np.zeros(0, np.uint64), return_counts=True)


_ASKED = pa.schema([("range", pa.int32()), ("chunk", pa.int64()), ("bins", pa.binary()), ("lows", pa.binary()), ("counts", pa.binary())])


def _ask(ranges: int):
    """The chunk's distinct shingles, dealt to ``ranges`` (a power of two) ranges of their upper 16 bits."""

    def run(key, rows: pa.Table, notes: pa.Table) -> pa.Table:
        codes, counts = _counted(_own_texts(rows, notes)[1])
        bins = np.bincount((codes >> np.uint64(32)).astype(np.int64), minlength=1 << 16)
        ends = np.cumsum(bins.reshape(ranges, -1).sum(axis=1))
        lows, few, out = codes.astype("<u4"), np.minimum(counts, 255).astype(np.uint8), []
        for r, (a, b) in enumerate(zip(ends - bins.reshape(ranges, -1).sum(axis=1), ends, strict=True)):
            if b > a:
                out.append((r, key[0].as_py(), bins.reshape(ranges, -1)[r].astype("<u4").tobytes(), lows[a:b].tobytes(), few[a:b].tobytes()))
        return pa.Table.from_pylist([dict(zip(_ASKED.names, x, strict=True)) for x in out], _ASKED)

    return run


_ANSWERS = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("levels", pa.binary())])


def _answer(table: pa.Table) -> pa.Table:
    """For every shingle of every chunk its level: 1 if one text holds it, else a rounded logarithm."""
    codes, counts, sizes = [], [], []
    for bins, lows, few in zip(*(table.column(c).to_pylist() for c in ("bins", "lows", "counts")), strict=True):
        bins = np.frombuffer(bins, "<u4")
        codes.append(np.repeat(np.arange(len(bins), dtype=np.uint64) << np.uint64(32), bins) | np.frombuffer(lows, "<u4").astype(np.uint64))
        counts.append(np.frombuffer(few, np.uint8))
        sizes.append(len(codes[-1]))
    place = np.unique(np.concatenate(codes), return_inverse=True)[1]
    n = np.bincount(place, np.concatenate(counts))
    levels = np.where(n <= 1, 1, np.minimum(255, 2 + 6 * np.log2(np.maximum(n, 2)))).astype(np.uint8)[place]
    parts = np.split(levels, np.cumsum(sizes)[:-1])
    return pa.table([table.column("chunk"), table.column("range"), pa.array([x.tobytes() for x in parts], pa.binary())], schema=_ANSWERS)


_SIGNED = pa.schema(
    [("rid", pa.int64()), ("hash", pa.binary()), ("n", pa.int64()), ("digest", pa.binary()), ("central", pa.float64()), ("window", pa.binary()), ("codes", pa.binary())]
)


def _sign(key, rows: pa.Table, notes: pa.Table) -> pa.Table:
    """The sets of a chunk with the pivots in their windows; a text that is alone has no window."""
    kept, sets = _own_texts(rows, notes)
    codes, _ = _counted(sets)
    given = notes.filter(notes.column("levels").is_valid()).sort_by("range")
    levels = np.frombuffer(b"".join(given.column("levels").to_pylist()), np.uint8)
    out = {name: [] for name in _SIGNED.names[2:]}
    for own in sets:
        short = _short(own)
        level = levels[np.searchsorted(codes, short)]
        room = spare(len(own)) + 1
        alone = int((level == 1).sum()) >= room or not len(own)
        order = np.lexsort((short, level))[:room]
        packed = own.astype("<u8").tobytes()
        out["n"].append(len(own))
        out["digest"].append(hashlib.blake2b(packed, digest_size=16).digest() if len(own) else None)
        out["central"].append(float(level.mean()) if len(own) else 0.0)
        out["window"].append(None if alone else short[order][level[order] > 1].astype("<i8").tobytes())
        out["codes"].append(None if alone else packed)
    columns = [kept.column("rid"), kept.column("hash"), *(pa.array(out[f.name], f.type) for f in list(_SIGNED)[2:])]
    return pa.table(columns, schema=_SIGNED)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("pivot", pa.int64()), ("cls", pa.int64())])
    for batch in batches:
        windows = [np.frombuffer(x, "<i8") for x in batch.column("window").to_pylist()]
        sizes = [len(x) for x in windows]
        flat = np.concatenate(windows) if windows else np.zeros(0, np.int64)
        yield batch_of(schema, {"pivot": flat, "cls": np.repeat(batch.column("cls").to_numpy(), sizes)})


# -- regions around documents ---------------------------------------------------------------------


class Region:
    """Sets of a few members, their labels, and the links found between members of different labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, central: np.ndarray, packed: list[bytes]):
        sets = [np.frombuffer(x, "<u8") for x in packed]
        self.ids, self.labels, self.central = ids, labels.copy(), central
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.known, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.links: list[tuple[int, int]] = []

    def codes(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.sizes[i] : self.ends[i]]

    def gather(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of some members in one array, and their bounds in it."""
        bounds = np.append(0, np.cumsum(self.sizes[own]))
        starts = self.ends[own] - self.sizes[own]
        return self.flat[np.repeat(starts - bounds[:-1], self.sizes[own]) + np.arange(bounds[-1])], bounds

    def shared(self, i: int, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many codes member i shares with each of the gathered ones."""
        mark = np.zeros(len(self.known), bool)
        mark[self.codes(i)] = True
        hits = np.append(0, np.cumsum(mark[flat]))
        return hits[bounds[1:]] - hits[bounds[:-1]]

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = self.labels[i], self.labels[j]
            if a != b:
                self.links.append((int(self.ids[i]), int(self.ids[j])))
                self.labels[self.labels == max(a, b)] = min(a, b)

    def meet(self, i: int, own: np.ndarray, flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Link member i with those of ``own`` within the radius; its distances to all of them."""
        both = self.shared(i, flat, bounds)
        self.link(i, own[similar(both, self.sizes[i], self.sizes[own])])
        return 1 - both / (self.sizes[i] + self.sizes[own] - both)

    def compare(self, some: np.ndarray, own: np.ndarray) -> None:
        """Link ``some`` with ``own`` by all distances between members of different labels."""
        flat, bounds = self.gather(own)
        for i in some:
            if (self.labels[own] != self.labels[i]).any():
                self.meet(i, own, flat, bounds)

    def join(self, own: np.ndarray) -> None:
        """All members of ``own`` with each other, recursively."""
        due = [own]
        while due:
            own = due.pop()
            names, counts = np.unique(self.labels[own], return_counts=True)
            if len(names) < 2:
                continue
            if len(own) > LEAF:
                flat, bounds = self.gather(own)
                pivots = choose(own, self.central[own], self.ids[own])
                away = np.array([self.meet(i, own, flat, bounds) for i in pivots])
                parts = [own[x] for x in regions(away)]
                if max(self.sizes[x].sum() for x in parts) <= SHARE * self.sizes[own].sum():
                    due += parts
                    continue
                names, counts = np.unique(self.labels[own], return_counts=True)
            self.compare(own[self.labels[own] != names[counts.argmax()]], own)


def choose(own: np.ndarray, central: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The most central members and, of the others, those with the least hash."""
    first = np.argsort(-central, kind="stable")[:CENTRAL]
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = np.setdiff1d(np.argsort(mixed, kind="stable")[: CENTRAL + RANDOM], first)[:RANDOM]
    return own[np.concatenate([first, rest])]


def regions(away: np.ndarray) -> list[np.ndarray]:
    """Masks of the members of each pivot's region: those nearest to it, and those nearest to a later pivot
    that the triangle inequality does not keep apart. ``away`` holds distances, pivots by members."""
    home = away.argmin(axis=0)
    least = away.min(axis=0)
    return [(home == j) | ((home > j) & (away[j] - least <= 2 * RADIUS + _SLACK)) for j in range(len(away))]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_of(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=_LINKS)


def _region(table: pa.Table) -> Region:
    ids, labels, central = (table.column(c).to_numpy() for c in ("cls", "label", "central"))
    return Region(ids, labels, central, table.column("codes").to_pylist())


def _join_small(table: pa.Table) -> pa.Table:
    """All regions of a bin, one after the other."""
    table = table.sort_by([("region", "ascending"), ("cls", "ascending")])
    names, starts = np.unique(table.column("region").to_numpy(), return_index=True)
    found = []
    for a, b in zip(starts, [*starts[1:], len(table)], strict=True):
        region = _region(table.slice(a, b - a))
        region.join(np.arange(b - a))
        found += region.links
    return _links_of(found)


_SPLIT = pa.schema([("region", pa.int64()), ("pivot", pa.int64()), ("cls", pa.int64()), ("linked", pa.bool_()), ("inside", pa.bool_())])


def _split(table: pa.Table) -> pa.Table:
    """One slice of a large region: its members' distances to all pivots of the region."""
    table = table.sort_by([("is_pivot", "descending"), ("rank", "ascending"), ("cls", "ascending")])
    region = _region(table)
    n_pivots = int(table.column("is_pivot").to_numpy(zero_copy_only=False).sum())
    own = np.arange(n_pivots, len(table))
    if not len(own):
        return _SPLIT.empty_table()
    flat, bounds = region.gather(own)
    both = np.array([region.shared(i, flat, bounds) for i in range(n_pivots)])
    union = region.sizes[:n_pivots, None] + region.sizes[own][None, :] - both
    inside, linked = np.array(regions(1 - both / union)), 100 * both >= PERCENT * union
    p, m = np.nonzero(inside | linked)
    columns = [np.full(len(p), table.column("region")[0].as_py()), region.ids[p], region.ids[own][m], linked[p, m], inside[p, m]]
    return pa.table([pa.array(c) for c in columns], schema=_SPLIT)


def _compare_blocks(table: pa.Table) -> pa.Table:
    """Some members of a region (side 0) with a block of all members (side 1)."""
    table = table.sort_by([("side", "ascending"), ("cls", "ascending")])
    region, side = _region(table), table.column("side").to_numpy()
    region.compare(np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    return _links_of(region.links)


def _labelled(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``members`` (region, cls, n, central) with the labels that all links give."""
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    named = members.join(connected(found).withColumnRenamed("rep", "cls"), "cls", "left")
    return named.withColumn("label", F.coalesce("label", "cls"))


def _blocks(column, size):
    """A number of the block for the rows of a region whose shingles sum up to ``column``."""
    return F.ceil(F.col(column) / F.lit(size)).cast("int")


def _pivots(rows: DataFrame) -> DataFrame:
    """``region, cls, rank`` of the pivots of each region, found in two steps of bounded size."""
    from pyspark.sql import Window

    mixed = F.xxhash64("cls", F.lit("pivot"))
    salted = rows.select("region", "cls", "central", mixed.alias("mixed"), F.pmod(mixed, F.lit(256)).alias("salt"))
    for keys in (["region", "salt"], ["region"]):
        by = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))  # noqa: B023, E731
        salted = salted.withColumns({"first": by(F.desc("central"), "cls"), "second": by("mixed")})
        salted = salted.filter((F.col("first") <= CENTRAL) | (F.col("second") <= RANDOM))
    return salted.select("region", "cls", F.least("first", F.col("second") + CENTRAL).alias("rank"))


def region_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``a, b``) that connect all similar members (``region, cls, n, central``) of the same region;
    ``sets`` holds the ``codes`` of each ``cls``."""
    spark = members.sparkSession
    links = [spark.createDataFrame([], "a long, b long")]
    left = members
    while True:
        rows = written(_labelled(left, links), "members")
        totals = rows.groupBy("region").agg(F.sum("n").alias("codes"), F.min("label").alias("low"), F.max("label").alias("high"))
        totals = written(totals.filter("low != high"), "regions")
        small, large = totals.filter(F.col("codes") <= GROUP_CODES), totals.filter(F.col("codes") > GROUP_CODES)
        codes = small.agg(F.sum("codes")).first()[0] or 0
        if codes:
            bins = F.pmod(F.xxhash64("region"), F.lit(1 + codes // (2 * GROUP_CODES))).alias("bin")
            loaded = rows.join(small.select("region", bins), "region").join(sets, "cls")
            loaded = loaded.select("bin", "region", "cls", "label", "central", "codes")
            links.append(written(loaded.groupBy("bin").applyInArrow(_join_small, "a long, b long"), "links"))
        if large.isEmpty():
            break
        rows = rows.join(large.select("region", "codes"), "region")
        pivots = written(_pivots(rows), "pivots")
        slices = _blocks("codes", GROUP_CODES)
        dealt = rows.select("region", "cls", "label", "central", F.pmod(F.xxhash64("cls"), slices).cast("int").alias("slice"), F.lit(False).alias("is_pivot"), F.lit(0).alias("rank"))
        many = rows.join(pivots, ["region", "cls"]).select("region", "cls", "label", "central", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), F.lit(True).alias("is_pivot"), "rank")
        loaded = dealt.unionByName(many).join(sets, "cls")
        split = loaded.groupBy("region", "slice").applyInArrow(_split, "region long, pivot long, cls long, linked boolean, inside boolean")
        split = written(split, "split")
        links.append(split.filter("linked and pivot != cls").select(F.col("pivot").alias("a"), F.col("cls").alias("b")))
        parts = split.filter("inside").join(rows.select("region", "cls", "n", "central", "codes"), ["region", "cls"])
        parts = written(parts.select("region", "pivot", "cls", "n", "central", "codes"), "parts")
        sizes = parts.groupBy("region", "pivot").agg(F.sum("n").alias("own"), F.first("codes").alias("codes"))
        stuck = sizes.groupBy("region").agg(F.max("own").alias("own"), F.first("codes").alias("codes"))
        stuck = written(stuck.filter(F.col("own") > SHARE * F.col("codes")).select("region"), "stuck")
        if not stuck.isEmpty():
            links.append(_all_of(_labelled(rows.join(stuck, "region").drop("label"), links), sets))
        # Equal numbers of two regions would only join more than needed.
        divided = parts.join(stuck, "region", "left_anti")
        left = divided.select(F.xxhash64("region", "pivot").alias("region"), "cls", "n", "central")
        if left.isEmpty():
            break
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    return found


def _all_of(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of regions that pivots do not divide: all members but those of the commonest label meet all."""
    rows = written(rows, "undivided")
    counts = rows.groupBy("region", "label").agg(F.count(F.lit(1)).alias("k"))
    common = counts.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("common"))
    rows = rows.join(common, "region")
    rare = rows.filter("label != common")
    work = rare.groupBy("region").agg(F.sum("n").alias("rare_codes"))
    rows, rare = (x.join(work, "region").withColumns({"of_all": _blocks("codes", GROUP_CODES), "of_rare": _blocks("rare_codes", GROUP_CODES)}) for x in (rows, rare))
    place = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rare.select("region", "cls", "label", "central", place("of_rare").alias("x"), each("of_all").alias("y"), F.lit(0).alias("side"))
    two = rows.select("region", "cls", "label", "central", each("of_rare").alias("x"), place("of_all").alias("y"), F.lit(1).alias("side"))
    loaded = one.unionByName(two).join(sets, "cls")
    return written(loaded.groupBy("region", "x", "y").applyInArrow(_compare_blocks, "a long, b long"), "blocks")


# -- the operator ---------------------------------------------------------------------------------


def _dealt(rows: DataFrame, named: DataFrame, chunks: int) -> DataFrame:
    """Texts with their chunk. A row that is repeated very often (id and text) is sent once."""
    n = F.count(F.lit(1))
    hot = named.groupBy("rid", "hash").agg(n.alias("k")).filter(F.col("k") * HOT_SHARE > max(HOT_SHARE, named.count()))
    hot = F.broadcast(written(hot.select("rid", "hash"), "hot"))  # fewer than HOT_SHARE rows
    once = rows.join(hot, ["rid", "hash"], "left_semi").groupBy("rid", "hash").agg(F.min("text").alias("text"))
    all_rows = rows.join(hot, ["rid", "hash"], "left_anti").unionByName(once)
    return all_rows.withColumn("chunk", _chunk(chunks))


def _chunk(chunks: int):
    return F.pmod(F.xxhash64("rid", "hash"), F.lit(chunks))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    rows = text_rows(docs, id_col, text_col).select(
        "doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("rid"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("hash"), "text"
    )
    named = written(rows.select("doc_id", "rid", "hash", F.octet_length("text").alias("size")), "named")
    texts = named.groupBy("hash").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("n_rows"))
    texts = written(texts, "texts")
    size = named.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    chunks, ranges = 1 + size // CHUNK_BYTES, 1
    while ranges < 1 << 16 and ranges * RANGE_CODES * 6 < size:  # a word takes about six bytes
        ranges *= 2
    rows = _dealt(rows.select("rid", "hash", "text"), named, chunks)
    homes = texts.select(_chunk(chunks).alias("chunk"), "rid", "hash", F.lit(None).cast("int").alias("range"), F.lit(None).cast("binary").alias("levels"))
    asked = rows.groupBy("chunk").cogroup(homes.groupBy("chunk")).applyInArrow(_ask(ranges), "range int, chunk long, bins binary, lows binary, counts binary")
    answers = written(asked.groupBy("range").applyInArrow(_answer, "chunk long, range int, levels binary"), "answers")
    notes = homes.unionByName(answers.select("chunk", F.lit(None).cast("long").alias("rid"), F.lit(None).cast("binary").alias("hash"), "range", "levels"))
    signed = rows.groupBy("chunk").cogroup(notes.groupBy("chunk")).applyInArrow(
        _sign, "rid long, hash binary, n long, digest binary, central double, window binary, codes binary"
    )
    signed = written(signed, "signed")

    sets = signed.filter("codes is not null").groupBy("digest").agg(F.min(F.struct("rid", "hash")).alias("key"), F.first("n").alias("n"), F.first("central").alias("central"), F.first("window").alias("window"))
    classes = written(sets.withColumn("cls", F.monotonically_increasing_id()), "classes")
    posted = written(classes.select("cls", "window").mapInArrow(_post, "pivot long, cls long"), "posted")
    leads = posted.groupBy("pivot").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    met = joined_by_key(posted, leads, "pivot", "held")
    groups = connected(met.select(F.col("lead").alias("a"), F.col("cls").alias("b")))
    members = groups.select(F.col("rep").alias("cls"), F.col("label").alias("region")).join(classes.select("cls", "n", "central", "key", "digest"), "cls")
    members = written(members, "grouped")
    wanted = members.select("cls", "digest", F.col("key.rid").alias("rid"), F.col("key.hash").alias("hash"))
    codes = signed.filter("codes is not null").select("rid", "hash", "digest", "codes").join(wanted, ["rid", "hash", "digest"])
    codes = written(codes.select("cls", "codes"), "sets")
    label = connected(region_links(members.select("region", "cls", "n", "central"), codes)).withColumnRenamed("rep", "cls")

    low = signed.filter("digest is not null").groupBy("digest").agg(F.min("rid").alias("low"), F.count(F.lit(1)).alias("n_texts"))
    joined = low.join(classes.select("digest", "cls").join(label, "cls"), "digest", "left")
    joined = written(joined.select("digest", "low", "n_texts", "label"), "labelled")
    least = joined.filter("label is not null").groupBy("label").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("n_sets"))
    named_sets = joined_by_key(joined.filter("label is not null"), least, "label", "n_sets").select("digest", "n_texts", F.col("least").alias("low"))
    whole = named_sets.unionByName(joined.filter("label is null").select("digest", "n_texts", "low"))
    of_text = joined_by_key(signed.filter("digest is not null").select("rid", "hash", "n", "digest"), whole, "digest", "n_texts")
    of_text = of_text.select("hash", "n", "low").unionByName(signed.filter("digest is null").select("hash", "n", F.lit(None).cast("long").alias("low")))
    values = texts.select("hash", "n_rows").join(of_text, "hash")
    found = joined_by_key(named.select("doc_id", "hash"), values, "hash", "n_rows")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("low") != _NO_ID, F.col("low"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
