"""Katz backoff language model over words, trained and evaluated with joins.

Training counts words and word pairs of all training documents. Counts up to ``GOOD_TURING``, 1 among
them, are discounted by Good-Turing, and every count loses ``LEAST`` at least, so that a history whose pairs are
all frequent also leaves something to the words it never met. Pairs below ``CUTOFF`` would count as unseen; at
1 there are none, and every pair of the training documents is in the model. What the seen words of a history
leave is spread over the other words in proportion to their unigram probability; the backoff weight is the
exact quotient of both rests, so that the probabilities after any history add up to 1. One class stands for
all unknown words; its probability is what discounting takes from the known ones.

Documents are tokenized once into chunks of at most about ``CHUNK_BYTES`` of text. A chunk keeps its distinct
words and its tokens as places among them, so that it asks for each distinct word and each distinct pair
once, however often it occurs. Questions go to groups of a bounded number of them: one compressed row of
sorted numbers for each chunk and group, answered by one row of counts in the same order.

1. Words are counted in groups by a hash, numbered by falling frequency within their group, and each
   chunk learns the numbers and counts of its words.
2. Pairs are counted in groups by a hash of the history; a history of more than ``HOT_HISTORY`` tokens is
   spread over groups by its words. A group's counts are one row of the stored model, and each chunk
   learns the counts of its pairs. Sums of the discounted counts over the model give the histories' weights.
3. Weights are told to the chunks in the groups of the words. A chunk then scores its documents: "the pair if
   seen, else the weight times the next lower order", for every token, in logs.

Words are 64-bit hashes inside the tables. Logs are base 10.

Defined results: a null or empty text is its end token alone. Rows without an id train and are not held
out. Rows that repeat an id or a text are scored one by one. Without training documents the counts are
0, and every token has the log of 1 (unknown words are certain). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import batch_of, bucket, mix, release, spaced_words, text_rows, text_slices, trim, word_codes, written

FOLDS, HELD_OUT = 5, 1
GOOD_TURING, CUTOFF, LEAST = 5, 1, 0.1
#: Code of the end token; words have hashes of their bytes.
END = 0x1D3F1C55E2A7B601
#: Bytes of text in a chunk, where a batch has as many.
CHUNK_BYTES = 4_000_000
#: Distinct words of chunks, and tokens, whose words or pairs are counted in one group.
GROUP_USES, GROUP_TOKENS = 400_000, 2_000_000
#: Training tokens of a history for each group over which its pairs are spread.
HOT_HISTORY = 500_000
#: Number of the start as a history, and the word number that stands for "the weight of this history".
BEGIN, WEIGHT = 0, -1

_CHUNK = pa.schema(
    [
        ("chunk", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("held_out", pa.list_(pa.bool_())),
        ("lengths", pa.list_(pa.int64())),
        ("words", pa.binary()),
        ("tokens", pa.binary()),
    ]
)
_CHUNK_DDL = "chunk long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, words binary, tokens binary"


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents; place 0 among the words is the end token."""
    import pyarrow.compute as pc
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        at = 0
        for texts in text_slices(batch.column("text"), CHUNK_BYTES):
            pieces = spaced_words(pc.ascii_lower(texts))
            n = len(texts)
            bounds = pieces.bounds + np.arange(n + 1)
            tokens = np.zeros(bounds[-1], np.uint32)
            inner = np.ones(len(tokens), bool)
            inner[bounds[1:] - 1] = False
            distinct, places, uses = np.unique(word_codes(pieces), return_inverse=True, return_counts=True)
            # The most frequent words first, so that places are small numbers.
            order = np.argsort(-uses, kind="stable")
            ranks = np.empty(len(order), np.int64)
            ranks[order] = np.arange(len(order))
            tokens[inner] = ranks[places] + 1
            words = np.append(np.uint64(END), distinct[order])
            row = (
                chunk, batch.column("doc_id").slice(at, n).to_pylist(), batch.column("held_out").slice(at, n).to_pylist(),
                np.diff(bounds).tolist(), words.tobytes(), _squeeze(tokens),
            )
            yield batch_of(_CHUNK, {name: [x] for name, x in zip(_CHUNK.names, row, strict=True)})
            chunk, at = chunk + 1, at + n


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _by_row(run):
    """``run`` on one row after the other; memory is given back before the next one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield run(row)
            trim()

    return rows


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, of one length, byte by byte (the lowest of all first), compressed."""
    widths, planes = [], []
    for x in columns:
        widths.append(max(1, (int(x.max(initial=0)).bit_length() + 7) // 8))
        planes.append(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : widths[-1]].T).tobytes())
    head = np.array([len(columns), len(columns[0]), *widths], "<i8").tobytes()
    return head + pa.Codec("zstd", compression_level=1).compress(b"".join(planes) or b"\0", asbytes=True)


def _opened(packed: bytes) -> list[np.ndarray]:
    """The columns of :func:`_squeeze`, of 32 bits where three bytes hold them."""
    n_columns, n = np.frombuffer(packed, "<i8", 2).tolist()
    widths = np.frombuffer(packed, "<i8", n_columns, 16).tolist()
    body = pa.Codec("zstd").decompress(packed[16 + 8 * n_columns :], max(1, n * sum(widths)), asbytes=True)
    columns, at = [], 0
    for width in widths:
        size = 4 if width < 4 else 8
        wide = np.zeros((n, size), np.uint8)
        wide[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        columns.append(wide.view(f"<i{size}").ravel())
        at += n * width
    return columns


def _trimmed(run):
    """``run``, of two arguments, and memory given back after each group or chunk."""

    @wraps(run)
    def trimmed(one, two):
        found = run(one, two)
        trim()
        return found

    return trimmed


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=0)


def _segments(groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by group, and of each group its number, start and end in that order."""
    order = np.argsort(groups, kind="stable")
    ranked = groups[order]
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    ends = np.append(edges, len(ranked))[1:]
    return order, [(int(ranked[a]), int(a), int(b)) for a, b in zip(edges, ends, strict=True)]


#: A chunk's question to a group, or a group's answer to a chunk.
_NOTE = pa.schema([("group", pa.int64()), ("chunk", pa.int64()), ("packed", pa.binary())])
_NOTE_DDL = "group long, chunk long, packed binary"


def _notes(chunk: int, segments: list[tuple[int, int, int]], packed: list[bytes]) -> pa.RecordBatch:
    return batch_of(_NOTE, {"group": [g for g, _, _ in segments], "chunk": [chunk] * len(segments), "packed": packed})


def _word_groups(words: np.ndarray, groups: int) -> np.ndarray:
    return (mix(words.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _uses(groups: int):
    """Each chunk's words and how often they occur in its training documents."""

    def run(row: dict) -> pa.RecordBatch:
        words, tokens = np.frombuffer(row["words"], np.int64), _opened(row["tokens"])[0]
        train = np.repeat(~np.array(row["held_out"], bool), row["lengths"])
        n = np.bincount(tokens[train], minlength=len(words))
        places, segments = _segments(_word_groups(words, groups))
        words, n = words[places].view(np.uint64), n[places]
        return _notes(row["chunk"], segments, [_squeeze(_steps(places[a:b]), words[a:b], n[a:b]) for _, a, b in segments])

    return _by_row(run)


_COUNTED = pa.schema([("chunk", pa.int64()), ("code", pa.int64()), ("number", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])
_COUNTED_DDL = "chunk long, code long, number long, n long, packed binary"


def _count_group(groups: int):
    """All uses of the words of one group: a row for each word of the training documents, and for each
    chunk the places, numbers and counts (0: unknown) of its words in one binary."""

    @_trimmed
    def run(key: tuple, uses: pa.Table) -> pa.Table:
        group = key[0].as_py()
        asked = [_opened(x) for x in uses.column("packed").to_pylist()]
        ends = np.cumsum([len(x) for x, _, _ in asked])
        words, inverse = np.unique(np.concatenate([x for _, x, _ in asked]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([n for _, _, n in asked]), minlength=len(words)).astype(np.int64)
        order = np.lexsort((words, -total))
        number = np.empty(len(words), np.int64)
        number[order] = np.arange(len(words)) * groups + group + BEGIN + 1
        known = total > 0
        number[~known] = 0
        answers = [_squeeze(steps, number[x], total[x]) for (steps, _, _), x in zip(asked, np.split(inverse, ends[:-1]), strict=True)]
        none, own = int(known.sum()), len(answers)
        return pa.table(
            {
                "chunk": pa.array([None] * none + uses.column("chunk").to_pylist(), pa.int64()),
                "code": pa.array(words[known].tolist() + [None] * own, pa.int64()),
                "number": pa.array(number[known].tolist() + [None] * own, pa.int64()),
                "n": pa.array(total[known].tolist() + [None] * own, pa.int64()),
                "packed": pa.array([None] * none + answers, pa.binary()),
            },
            schema=_COUNTED,
        )

    return run


_CODED = pa.schema([*(f for f in _CHUNK if f.name != "words"), ("words", pa.binary())])
_CODED_DDL = "chunk long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, tokens binary, words binary"


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the documents' values; each has one token at least."""
    return np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


@_trimmed
def _code(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """A chunk with the numbers and counts (0: unknown) of its words."""
    row = chunk.to_pylist()[0]
    numbers, counts = (np.zeros(int(_opened(row["tokens"])[0].max(initial=-1)) + 1, np.int64) for _ in range(2))
    for packed in answers.column("packed").to_pylist():
        steps, number, n = _opened(packed)
        places = np.cumsum(steps)
        numbers[places], counts[places] = number, n
    return pa.Table.from_pylist([row | {"words": _squeeze(numbers, counts)}], _CODED)


def _pairs_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """History and word number of every token (-1: unknown), the bounds of the documents, and the count
    of every token's word."""
    tokens = _opened(row["tokens"])[0]
    numbers, counts = _opened(row["words"])
    numbers[counts == 0] = -1
    numbers, counts = numbers[tokens], counts[tokens]
    bounds = np.append(0, np.cumsum(row["lengths"])).astype(np.int64)
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[bounds[:-1]] = BEGIN
    return before, numbers, bounds, counts


def _distinct(before: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one token of each distinct pair, in order of the pairs, and the pair of each token."""
    if max(before.max(initial=0), numbers.max(initial=0)) < 1 << 31:
        pairs = before.astype(np.int64) << 32
        pairs |= numbers
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        new = pairs[1:] != pairs[:-1]
    else:
        order = np.lexsort((numbers, before))
        a, b = before[order], numbers[order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = np.append(True, new) if len(order) else np.zeros(0, bool)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


class _Known:
    """The distinct pairs of known words of a chunk, and the groups that count them."""

    def __init__(self, row: dict, groups: int, n_starts: int):
        self.before, self.numbers, self.bounds, self.counts = _pairs_of(row)
        #: How often the history of each token occurs in training.
        self.n_before = np.append(0, self.counts[:-1])
        self.n_before[self.bounds[:-1]] = n_starts
        #: Tokens of such pairs, the pair of each, and a token of each pair.
        self.at = np.flatnonzero((self.before >= 0) & (self.numbers >= 0))
        first, self.pair = _distinct(self.before[self.at], self.numbers[self.at])
        self.first = self.at[first]
        word = self.numbers[self.first].astype(np.uint64)
        spread = mix(word) % (1 + self.n_before[self.first] // HOT_HISTORY).astype(np.uint64)
        group = mix(mix(self.before[self.first].astype(np.uint64)) + spread) % np.uint64(groups)
        self.order, self.segments = _segments(group.astype(np.int64))


def _ask_pairs(groups: int, n_starts: int):
    """Each chunk's distinct pairs of known words, with their counts in its training documents, and the
    count of the second word where that is not 0."""

    def run(row: dict) -> pa.RecordBatch:
        known = _Known(row, groups, n_starts)
        train = np.repeat(~np.array(row["held_out"], bool), row["lengths"])[known.at]
        n = np.bincount(known.pair[train], minlength=len(known.first))
        one, two = known.before[known.first], known.numbers[known.first]
        columns = [x[known.order] for x in (one, two, n, np.where(n > 0, known.counts[known.first], 0))]
        packed = []
        for _, a, b in known.segments:
            one, *others = (x[a:b] for x in columns)
            packed.append(_squeeze(_steps(one), *others))
        return _notes(row["chunk"], known.segments, packed)

    return _by_row(run)


_TOLD = pa.schema([*_NOTE, ("spectrum", pa.list_(pa.int64()))])
_TOLD_DDL = f"{_NOTE_DDL}, spectrum array<long>"


@_trimmed
def _count_pairs(key: tuple, asked: pa.Table) -> pa.Table:
    """All pairs of one group. A row without a chunk is the group's part of the model: pairs, their counts and
    those of their second words; ``spectrum`` is how many pairs have each low count. The others tell each chunk
    the counts of its pairs (0: not in the model)."""
    parts = [_opened(x.as_py()) for x in asked.column("packed")]
    ends = np.cumsum([len(x[0]) for x in parts])
    before = np.concatenate([np.cumsum(x[0]) for x in parts])
    word, n, n_word = (np.concatenate([x[i] for x in parts]) for i in (1, 2, 3))
    del parts
    first, pair = _distinct(before, word)
    total = np.bincount(pair, weights=n, minlength=len(first)).astype(np.int64)
    word_total = np.zeros(len(first), np.int64)
    word_total[pair[n > 0]] = n_word[n > 0]
    spectrum = np.bincount(np.minimum(total, GOOD_TURING + 2), minlength=GOOD_TURING + 2)[1 : GOOD_TURING + 2]
    total[total < CUTOFF] = 0
    seen = total > 0
    model = _squeeze(_steps(before[first][seen]), word[first][seen], total[seen], word_total[seen])
    told = [_squeeze(total[x]) for x in np.split(pair, ends[:-1])]
    return pa.table(
        {
            "group": pa.array([key[0].as_py()] * (1 + len(told)), pa.int64()),
            "chunk": pa.array([None, *asked.column("chunk").to_pylist()], pa.int64()),
            "packed": pa.array([model, *told], pa.binary()),
            "spectrum": pa.array([spectrum.tolist()] + [None] * len(told), pa.list_(pa.int64())),
        },
        schema=_TOLD,
    )


_MASS = pa.schema([("before", pa.int64()), ("kept", pa.float64()), ("lower", pa.float64())])


def _masses(corpus: Corpus, shares: dict[int, float]):
    """Of each history in a part of the model: what remains of its counts, and its words' unigram probability."""
    n_tokens, word_shares = max(corpus.n_tokens, 1), corpus.shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            steps, _, n, n_word = _opened(row["packed"])
            if len(steps):
                before = np.cumsum(steps)
                edges = np.flatnonzero(np.append(True, steps[1:] != 0))
                sums = [np.add.reduceat(x, edges) for x in (discounted(n, shares), discounted(n_word, word_shares) / n_tokens)]
                yield batch_of(_MASS, {"before": before[edges], "kept": sums[0], "lower": sums[1]})

    return run


_PAIRS = pa.schema([("before", pa.int64()), ("word", pa.int64()), ("value", pa.float64())])


def _model_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        steps, word, n, _ = _opened(row["packed"])
        yield batch_of(_PAIRS, {"before": np.cumsum(steps), "word": word, "value": n.astype(float)})


def _histories(row: dict, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """A chunk's known histories, the tokens' places among them (one more: unknown), and their groups, which are
    those of the words (the start has that of the last)."""
    before, _, _, _ = _pairs_of(row)
    known, places = np.unique(np.append(before, -1), return_inverse=True)
    known, places = known[1:], places[:-1] - 1
    return known, np.where(places < 0, len(known), places), *_segments((known - 1) % groups)


def _ask_weights(groups: int):
    def run(row: dict) -> pa.RecordBatch:
        known, _, order, segments = _histories(row, groups)
        return _notes(row["chunk"], segments, [_squeeze(_steps(known[order[a:b]])) for _, a, b in segments])

    return _by_row(run)


def _tell_weights(key: tuple, asked: pa.Table, weights: pa.Table) -> pa.Table:
    """The weights of the histories that each chunk asks for; a history of the model has one."""
    trim()
    before, value = (weights.column(n).to_numpy() for n in ("before", "value"))
    order = np.argsort(before)
    before, value = before[order], value[order]
    told = []
    for packed in asked.column("packed").to_pylist():
        wanted = np.cumsum(_opened(packed)[0])
        place = np.minimum(np.searchsorted(before, wanted), max(len(before) - 1, 0))
        told.append(np.where(before[place] == wanted, value[place], 0.0).tobytes() if len(before) else np.zeros(len(wanted)).tobytes())
    return pa.table({"group": asked.column("group"), "chunk": asked.column("chunk"), "packed": pa.array(told, pa.binary())}, schema=_NOTE)


_SCORED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_score", pa.float64()),
        ("score", pa.float64()),
    ]
)
_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _answer(corpus: Corpus, shares: dict[int, float], pair_groups: int):
    """Scores of a chunk's documents from the model's answers."""
    n_tokens, n_words, word_shares, log_unknown = corpus.n_tokens, corpus.n_words, corpus.shares, corpus.log_unknown
    groups, n_starts = corpus.groups, corpus.n_starts

    @_trimmed
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        told = {(a["weights"], a["group"]): a["packed"] for a in answers.to_pylist()}
        pairs = _Known(row, pair_groups, n_starts)
        by_pair = np.zeros(len(pairs.first), np.int64)
        for group, a, b in pairs.segments:
            by_pair[pairs.order[a:b]] = _opened(told[False, group])[0]
        known, places, order, segments = _histories(row, groups)
        by_history = np.zeros(len(known) + 1)
        for group, a, b in segments:
            by_history[order[a:b]] = np.frombuffer(told[True, group])
        counts, bounds = pairs.counts, pairs.bounds
        log_word = np.full(len(counts), log_unknown)
        heard = counts > 0
        log_word[heard] = np.log10(discounted(counts[heard], word_shares) / max(n_tokens, 1))
        pair = np.zeros(len(counts), np.int64)
        pair[pairs.at] = by_pair[pairs.pair]
        score, seen = by_history[places] + log_word, pair > 0
        score[seen] = np.log10(discounted(pair[seen], shares) / pairs.n_before[seen])
        base = np.log10((counts + 0.5) / (n_tokens + 0.5 * (n_words + 1)))
        out = {
            "doc_id": row["doc_ids"],
            "held_out": row["held_out"],
            "n_tokens": row["lengths"],
            "n_known": _sums(heard.astype(np.int64), bounds),
            "base_score": _sums(base, bounds),
            "score": _sums(score, bounds),
        }
        return pa.Table.from_batches([batch_of(_SCORED, out)])

    return run


def discounts(counts_of_counts: dict[int, int], k: int = GOOD_TURING) -> dict[int, float]:
    """What remains of a count r up to k, as a share of it (Katz's form of Good-Turing).

    A count whose estimate is not between 0 and 1 keeps its whole.
    """
    n = {r: counts_of_counts.get(r, 0) for r in range(1, k + 2)}
    cut = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    found = {}
    for r in range(1, k + 1):
        share = 1.0
        if n[r] and n[1] and cut < 1:
            share = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
        found[r] = share if 0 < share < 1 else 1.0
    return found


def discounted(counts: np.ndarray, shares: dict[int, float]) -> np.ndarray:
    """What remains of counts; ``_discounted`` is the same as an expression."""
    share = np.ones(max([0, *shares]) + 2)
    share[list(shares)] = list(shares.values())
    n = np.asarray(counts, float)
    return np.minimum(share[np.minimum(n, len(share) - 1).astype(np.int64)] * n, n - LEAST)


def _discounted(count: Column, shares: dict[int, float]) -> Column:
    share = F.lit(1.0)
    for r, s in shares.items():
        share = F.when(count == r, F.lit(s)).otherwise(share)
    return F.least(share * count, count - F.lit(LEAST))


@dataclass(frozen=True)
class Corpus:
    """Counts of the training documents: ``words`` (code, number, n, p_word) and totals."""

    words: DataFrame
    #: Groups in which the words were counted.
    groups: int
    n_tokens: int
    n_words: int
    #: Training documents, which is how often the start is a history.
    n_starts: int
    shares: dict[int, float]
    log_unknown: float


@dataclass(frozen=True)
class Model:
    """Counted pairs: ``parts`` (group, packed: one row a group), ``weights`` of histories (before, value), the
    discounts of counts, and ``told``, the counts for each chunk."""

    parts: DataFrame
    weights: DataFrame
    shares: dict[int, float]
    told: DataFrame
    groups: int

    def rows(self) -> DataFrame:
        """``before, word, value``: counts of pairs, and weights of histories with word -1."""
        pairs = self.parts.select("packed").mapInArrow(_model_rows, "before long, word long, value double")
        return pairs.unionByName(self.weights.select("before", F.lit(WEIGHT).cast("long").alias("word"), "value"))


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of all documents, with the fold of each."""
    rows = text_rows(docs, id_col, text_col).withColumn("held_out", bucket("doc_id", FOLDS) == HELD_OUT)
    return written(rows.mapInArrow(_tokenize, _CHUNK_DDL), "chunks")


def count_words(chunks: DataFrame) -> tuple[Corpus, DataFrame]:
    """Counts, numbers and unigram probabilities of the words of all training documents, and what the
    chunks need to know of them (``chunk, packed``)."""
    n_uses = chunks.agg(F.coalesce(F.sum(F.length("words") / 8), F.lit(0))).first()[0]
    groups = int(n_uses // GROUP_USES) + 1
    uses = chunks.mapInArrow(_uses(groups), _NOTE_DDL)
    counted = written(uses.groupBy("group").applyInArrow(_count_group(groups), _COUNTED_DDL), "words")
    words = counted.filter("chunk is null").select("code", "number", "n")
    spectrum = {r["n"]: r["count"] for r in words.filter(f"n <= {GOOD_TURING + 1}").groupBy("n").count().collect()}
    n_tokens, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    shares = discounts(spectrum)
    p_word = _discounted(F.col("n"), shares) / F.lit(max(n_tokens, 1))
    words = words.withColumn("p_word", p_word)
    known = words.agg(F.coalesce(F.sum("p_word"), F.lit(0.0))).first()[0]
    log_unknown = float(np.log10(max(1 - known, 1e-300))) if n_words else 0.0
    n_starts = words.filter(F.col("code") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    corpus = Corpus(words, groups, n_tokens, n_words, n_starts, shares, log_unknown)
    return corpus, counted.filter("chunk is not null").select("chunk", "packed")


def number_chunks(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Chunks with the numbers and counts of their words instead of the words."""
    coded = chunks.drop("words").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_code, _CODED_DDL)
    return written(coded, "coded")


def train(corpus: Corpus, coded: DataFrame) -> Model:
    """The model of all training documents."""
    tokens = coded.agg(F.coalesce(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")), F.lit(0))).first()[0]
    groups = int(tokens // GROUP_TOKENS) + 1
    asked = coded.mapInArrow(_ask_pairs(groups, corpus.n_starts), _NOTE_DDL)
    counted = written(asked.groupBy("group").applyInArrow(_count_pairs, _TOLD_DDL), "pairs")
    parts = counted.filter("chunk is null")
    low = [F.coalesce(F.sum(F.col("spectrum")[r - 1]), F.lit(0)) for r in range(1, GOOD_TURING + 2)]
    shares = discounts(dict(enumerate(parts.agg(*low).first(), 1)))
    # A history occurs as often as the word; the start as often as the end.
    start = F.when(F.col("code") == END, F.lit(BEGIN)).otherwise(F.col("number"))
    histories = corpus.words.select(start.cast("long").alias("before"), F.col("n").alias("n_before"))
    masses = parts.select("packed").mapInArrow(_masses(corpus, shares), "before long, kept double, lower double")
    masses = masses.groupBy("before").agg(F.sum("kept").alias("kept"), F.sum("lower").alias("lower"))
    weight = F.log10((1 - F.col("kept") / F.col("n_before")) / (1 - F.col("lower")))
    weights = written(masses.join(histories, "before").select("before", weight.alias("value")), "weights")
    return Model(parts.select("group", "packed"), weights, shares, counted.filter("chunk is not null").select("group", "chunk", "packed"), groups)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    chunks = tokenize(docs, id_col, text_col)
    corpus, answers = count_words(chunks)
    coded = number_chunks(chunks, answers)
    release(chunks)
    model = train(corpus, coded)
    asked = coded.mapInArrow(_ask_weights(corpus.groups), _NOTE_DDL)
    weights = model.weights.withColumn("group", F.pmod(F.col("before") - 1, F.lit(corpus.groups)).cast("long"))
    weights = asked.groupBy("group").cogroup(weights.groupBy("group")).applyInArrow(_tell_weights, _NOTE_DDL)
    told = model.told.withColumn("weights", F.lit(False)).unionByName(weights.withColumn("weights", F.lit(True)))
    found = coded.groupBy("chunk").cogroup(told.groupBy("chunk"))
    scored = found.applyInArrow(_answer(corpus, model.shares, model.groups), _SCORED_DDL)
    train_tokens = F.lit(corpus.n_tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens, "base_score", "score")
