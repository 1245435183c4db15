"""Language-model scoring by a weighted backoff automaton.

Tokens are words at ASCII blanks, A-Z lower-cased, and an end mark after each text. The vocabulary is
closed: the words of the training documents and one unknown word. Every n-gram of the training documents
up to three tokens is a state or an arc, none is left out for being rare or for want of room:

* the last two tokens are the state, if they stood together in training; it has an arc for every token that followed them there;
* the last token is the state below, the end mark being the one in which a text starts; it has an arc for every token that followed it;
* the root has an arc for every word, the unknown one included.

A failure arc leads from a state to the one below. With c the count of a state and m the mean number of different tokens behind
states of its order whose counts have as many binary digits (a statistic of all training documents), its weight is m / (c + m), and the arc of a token seen n times there
weighs (n + m * p) / (c + m), p being the token's probability below. So a state's probabilities add up to one. The root's arcs are
(n + V / (V + 1)) / (N + V) of N tokens of V kinds. Each slice builds the states and arcs that its texts can reach, and one traversal from left
to right carries the state, follows failure arcs until the token has an arc, and adds up log10 weights. All texts of a slice advance
together, a token a step. A text of more than `PIECE` tokens goes in pieces that start two tokens early at the root: after two
tokens the state is the same, as no state is longer.

Counts may be of any number, so they are never broadcast. Documents are dealt into slices of about `slice_bytes` bytes. Each slice brings
its words and pairs, as sorted hashes with its own counts, to the owners of ranges of hashes; an owner adds up and tells each
slice the sums of what another slice has, too. A task takes several slices or owners, one after another, where there are more than `most_tasks`. Then triples go the same way, but only those whose two pairs are in another slice, too: all
others are counted where they are. Hashes of words have 64 bits, those of pairs and triples 20 bits more than it takes to number
all tokens, so that less than one n-gram in a million shares a hash. Statistics are summed up in groups of about the square root of the number of owners,
then to one row for each round, and joined to the last.

Defined results: doc_id is a long (anything that cannot be cast to it is an error); a null text counts as empty (its end is still a token); a
null doc_id is training text; repeated rows each count and each get a row, and are dealt by the partition they come from, too; a very
long text is in one slice; with no training text every word has probability one; an empty table gives none; other columns are left out.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import session_ready, table, training_bucket

MODULUS, HELD_OUT = 7, 2
#: The end mark is written as the word of no bytes.
END = b""
#: Bytes of text of one slice, and bits of an n-gram's hash beyond those that number all tokens.
SLICE_BYTES, SPARE_BITS = 8 << 20, 20
#: Tasks of a stage at most, and tokens that the traversal takes in one piece.
MOST_TASKS, PIECE = 1 << 14, 256
#: Classes of counts: by number of binary digits.
CLASSES = 48
#: Odd multipliers, derived from the golden ratio's fraction.
_MIX = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in (1, 3, 5)]
_HEAD = struct.Struct("<IBQ")


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of one n-gram followed by a word, from the hashes of both."""
    h = a * _MIX[0] + b
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(29))


def packed_counts(counts: np.ndarray) -> bytes:
    """A byte each, larger ones behind."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked_counts(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(data, "<i8", int(large.sum()), n)
    return counts


def packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted codes by their differences, and counts."""
    if not len(codes):
        return b""
    steps = np.diff(codes, prepend=codes[:1])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return _HEAD.pack(len(codes), width, int(codes[0])) + zstandard.compress(planes.tobytes() + packed_counts(counts), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    n, width, first = _HEAD.unpack_from(data)
    body = zstandard.decompress(data[_HEAD.size :])
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.frombuffer(body, np.uint8, n * width).reshape(width, n).T
    codes = np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) + np.uint64(first)
    return codes, unpacked_counts(body[n * width :], n)


def classes(counts: np.ndarray) -> np.ndarray:
    """Number of binary digits of each count."""
    return np.frexp(counts.astype(np.float64))[1]


def by_class(counts: np.ndarray) -> np.ndarray:
    return np.bincount(classes(counts), minlength=CLASSES)


def ranges(codes: np.ndarray, owners: int, bits: int) -> np.ndarray:
    """Where each owner's share of sorted codes begins, and the end."""
    bounds = np.array([(k << bits) // owners for k in range(1, owners)], np.uint64)
    return np.concatenate(([0], np.searchsorted(codes, bounds), [len(codes)]))


def untold(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of n codes: whether another slice has it, whether this slice counts it as a kind, and the sums of those that another has."""
    size = -(-n // 8)
    flags = [np.unpackbits(np.frombuffer(data, np.uint8, size, k * size), count=n).astype(bool) for k in (0, 1)]
    return *flags, unpacked_counts(data[2 * size :], int(flags[0].sum()))


class Grams:
    """The distinct codes of places of a slice, sorted, with the place each is at and the slice's own training counts."""

    def __init__(self, codes: np.ndarray, learned: np.ndarray):
        order = np.argsort(codes)
        ordered = codes[order]
        new = np.ones(len(codes), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.codes, self.first = ordered[new], order[new]
        self.at = np.empty(len(codes), np.int32)
        self.at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.own = np.bincount(self.at[learned], minlength=len(self.codes))
        self.sums = self.own.copy()
        #: Codes that another slice has, too, and those that this slice counts among the kinds.
        self.shared = np.zeros(len(self.codes), bool)
        self.speaks = self.own > 0

    def told(self, answers: dict[int, bytes], owners: int, bits: int, wanted: np.ndarray | None = None) -> None:
        """Take the sums that owners told."""
        places = np.arange(len(self.codes)) if wanted is None else np.flatnonzero(wanted)
        cuts = ranges(self.codes[places], owners, bits)
        for owner, data in answers.items():
            mine = places[cuts[owner] : cuts[owner + 1]]
            if len(mine):
                self.shared[mine], self.speaks[mine], sums = untold(data, len(mine))
                self.sums[mine[self.shared[mine]]] = sums


class Slice:
    """Tokens, words, pairs and triples of a slice's texts, numbered by content alone, so that every pass numbers alike."""

    def __init__(self, texts: pa.Array, held: np.ndarray, bits: int):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = lists.flatten()
        full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        before = np.concatenate(([0], np.cumsum(full)))[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))]
        sizes = np.diff(before)
        named = words.filter(pa.array(full)).dictionary_encode()
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in (END, *named.dictionary.cast(pa.binary()).to_pylist())], np.uint64)
        self.words = np.unique(hashes)
        number = np.searchsorted(self.words, hashes)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.flat = np.full(len(named) + len(sizes), number[0], np.int32)
        inner = np.ones(len(self.flat), bool)
        inner[self.ends] = False
        self.flat[inner] = number[1:][named.indices.to_numpy()]
        # Each text ends with the end mark, in which the next starts.
        self.before = np.concatenate((number[:1].astype(np.int32), self.flat[:-1]))[: len(self.flat)]
        self.learned = np.repeat(~held, sizes + 1)
        self.words_own = np.bincount(self.flat[self.learned], minlength=len(self.words))
        self.counts = self.words_own.copy()
        self.cut = np.uint64(64 - bits)
        self.whole = joined(self.words[self.before], self.words[self.flat])
        self.pairs = Grams(self.whole >> self.cut, self.learned)

    def told(self, words: dict[int, bytes], pairs: dict[int, bytes], owners: int, bits: int) -> None:
        cuts = ranges(self.words, owners, 64)
        for owner, data in words.items():
            mine = np.arange(cuts[owner], cuts[owner + 1])
            shared, _, sums = untold(data, len(mine))
            self.counts[mine[shared]] = sums
        self.pairs.told(pairs, owners, bits)

    def close(self) -> Slice:
        """Number the triples: those of all places but the first of each text."""
        inside = np.ones(len(self.flat), bool)
        inside[self.starts] = False
        self.third = np.flatnonzero(inside)
        self.triples = Grams(joined(self.whole[self.third - 1], self.words[self.flat[self.third]]) >> self.cut, self.learned[self.third])
        del self.whole  # no round needs it any more
        # Another slice can only have a triple, in training text or not, if it has both its pairs.
        place = self.third[self.triples.first]
        self.wanted = self.pairs.shared[self.pairs.at[place]] & self.pairs.shared[self.pairs.at[place - 1]]
        return self

    def statistics(self) -> np.ndarray:
        """Kinds behind one-word states, two-word states, and kinds behind these as far as they are counted here, by class of the state's count."""
        pairs, triples = self.pairs, self.triples
        second = self.flat[pairs.first]
        speaks, local = pairs.speaks, ~self.wanted & (triples.own > 0)
        behind = by_class(self.counts[self.before[pairs.first[speaks]]])
        states = by_class(pairs.sums[speaks & (second != self.flat[self.ends[0]])])
        return np.concatenate((behind, states, by_class(self.histories()[local])))

    def histories(self) -> np.ndarray:
        """Counts of the first two tokens of each triple."""
        return self.pairs.sums[self.pairs.at[self.third[self.triples.first] - 1]]



class Automaton:
    """The states and arcs that a slice's texts can reach. States by number: the root, then words, then pairs; those not
    seen in training are never reached. The root has an arc for each token, arcs of other states are found by hash."""

    def __init__(self, mine: Slice, tokens: int, kinds: int, ones: np.ndarray, twos: np.ndarray):
        """ones and twos: mean number of kinds behind states of one and two words, by class."""
        self._build(mine, tokens, kinds, ones, twos)
        self._index()

    def _build(self, mine: Slice, tokens: int, kinds: int, ones: np.ndarray, twos: np.ndarray) -> None:
        pairs, triples = mine.pairs, mine.triples
        self.width = len(mine.words)
        states = np.arange(1 + self.width + len(pairs.codes), dtype=np.int32)
        word_states, pair_states = states[1 : self.width + 1], states[self.width + 1 :]
        first, second = mine.before[pairs.first], mine.flat[pairs.first]
        word_mean, pair_mean = ones[classes(mine.counts)], twos[classes(pairs.sums)]
        self.fail = np.concatenate((np.zeros(self.width + 1, np.int32), word_states[second]))
        self.fail_weight = np.log10(np.concatenate(([1.0], word_mean / (mine.counts + word_mean), pair_mean / (pairs.sums + pair_mean))))
        # After a token the state is its pair with the token before, if that was seen, else the token, else the root.
        after_word = np.where(mine.counts > 0, word_states, 0)
        self.start = after_word[mine.flat[mine.ends[0]]]
        root = (mine.counts + kinds / (kinds + 1)) / (tokens + kinds)
        one = (pairs.sums + word_mean[first] * root[second]) / (mine.counts[first] + word_mean[first])
        seen = np.flatnonzero(pairs.sums > 0)
        seen_thrice = np.flatnonzero(triples.sums > 0)
        place = mine.third[triples.first[seen_thrice]]
        history, inner = pairs.at[place - 1], pairs.at[place]
        two = (triples.sums[seen_thrice] + pair_mean[history] * one[inner]) / (pairs.sums[history] + pair_mean[history])
        self.keys = np.concatenate((self._key(states[:1], states[: self.width]), self._key(word_states[first[seen]], second[seen]), self._key(pair_states[history], mine.flat[place])))
        self.weight = np.log10(np.concatenate((root, one[seen], two)))
        self.target = np.concatenate((after_word, pair_states[seen], pair_states[inner]))

    def _key(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return state * np.int64(self.width) + token

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX[0]) >> self.cut).view(np.int64)

    def _index(self) -> None:
        """Each arc has the first free slot from its hash on; at most half of the slots are taken."""
        bits = (2 * len(self.keys)).bit_length()
        self.cut, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        rest = np.arange(self.width, len(self.keys), dtype=np.int32)  # the root's need none
        slot = self._slot(self.keys[rest])
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            lost = self.slots[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & self.last

    def arcs(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Each state's arc for the token, -1 where there is none."""
        found = np.where(state == 0, token, -1)
        rest = np.flatnonzero(state)
        key = self._key(state[rest], token[rest])
        slot = self._slot(key)
        while len(rest):
            arc = self.slots[slot]
            same = self.keys[arc] == key
            same &= arc >= 0
            found[rest[same]] = arc[same]
            on = (arc >= 0) & ~same
            rest, key, slot = rest[on], key[on], (slot[on] + 1) & self.last
        return found

    def follow(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log10 weight of what is followed from each state until the token has an arc; state becomes what that leads to."""
        weight = np.zeros(len(state))
        rest = np.arange(len(state))
        while len(rest):
            arc = self.arcs(state[rest], token[rest])
            found = arc >= 0
            there, arc, rest = rest[found], arc[found], rest[~found]
            weight[there] += self.weight[arc]
            state[there] = self.target[arc]
            weight[rest] += self.fail_weight[state[rest]]
            state[rest] = self.fail[state[rest]]
        return weight

    def traverse(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int | None = None) -> np.ndarray:
        """Log10 probability of each text, flat[start] to flat[end] included."""
        piece = piece or PIECE
        parts = (ends - starts) // piece + 1
        text = np.repeat(np.arange(len(starts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = starts[text] + nth * piece
        early = np.where(nth > 0, 2, 0)
        size = np.minimum(piece, ends[text] - begin + 1) + early
        order = np.argsort(-size, kind="stable")
        text, size, begin, early = text[order], size[order], (begin - early)[order], early[order]
        state = np.where(early > 0, 0, self.start).astype(np.int32)
        total = np.zeros(len(text))
        alive = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
        for t, n in enumerate(alive.tolist()):
            total[:n] += self.follow(state[:n], flat[begin[:n] + t]) * (t >= early[:n])
        return np.bincount(text, total, len(starts))


def means(kinds: np.ndarray, states: np.ndarray) -> np.ndarray:
    """Mean number of kinds by class; one where there is no state, so that its failure arc weighs nothing."""
    return np.where(states > 0, np.maximum(kinds, 1e-9) / np.maximum(states, 1), 1.0)


_ASK = "owner int, slice int, words binary, grams binary, marks binary, statistics binary, passed binary"
#: Statistics are told to slices below zero.
_TELL = "slice int, owner int, words binary, grams binary, statistics binary, passed binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), types, strict=True)], names=list(names))


def _added(asked: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """What slices brought to one owner: where each distinct code comes first, its sum over slices, and what each slice is told."""
    parts = [unpacked(x) for x in asked]
    _, first, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_index=True, return_inverse=True)
    own = np.concatenate([n for _, n in parts])
    sums = np.zeros(len(first), np.int64)
    np.add.at(sums, inverse, own)
    shared = np.bincount(inverse, minlength=len(sums)) > 1
    # The first slice to have a code in training text speaks for it.
    speaker = np.full(len(first), -1)
    trained = np.flatnonzero(own > 0)[::-1]
    speaker[inverse[trained]] = trained
    answers, at = [], 0
    for codes, _ in parts:
        mine = inverse[at : at + len(codes)]
        speaks = speaker[mine] == np.arange(at, at + len(codes))
        flags = shared[mine]
        answers.append(np.packbits(flags).tobytes() + np.packbits(speaks).tobytes() + packed_counts(sums[mine[flags]]))
        at += len(codes)
    return first, sums, answers


def _owned(third: bool, groups: int):
    def answer(batches):
        """Rows come owner by owner."""
        held: list[dict] = []

        def told() -> pa.RecordBatch:
            first, sums, grams = _added([r["grams"] for r in held])
            if third:
                words = [b""] * len(held)
                marks = np.concatenate([np.frombuffer(r["marks"], np.uint8) for r in held])
                found = np.zeros(3 * CLASSES, np.int64)
                found[2 * CLASSES :] = np.bincount(marks[first[sums > 0]], minlength=CLASSES)
                found += sum(np.frombuffer(r["statistics"], np.int64) for r in held if r["statistics"])
            else:
                _, counts, words = _added([r["words"] for r in held])
                found = np.concatenate(([counts.sum()], by_class(counts[counts > 0])))
            out = [(r["slice"], r["owner"], w, g, b"", r["passed"]) for r, w, g in zip(held, words, grams, strict=True)]
            return _rows(_TELL, [*out, (-1 - held[0]["owner"] % groups, held[0]["owner"], b"", b"", found.astype(np.int64).tobytes(), b"")])

        for b in batches:
            for r in b.to_pylist():
                if held and r["owner"] != held[-1]["owner"]:
                    yield told()
                    held = []
                held.append(r)
        if held:
            yield told()

    return answer


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slice_bytes: int = SLICE_BYTES, most_tasks: int = MOST_TASKS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    session_ready(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    n = max(1, -(-size // slice_bytes))
    tasks = min(n, most_tasks)
    bits = min(64, (size // 4 + 2).bit_length() + SPARE_BITS)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (training_bucket(doc_id, MODULUS) == HELD_OUT).alias("held_out"), F.col(text).cast("string").alias("text"))
    # Rows that repeat each other go to different slices, unless they come from one partition.
    spread = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int")).repartition(tasks, "slice")

    def sliced(rows: pa.Table) -> Slice:
        return Slice(rows.column("text").combine_chunks(), rows.column("held_out").to_numpy(), bits)

    def asked(where: int, words: tuple, grams: tuple, statistics: bytes = b"", passed: bytes = b"") -> pa.Table:
        """A row for each owner of any of these sorted codes; where there is something to pass on, one for owner `where`, too."""
        cuts, at = ranges(words[0], n, 64), ranges(grams[0], n, bits)
        filled = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(at) > 0)).tolist()
        rows = []
        for o in sorted({*filled, where}) if passed else filled:
            w, g = slice(cuts[o], cuts[o + 1]), slice(at[o], at[o + 1])
            rows.append((o, where, packed(words[0][w], words[1][w]), packed(grams[0][g], grams[1][g]), grams[2][g].tobytes(), statistics if o == where else b"", passed if o == where else b""))
        return pa.Table.from_batches([_rows(_ASK, rows)])

    none = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def ask(rows: pa.Table) -> pa.Table:
        mine = sliced(rows)
        return asked(rows.column("slice")[0].as_py(), (mine.words, mine.words_own), (mine.pairs.codes, mine.pairs.own, np.empty(0, np.uint8)))

    def resolved(rows: pa.Table, answers: list[dict]) -> Slice:
        mine = sliced(rows)
        mine.told({r["owner"]: r["words"] for r in answers if r["words"]}, {r["owner"]: r["grams"] for r in answers if r["grams"]}, n, bits)
        return mine.close()

    def ask_triples(key, rows: pa.Table, right: pa.Table) -> pa.Table:
        if not len(rows):  # the statistics' rows
            return pa.Table.from_batches([_rows(_ASK, [])])
        mine = resolved(rows, right.to_pylist())
        # What was told about words and pairs is passed on to the last round.
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, right.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(right)
        grams, at = mine.triples, mine.wanted
        return asked(key[0].as_py(), none, (grams.codes[at], grams.own[at], classes(mine.histories()[at]).astype(np.uint8)), mine.statistics().astype(np.int64).tobytes(), sink.getvalue().to_pybytes())

    def score(key, rows: pa.Table, right: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.Table.from_batches([], schema=_SCORES)
        answers = right.to_pylist()
        told = next(r for r in answers if r["passed"])
        mine = resolved(rows, pa.ipc.open_stream(told["passed"]).read_all().to_pylist())
        mine.triples.told({r["owner"]: r["grams"] for r in answers if r["grams"]}, n, bits, mine.wanted)
        tokens, *states = told["first"]
        behind = np.array(told["second"], np.float64).reshape(3, CLASSES)
        kinds = sum(states)
        automaton = Automaton(mine, tokens, kinds, means(behind[0], np.array(states)), means(behind[2], behind[1])) if tokens else None
        scores = automaton.traverse(mine.flat, mine.starts, mine.ends) if automaton else np.zeros(len(mine.starts))
        counts = mine.counts[mine.flat]
        summed = lambda x: np.add.reduceat(x, mine.starts)
        lengths = mine.ends - mine.starts + 1
        base = summed(np.log10(counts + 1)) - lengths * np.log10(tokens + kinds + 1)
        out = (lengths, summed((counts > 0).astype(np.int64)), np.full(len(lengths), tokens), base, scores)
        return pa.table([rows.column("doc_id"), rows.column("held_out"), *map(pa.array, out)], schema=_SCORES)

    def answers(asks: DataFrame, third: bool) -> DataFrame:
        return asks.repartition(tasks, "owner").sortWithinPartitions("owner").mapInArrow(_owned(third, math.isqrt(n) + 1), _TELL).repartition(tasks, "slice")

    def summed_up(answers: DataFrame, name: str) -> DataFrame:
        """One row of the statistics that owners told; it reads the exchange that the answers' next user reads."""

        def add(rows: pa.Table) -> pa.Table:
            found = [np.frombuffer(x, np.int64) for x in rows.column("statistics").to_pylist() if x]
            return pa.table({name: pa.array([np.sum(found, axis=0)] if found else [], pa.list_(pa.int64()))})

        def add_all(rows: pa.Table) -> pa.Table:
            return pa.table({name: pa.array([np.sum(rows.column(name).to_pylist(), axis=0)], pa.list_(pa.int64()))})

        schema = f"{name} array<bigint>"
        return answers.groupBy("slice").applyInArrow(add, schema).groupBy().applyInArrow(add_all, schema)

    # One exchange of the texts serves all three rounds.
    first = answers(spread.groupBy("slice").applyInArrow(ask, _ASK), False)
    second = answers(spread.groupBy("slice").cogroup(first.groupBy("slice")).applyInArrow(ask_triples, _ASK), True)
    told = second.crossJoin(F.broadcast(summed_up(first, "first"))).crossJoin(F.broadcast(summed_up(second, "second")))
    return spread.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


#: 3988292384 is CRC-32's polynomial, bits reversed.
ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '') AS w,
    coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7, 0) = 2 AS held_out
  FROM documents, crc
), tok AS (SELECT r, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS v, CASE WHEN i = 2 THEN '' WHEN i > 2 THEN w[i - 2] END AS u FROM (SELECT r, held_out, w, unnest(range(1, len(w) + 1)) AS i FROM doc)),
one AS (SELECT w, count(*) AS c, length(bin(count(*))) AS k FROM tok WHERE NOT held_out GROUP BY w),
two AS (SELECT v, w, count(*) AS c, length(bin(count(*))) AS k FROM tok WHERE NOT held_out GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS c FROM tok WHERE NOT held_out AND u IS NOT NULL GROUP BY u, v, w),
ones AS (SELECT k, coalesce(kinds, 1e-9) / states AS m FROM (SELECT k, count(*) AS states FROM one GROUP BY k) LEFT JOIN (SELECT one.k, count(*) AS kinds FROM two JOIN one ON two.v = one.w GROUP BY one.k) USING (k)),
twos AS (SELECT k, coalesce(kinds, 1e-9) / states AS m FROM (SELECT k, count(*) AS states FROM two WHERE w <> '' GROUP BY k) LEFT JOIN (SELECT two.k, count(*) AS kinds FROM three JOIN two ON three.u = two.v AND three.v = two.w GROUP BY two.k) USING (k)),
total AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS kinds FROM one),
root AS (SELECT tok.*, total.n, total.kinds, coalesce(one.c, 0) AS c, (coalesce(one.c, 0) + total.kinds / (total.kinds + 1)) / (total.n + total.kinds) AS p FROM tok LEFT JOIN one USING (w), total),
pair AS (SELECT root.*, coalesce(two.c, 0) AS c2, coalesce(s.c, 0) AS above, coalesce(ones.m, 1) AS m FROM root LEFT JOIN two ON root.v = two.v AND root.w = two.w LEFT JOIN one s ON root.v = s.w LEFT JOIN ones ON s.k = ones.k),
triple AS (SELECT pair.*, (c2 + pair.m * p) / (above + pair.m) AS p2, coalesce(three.c, 0) AS c3, coalesce(s.c, 0) AS above2, coalesce(twos.m, 1) AS m2
  FROM pair LEFT JOIN three ON pair.u = three.u AND pair.v = three.v AND pair.w = three.w LEFT JOIN two s ON pair.u = s.v AND pair.v = s.w LEFT JOIN twos ON s.k = twos.k),
told AS (SELECT r, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(n) AS train_tokens, round(sum(log10((c + 1) / (n + kinds + 1))), 6) AS base_score,
  round(sum(CASE WHEN n = 0 THEN 0 ELSE log10(CASE WHEN u IS NULL THEN p2 ELSE (c3 + m2 * p2) / (above2 + m2) END) END), 6) AS score FROM triple GROUP BY r)
SELECT doc_id, held_out, n_tokens, n_known, CAST(train_tokens AS BIGINT) AS train_tokens, base_score, score FROM doc JOIN told USING (r)
"""
