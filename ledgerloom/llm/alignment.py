"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the pairs that meet.

A text's tokens under a byte-level vocabulary (A) and under a piece vocabulary (B) spell the same bytes. Where a
token of each ends at one offset a group ends, and all A and B tokens of a group are linked. A pair of ids is packed
into one int64, A's id above B's.

Counting: each partition adds up its documents' distinct keys by np.unique, in bounded tables; the partial counts are
sorted globally by a range partitioning; each range is summed run by run as it streams by and becomes a shard, a file of
sorted keys followed by their counts. Looking up: shards are memory-mapped and searched by np.searchsorted, so a task
touches the pages it needs of a table whose size the two vocabularies bound, not the corpus.

Both vocabularies cut at a blank that follows something else than white space: no A word and no B piece runs across
it. So texts are cut there and each distinct chunk of a batch is encoded and aligned once, by array operations."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import SPACE, Table, Tokenizer
from ledgerloom.llm.shared import fresh_path, materialize, partitions, with_fields
from ledgerloom.llm.textkit import chunks, hash_sums, range_hashes, ranges

#: Chunks and their bytes that a worker keeps, and words and states of A's automaton; beyond, its tables start anew.
KEPT, KEPT_BYTES, KEPT_WORDS, STATES = 300_000, 1 << 23, 200_000, 150_000
#: Links of a group beyond which only its distinct ids are paired.
WIDE = 1 << 12
#: Keys that a partition's table of counts holds before it is merged or passed on.
COUNTED = 1 << 20
#: B's sign for a blank.
BLANK = "▁"


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Grown:
    """Arrays by number, end to end in one buffer."""

    def __init__(self, kind: type) -> None:
        self._data, self._used = np.zeros(1 << 12, kind), 0
        self._ends, self._n = np.zeros(1 << 12, np.int64), 0

    @staticmethod
    def _put(into: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
        if at + len(values) > len(into):
            into = np.r_[into[:at], np.zeros(max(len(values), at), into.dtype)]
        into[at : at + len(values)] = values
        return into

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        """values: counts[0] for the next number, then counts[1], and so on."""
        self._data = self._put(self._data, self._used, values)
        self._ends = self._put(self._ends, self._n + 1, self._used + np.cumsum(counts))
        self._used, self._n = self._used + len(values), self._n + len(counts)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the numbers, concatenated, and how long each is."""
        many = self._ends[numbers + 1] - self._ends[numbers]
        return self._data[ranges(self._ends[numbers], many)], many


class PlainTokenizer(Tokenizer):
    """A byte-level tokenizer to which the strings of added tokens are text like other text."""

    def __init__(self, spec: str) -> None:
        super().__init__(spec)
        self.kept, self.kept_bytes = KEPT_WORDS, 1 << 22
        self.automaton.states, self.automaton.arcs = STATES, 1 << 21

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._encode(texts)

    def white(self, code: np.ndarray) -> np.ndarray:
        """Whether code points are white space."""
        return self._classes[code] == SPACE


class Aligner:
    """Two vocabularies, and what is known of the chunks met. spec: the JSON text of A; model: the bytes of B's
    file. Vocabularies with pieces that hold a blank elsewhere than at their start are refused."""

    def __init__(self, spec: str, model: bytes) -> None:
        import sentencepiece

        self.a, self.b = PlainTokenizer(spec), sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("a piece holds a blank after something else")
        self._blank = self.b.piece_to_id(BLANK)
        self.pieces = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        n = max(len(self.a.labels.size), len(pieces))
        #: Decimal ids with each of the characters that may follow them.
        self.signs = Table([b"%d%c" % (i, c) for i in range(n) for c in b",|;"])
        self._forget()

    def _forget(self) -> None:
        self._met: dict[bytes, int] = {}
        self._bytes = 0
        #: Of each chunk: A and B tokens, groups, links, and whether both spell its bytes.
        self._facts = Grown(np.int64)
        self._keys, self._many, self._signs = Grown(np.int64), Grown(np.int64), Grown(np.int32)

    def _cuts(self, data: bytes, first: np.ndarray) -> np.ndarray:
        """Byte offsets at which chunks begin, of texts that begin at `first`."""
        buf = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        code = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.zeros(len(code), bool)
        new[1:] = (code[1:] == 0x20) & ~self.a.white(code[:-1])
        new[np.searchsorted(lead, first)] = True
        return lead[new]

    def _learn(self, new: list[bytes]) -> None:
        """Encodes and aligns chunks and adds what is found to the table."""
        ids_a, n_a = self.a.encode_batch(new)
        found = self.b.encode([c[1:].decode("utf-8", "surrogatepass") for c in new], num_threads=1)
        found = [x or [self._blank] for x in found]  # a lone blank
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        ids_b = np.fromiter((i for x in found for i in x), np.int64, int(n_b.sum()))
        same = [x == y == c for x, y, c in zip(self.a.labels.gather(ids_a, n_a), self.pieces.gather(ids_b, n_b), new, strict=True)]
        good = np.array(same, bool)
        at = np.flatnonzero(good)
        ids_a, ids_b = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)]
        size = np.fromiter(map(len, new), np.int64, len(new))[at]
        facts = np.zeros((len(new), 5), np.int64)
        facts[at] = np.stack([n_a[at], n_b[at], *[np.zeros_like(at)] * 2, np.ones_like(at)], axis=1)
        # Ends of tokens in the chunks one after another, and where both have one.
        end_a, end_b = np.cumsum(self.a.labels.size[ids_a]), np.cumsum(self.pieces.size[ids_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        many_a, many_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        chunk = np.searchsorted(np.cumsum(size), common)
        facts[at, 2] = np.bincount(chunk, minlength=len(at))
        facts[at, 3] = np.bincount(chunk, many_a * many_b, minlength=len(at)).astype(np.int64)
        which, keys, counts = self._pairs(ids_a, ids_b, of_a, of_b, many_a, many_b)
        order = np.lexsort((keys, chunk[which]))
        owner, keys, counts = chunk[which][order], keys[order], counts[order]
        start = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, np.int64)
        held = np.zeros(len(new), np.int64)
        held[at] = np.bincount(owner[start], minlength=len(at))
        self._keys.add(keys[start], held)
        self._many.add(np.add.reduceat(counts, start) if len(start) else counts[start], held)
        # The groups' text: A's ids, then B's, the last of each with its own sign.
        begin = np.cumsum(many_a + many_b) - many_a - many_b
        place_a = begin[of_a] + np.arange(len(ids_a)) - (np.cumsum(many_a) - many_a)[of_a]
        place_b = (begin + many_a)[of_b] + np.arange(len(ids_b)) - (np.cumsum(many_b) - many_b)[of_b]
        signs = np.zeros(len(ids_a) + len(ids_b), np.int32)
        signs[place_a], signs[place_b] = ids_a * 3, ids_b * 3
        signs[begin + many_a - 1] += 1
        signs[begin + many_a + many_b - 1] += 2
        self._signs.add(signs, facts[:, 0] + facts[:, 1])
        self._facts.add(facts.ravel(), np.full(len(new), 5))

    @staticmethod
    def _pairs(ids_a: np.ndarray, ids_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, many_a: np.ndarray, many_b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(group, key, count) of the links of each group; a wide group has each of its pairs once."""
        wide = many_a * many_b > WIDE
        first_b = np.cumsum(many_b) - many_b
        own = np.flatnonzero(~wide[of_a])
        times = many_b[of_a[own]]
        keys = pack(np.repeat(ids_a[own], times), ids_b[ranges(first_b[of_a[own]], times)])
        out = [(np.repeat(of_a[own], times), keys, np.ones(len(keys), np.int64))]
        first_a = np.cumsum(many_a) - many_a
        for g in np.flatnonzero(wide):
            x, n = np.unique(ids_a[first_a[g] : first_a[g] + many_a[g]], return_counts=True)
            y, m = np.unique(ids_b[first_b[g] : first_b[g] + many_b[g]], return_counts=True)
            out.append((np.full(len(x) * len(y), g), pack(np.repeat(x, len(y)), np.tile(y, len(x))), np.repeat(n, len(y)) * np.tile(m, len(x))))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """(facts, digests, keys, counts) of texts: tokens of A, of B, groups and links; the digest of the groups'
        text; the distinct keys and the links of each. Texts without tokens have zeros and an empty digest."""
        if len(self._met) > KEPT or self._bytes > KEPT_BYTES:
            self._forget()
        facts, digests = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        keys, counts = [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        live = np.array([i for i, t in enumerate(texts) if t], np.int64)
        if not len(live):
            return facts, digests, keys, counts
        data = b" " + b" ".join(texts[i] for i in live)
        size = np.fromiter((len(texts[i]) + 1 for i in live), np.int64, len(live))
        first = np.cumsum(size) - size
        start = self._cuts(data, first)
        end = np.r_[start[1:], len(data)]
        buf = np.frombuffer(data, np.uint8)
        _, one, which = np.unique(range_hashes(hash_sums(buf), start, end), return_index=True, return_inverse=True)
        if not (np.array_equal(end - start, (end - start)[one][which]) and np.array_equal(buf[ranges(start[one][which], end - start)], buf)):  # two chunks have one hash
            one = which = np.arange(len(start))
        spelled = [data[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
        new = list(dict.fromkeys(c for c in spelled if c not in self._met))
        if new:
            for c in new:
                self._met[c] = len(self._met)
            self._bytes += sum(map(len, new))
            self._learn(new)
        number = np.fromiter((self._met[c] for c in spelled), np.int64, len(spelled))[which]
        begin = np.searchsorted(start, first)
        own = np.repeat(np.arange(len(live)), np.diff(np.r_[begin, len(start)]))
        known = np.add.reduceat(self._facts.gather(number)[0].reshape(-1, 5), begin)
        good = known[:, 4] == np.diff(np.r_[begin, len(start)])
        facts[live[good]] = known[good, :4]
        number, own = number[good[own]], own[good[own]]
        # Distinct keys of each text: by text, then key.
        flat, many = self._keys.gather(number)
        links, owner = self._many.gather(number)[0], np.repeat(own, many)
        order = np.lexsort((flat, owner))
        flat, links, owner = flat[order], links[order], owner[order]
        new_key = np.flatnonzero(np.r_[True, (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]) if len(flat) else np.zeros(0, np.int64)
        total = np.add.reduceat(links, new_key) if len(new_key) else links
        edge = np.searchsorted(owner[new_key], np.arange(len(live) + 1))
        signs, many = self._signs.gather(number)
        said = self.signs.gather(signs, np.bincount(own, many, minlength=len(live)).astype(np.int64))
        for i in np.flatnonzero(good):
            at = slice(edge[i], edge[i + 1])
            keys[live[i]], counts[live[i]] = flat[new_key[at]], total[at]
            digests[live[i]] = hashlib.sha256(said[i][:-1]).hexdigest()
        return facts, digests, keys, counts


_BUILT: dict[str, Aligner] = {}


def aligner_of(spec: str, model: bytes) -> Aligner:
    """One aligner a worker process."""
    key = hashlib.sha1(spec.encode() + model).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Aligner(spec, model)
    return _BUILT[key]


def align_table(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups_sha256, a, b, m): a and b hold the distinct linked pairs of
    ids, ascending, and m the links of each."""
    shared = docs.sparkSession.sparkContext.broadcast((spec, model))
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "m"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = aligner_of(*shared.value)
        for batch in batches:
            for rows, texts in chunks(list(range(batch.num_rows)), batch.column(1).to_pylist()):
                facts, digests, keys, counts = t.align(texts)
                edge = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])], pa.int32())
                flat, many = np.concatenate(keys), np.concatenate(counts)
                lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (flat >> 32, flat & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows[0], len(rows)), *map(pa.array, facts.T), pa.array(digests), *lists, pa.ListArray.from_arrays(edge, pa.array(many))], names)

    schema = with_fields(docs, id_col, "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, m array<long>")
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _packed(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return pack(batch.column(i).flatten().to_numpy(), batch.column(i + 1).flatten().to_numpy())


def partial_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): of each partition the rows that hold a key, some keys more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, wait, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        names = ["key", "n"]
        for batch in batches:
            wait.append(_packed(batch, 0))
            waiting += len(wait[-1])
            if waiting >= COUNTED:
                new, many = np.unique(np.concatenate(wait), return_counts=True)
                keys, n = summed(np.r_[keys, new], np.r_[n, many])
                wait, waiting = [], 0
                if len(keys) >= COUNTED:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names)
                    keys, n = keys[:0], n[:0]
        new, many = np.unique(np.concatenate([np.zeros(0, np.int64), *wait]), return_counts=True)
        keys, n = summed(np.r_[keys, new], np.r_[n, many])
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names)

    return aligned.select("a", "b").mapInArrow(run, "key long, n long")


class Counts:
    """Count shards under a shared folder: `shards` holds (first key, keys, file) in order, and `best`, of each A id,
    the highest count of its pairs (0: none)."""

    def __init__(self, root: str, shards: list[tuple[int, int, str]], best: np.ndarray) -> None:
        self.root, self.shards, self.best = root, shards, best

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ascending keys, all of which are known."""
        out, store, path = np.zeros(len(keys), np.int64), *pafs.FileSystem.from_uri(self.root)
        edge = np.searchsorted(keys, [s[0] for s in self.shards[1:]])
        for (_, n, name), i, j in zip(self.shards, np.r_[0, edge], np.r_[edge, len(keys)], strict=True):
            if i < j:
                if isinstance(store, pafs.LocalFileSystem):
                    data = np.memmap(f"{path}/{name}", np.int64, "r", shape=2 * n)
                else:  # a shard is one range of the sort
                    with store.open_input_file(f"{path}/{name}") as f:
                        data = np.frombuffer(f.read(), np.int64)
                at = np.searchsorted(data[:n], keys[i:j])
                if not np.array_equal(data[:n][at], keys[i:j]):
                    raise KeyError("a pair without a count")
                out[i:j] = data[n:][at]
        return out


def _write(root: str, name: str, parts: list[np.ndarray]) -> None:
    """Writes a file, which appears whole: a task that runs again replaces it with the same bytes."""
    store, path = pafs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for p in parts:
            out.write(p.tobytes())
    store.move(own, f"{path}/{name}")


def write_counts(partial: DataFrame, ids_a: int, root: str) -> Counts:
    """Sums partial counts, a written table, and writes the shards. The driver gets a line for each shard, and a count
    for each A id and shard that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"counts-{TaskContext.get().partitionId():06d}.i64"
        keys, counts = [], []
        last, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(k: np.ndarray, v: np.ndarray) -> None:
            keys.append(k)
            counts.append(v)

        for b in batches:
            k, v = summed(np.r_[last, b.column(0).to_numpy()], np.r_[n, b.column(1).to_numpy()])
            done(k[:-1], v[:-1])
            last, n = k[-1:], v[-1:]  # its run may go on
        done(last, n)
        k, v = np.concatenate(keys), np.concatenate(counts)
        if len(k):
            _write(root, name, [k, v])
            a = k >> 32
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            m = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array([int(k[0])] * m), pa.array([len(k)] * m), pa.array(a[first].astype(np.int32)), pa.array(np.maximum.reduceat(v, first))], ["file", "key", "n", "a", "best"])

    parts = partitions(partial.sparkSession)
    sorted_ = partial.repartitionByRange(parts, "key").sortWithinPartitions("key")
    found = materialize(sorted_.mapInArrow(run, "file string, key long, n long, a int, best long"), "shards")
    shards = sorted((r.key, r.n, r.file) for r in found.select("key", "n", "file").distinct().collect())
    best = np.zeros(ids_a, np.int64)
    for r in found.groupBy("a").agg(F.max("best").alias("best")).collect():
        best[r.a] = r.best
    return Counts(root, shards, best)


def with_counts(aligned: DataFrame, counts: Counts, id_col: str = "doc_id") -> DataFrame:
    """aligned without its lists but with n_best, the links whose count is the highest of their A id, and count_sum,
    the sum of the counts of all links."""
    shared = aligned.sparkSession.sparkContext.broadcast(counts)
    names = [*[c for c in aligned.columns if c not in ("a", "b", "m")], "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                flat = _packed(batch, len(names) - 2)
                keys, which = np.unique(flat, return_inverse=True)
                n = known.find(keys)
                best = (n == known.best[keys >> 32])[which]
                m = batch.column(len(names)).flatten().to_numpy()
                owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(len(names)).offsets.to_numpy()))
                total = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(total[0], owner, m * best)
                np.add.at(total[1], owner, m * n[which])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 2], *map(pa.array, total)], names)

    kept = [c for c in aligned.columns if c not in ("a", "b", "m")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*kept).schema) + ", n_best long, count_sum long"
    return aligned.select(*kept, "a", "b", "m").mapInArrow(run, schema)


def statistics(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum) of each row of docs.

    vocabulary, model: paths of A's JSON and B's model file, which the driver reads. A's tokens are of a blank and the
    text, B's of the text, before which B puts a blank itself. Texts that are null, empty or not spelled exactly by
    both have no tokens. Rows that repeat are documents of their own; a null doc_id is an id like others; a very long
    text is handled whole; an empty table gives an empty result; further columns are not carried."""
    spec = open(vocabulary, encoding="utf-8").read()
    with open(model, "rb") as f:
        data = f.read()
    aligned = materialize(align_table(docs, spec, data), "aligned")
    listed = json.loads(spec)
    ids = 1 + max(listed["model"]["vocab"].values())
    counts = write_counts(materialize(partial_counts(aligned), "partial"), ids, fresh_path(docs.sparkSession, "pair-counts"))
    return with_counts(aligned, counts)
