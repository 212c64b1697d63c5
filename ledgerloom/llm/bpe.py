"""Byte-pair encoding by a tokenization automaton.

Compiling takes two steps. First the automaton over tokens: it starts as one state with a loop for each byte, and
merges are added in order of rank, each by the merge gadget: for (u, v) -> uv every path u, v gets an arc uv
beside it, and u from then on leads to a copy of its target that lacks the arc v. The target of an arc depends on
its label alone, and after all merges exactly the right tokenization of each byte string is a path, so every
prefix of a word has one path. Second the automaton over bytes, by the subset construction: a state holds the
live threads, i.e. the arcs begun but not ended (how far, and from which token), and emits the one token that ends
at its byte. Its states are made when a word first needs them and stay in a table, of bounded size, so encoding a
pre-split word is one table look-up a byte; the path is then read off the emitted tokens from the word's end.
Decoding emits the bytes of the arc labels.

Around the automaton whole batches are handled by array operations: texts are cut into words by character
classes, equal words of a batch are encoded once, and ids, digits and labels are gathered."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import with_fields
from ledgerloom.llm.textkit import chunks, hash_sums, range_hashes, ranges

#: Words a worker keeps the ids of, and bytes of words; beyond, the table starts anew with the words met in several
#: batches, up to half of it.
KEPT, KEPT_BYTES = 100_000, 1 << 21
#: States of the automaton over bytes that a worker keeps, with four times as many transitions at most, and answers
#: about arcs; beyond, their tables start anew.
STATES, ARCS = 90_000, 200_000
LETTER, NUMBER, SPACE = 1, 2, 3


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """The automaton over tokens of a vocabulary, and that over bytes, state 0 being the start of both."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.size = array("i", bytes(4 * (max(vocab.values(), default=-1) + 1)))
        for t, i in vocab.items():
            self.size[i] = len(t)
        #: Bounds of the tables of states and arcs.
        self.states, self.arcs = STATES, ARCS
        if len(self.size) > 1 << 20:
            raise ValueError("a vocabulary has 2^20 ids at most")
        #: Tokens that some gadget, or the first state, has an arc for, with the parts they were merged from and when.
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, -1, -1) for t, i in vocab.items() if len(t) == 1}
        #: Of each token: the arcs that gadgets took from the state it leads to, and when.
        self._taken: dict[int, dict[int, int]] = {}
        for k, (a, b) in enumerate(merges):
            self.made.setdefault(vocab[a + b], (vocab[a], vocab[b], k))
            self._taken.setdefault(vocab[a], {}).setdefault(vocab[b], k)
        #: The spellings of arcs: node << 8 | byte -> node, and the token each node ends, or -1.
        self._next: dict[int, int] = {}
        self._ends = array("i", [-1])
        for t, i in vocab.items():
            if i in self.made:
                self._spell(t, i)
        #: Nodes that have arcs.
        self._inner = bytearray(len(self._ends))
        for node in self._next:
            self._inner[node >> 8] = 1
        self._clear()

    def _spell(self, token: bytes, number: int) -> None:
        at = 0
        for byte in token:
            key = at << 8 | byte
            if key not in self._next:
                self._next[key] = len(self._ends)
                self._ends.append(-1)
            at = self._next[key]
        self._ends[at] = number

    def arc(self, last: int, token: int) -> bool:
        """Whether the state that `last` leads to has the arc `token`.

        The arcs it lacks were taken by merges of `last` or, up to the rank that built it, of its right parts;
        a token merged later from a missing arc was never added either."""
        a, before = last, 1 << 40
        while a >= 0:
            own = self._taken.get(a)
            if own:
                b, until = token, 1 << 40
                while b >= 0:
                    k = own.get(b)
                    if k is not None and k < before and k <= until:
                        return False
                    b, _, until = self.made[b]
            _, a, before = self.made[a]
        return True

    def _clear(self) -> None:
        """Only the start of the automaton over bytes: one thread at the root, after no token."""
        start = (0, -1)
        self._threads, self._numbers, self._emits = [start], {start: 0}, array("i", [-1])
        self.step: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}

    def _determinise(self, state: int, byte: int) -> int:
        """The state after `state` and `byte`, put into the table."""
        threads, live, token = self._threads[state], [], -1
        for i in range(0, len(threads), 2):
            node, last = self._next.get(threads[i] << 8 | byte, -1), threads[i + 1]
            if node < 0:
                continue
            if token < 0 and (t := self._ends[node]) >= 0:  # threads are oldest first, and no second one can end here
                pair = last << 20 | t
                can = last < 0 or self._arcs.get(pair)
                if can is None:
                    if len(self._arcs) >= self.arcs:
                        self._arcs.clear()
                    can = self._arcs[pair] = self.arc(last, t)
                if can:
                    token = t
            if self._inner[node]:
                live += node, last
        if token < 0:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = (*live, 0, token)
        found = self._numbers.get(key)
        if found is None:
            if len(self._threads) >= self.states or len(self.step) >= 4 * self.states:
                self._clear()
                state = -1
            found = self._numbers[key] = len(self._threads)
            self._threads.append(key)
            self._emits.append(token)
        if state >= 0:
            self.step[state << 8 | byte] = found
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The word's path: one transition a byte, then the emitted tokens from the end back."""
        state, ended = 0, []
        step, size = self.step.get, self.size
        for byte in word:
            after = step(state << 8 | byte)
            if after is None:
                after = self._determinise(state, byte)
                step = self.step.get
            state = after
            ended.append(self._emits[state])
        path, at = [], len(word)
        while at:
            token = ended[at - 1]
            path.append(token)
            at -= size[token]
        return path[::-1]


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or 0 of each code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for number, of in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(of, every):
            out[run.start() : run.end()] = number
    return out


def word_starts(data: bytes, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte offsets at which words begin, of texts that begin at the offsets `first` (empty texts excluded).

    The fixed rules of byte-level pre-tokenization: an English contraction ('s 't 'm 'd 're 've 'll) that no word
    runs into; a run of letters, of numbers or of other characters, with one blank before it; a run of white space,
    which leaves its last character to what follows."""
    buf = np.frombuffer(data, np.uint8)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    code = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    cls = classes[code]
    opens = np.zeros(n + 1, bool)  # a text begins, or all end
    opens[np.searchsorted(lead, first)] = True
    opens[n] = True
    run = opens[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    out = run.copy()
    white, blank = cls == SPACE, code == 0x20
    # The last character of white space before something else begins a word, and takes what follows if it is a blank.
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~opens[1:n])
    out[last] = True
    out[last[blank[last]] + 1] = False
    # Contractions: an apostrophe on its own that begins a word, and letters after it.
    at = np.flatnonzero(out[: n - 1] & (code[: n - 1] == 0x27) & (cls[1:] == LETTER) & ~opens[1:n])
    one, two = code[at + 1], code[np.minimum(at + 2, n - 1)]
    two = np.where(opens[np.minimum(at + 2, n)], 0, two)
    is_ = lambda *pairs: np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in pairs])
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, np.where(is_("re", "ve", "ll"), 3, 0))
    at, size = at[size > 0], size[size > 0]
    out[at + 1] = False
    out[np.minimum(at + size, n - 1)[at + size < n]] = True
    return lead[out]


class Table:
    """Byte strings by number, for gathering many at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.first = np.cumsum(self.size) - self.size

    def gather(self, numbers: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The concatenated strings of counts[0] numbers, then of counts[1], and so on."""
        size = self.size[numbers]
        data = self.flat[ranges(self.first[numbers], size)].tobytes()
        ends = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Tokenizer:
    """An automaton with the pre-tokenizer and the added tokens of a vocabulary file (its JSON text). Files that ask
    for another pre-tokenizer, a normalizer or options of BPE that the automaton doesn't have are refused. `room` scales
    the bounds of all tables: more memory for less time, with the same ids."""

    def __init__(self, spec: str, room: float = 1.0) -> None:
        data = json.loads(spec)
        model, cut = data["model"], data.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or data.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE vocabulary {odd}")
        plain = byte_alphabet()
        to_bytes = lambda s: bytes(plain[c] for c in s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else m for m in model["merges"]]
        self.added = {x["content"].encode(): x["id"] for x in data.get("added_tokens", [])}
        vocab = {to_bytes(t): i for t, i in model["vocab"].items() if t.encode() not in self.added}
        self.automaton = Automaton(vocab, [(to_bytes(a), to_bytes(b)) for a, b in merges])
        labels = {i: t for t, i in (vocab | self.added).items()}
        every = range(max(labels) + 1)
        self.labels, self.digits = Table([labels.get(i, b"") for i in every]), Table([b"%d," % i for i in every])
        self._added = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        self._classes = character_classes()
        self.kept, self.kept_bytes = int(KEPT * room), int(KEPT_BYTES * room)
        self.automaton.states, self.automaton.arcs = int(STATES * room), int(ARCS * room)
        self._forget()

    def _forget(self) -> None:
        self._met: dict[bytes, int] = {}
        self._ids, self._begin, self._bytes = array("i"), array("q", [0]), 0
        #: Of each word: in how many batches it was met since the table started.
        self._uses = np.zeros(0, np.int32)

    def _shrink(self) -> None:
        """Starts the table of words anew with those met in several batches, the first of them if they are too many."""
        met, ids, begin, uses = self._met, self._ids, self._begin, self._uses
        self._forget()
        for word, n in met.items():  # in order of their numbers
            if uses[n] > 1:
                if 2 * len(self._met) >= self.kept or 2 * (self._bytes + len(word)) > self.kept_bytes:
                    break
                self._ids.extend(ids[begin[n] : begin[n + 1]])
                self._begin.append(len(self._ids))
                self._bytes += len(word)
                self._met[word] = len(self._met)

    def _number(self, word: bytes) -> int:
        """The number of a word in the table of words met."""
        found = self._met.get(word)
        if found is None:
            self._ids.extend(self.automaton.encode_word(word))
            self._begin.append(len(self._ids))
            self._bytes += len(word)
            found = self._met[word] = len(self._met)
        return found

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text), texts without added tokens."""
        if len(self._met) > self.kept or self._bytes > self.kept_bytes:
            self._shrink()
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = b"".join(texts)
        if not data:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        first = np.cumsum(size) - size
        start = word_starts(data, first[size > 0], self._classes)
        end = np.r_[start[1:], len(data)]
        _, one, which = np.unique(range_hashes(hash_sums(buf := np.frombuffer(data, np.uint8)), start, end), return_index=True, return_inverse=True)
        alike = np.array_equal(end - start, (end - start)[one][which]) and np.array_equal(buf[ranges(start[one][which], end - start)], buf)
        if not alike:  # two words have one hash
            one, which = np.arange(len(start)), np.arange(len(start))
        number = np.fromiter((self._number(data[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)), np.int64, len(one))
        if len(self._uses) < len(self._met):
            self._uses = np.r_[self._uses, np.zeros(len(self._met), np.int32)]
        self._uses[number] += 1
        number = number[which]
        begin = np.array(self._begin, np.int64)
        many = begin[number + 1] - begin[number]
        ids = np.array(self._ids, np.int32)[ranges(begin[number], many)]
        whole = np.r_[0, np.cumsum(many)]
        at = np.searchsorted(start, np.r_[first, len(data)])
        return ids, np.diff(whole[at])

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of UTF-8 texts."""
        if not self._added or not any(a in t for a in self.added for t in texts):
            return self._encode(texts)
        parts = [self._added.split(t) for t in texts]  # at odd places: added tokens
        flat = [b"" if i % 2 else x for p in parts for i, x in enumerate(p)]
        ids, many = self._encode(flat)
        own = [[self.added[x]] if i % 2 else None for p in parts for i, x in enumerate(p)]
        pieces = [np.array(a, np.int32) if a else x for a, x in zip(own, np.split(ids, np.cumsum(many)[:-1]), strict=True)]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.cumsum([0, *map(len, parts)])
        return np.concatenate(pieces), np.diff(np.r_[0, np.cumsum(sizes)][at])

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text.encode("utf-8", "surrogatepass")])[0].tolist()

    def decode_batch(self, ids: np.ndarray, many: np.ndarray) -> list[bytes]:
        """The texts in UTF-8; bytes that are none are replaced."""
        return [t.decode("utf-8", "replace").encode() for t in self.labels.gather(ids, many)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([len(ids)]))[0].decode()


_BUILT: dict[str, Tokenizer] = {}


def tokenizer_of(spec: str, room: float = 1.0) -> Tokenizer:
    """One automaton a worker process; it is built once from the vocabulary file's text."""
    key = f"{hashlib.sha1(spec.encode()).hexdigest()} {room}"
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Tokenizer(spec, room)
    return _BUILT[key]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in slices of a few rows, so that a batch's texts never stand as Python strings together."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids) for each row: ids array<int> of the whole text; null text: empty.

    `vocabulary`: path of a tokenizer JSON file that the driver reads; its size bounds what is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    schema = with_fields(docs, id_col, "n_tokens long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(shared.value)
        for b in batches:
            for rows, texts in chunks(list(range(b.num_rows)), b.column(1).to_pylist()):
                ids, many = t.encode_batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows[0], len(rows)), pa.array(many), lists], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_table(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text) from (id_col, ids array<int>); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode(x.as_py() or []) for x in b.column(1)], pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, with_fields(encoded, id_col, "text string"))


def digests(docs: DataFrame, vocabulary: str, room: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs, of whole texts: encoded, then
    decoded from the ids. Null texts count as empty; repeated rows stay; further columns are not carried; an
    empty table gives an empty result. `room` scales the tables that a worker keeps. A very long text is handled whole, in memory of some 100 times its bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(open(vocabulary, encoding="utf-8").read())
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer_of(shared.value, room)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in pieces(batches):
            for rows, texts in chunks(list(range(b.num_rows)), b.column(1).to_pylist()):
                ids, many = t.encode_batch(texts)
                spelled = [sha(x[:-1]) for x in t.digits.gather(ids, many)]
                decoded = [sha(x) for x in t.decode_batch(ids, many)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(rows[0], len(rows)), pa.array(many), pa.array(spelled), pa.array(decoded)], names)

    schema = with_fields(docs, "doc_id", "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col("doc_id"), F.col("text")).mapInArrow(run, schema)
