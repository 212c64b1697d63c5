"""FLAC media columns: mono streams of 8-bit samples, coded and decoded by numpy over many frames at once.

A stream has STREAMINFO (with the samples' MD5), a seek point for each frame, and frames of up to `BLOCK`
samples. Its subframes are verbatim, fixed predictors of order 0 to 4 or quantized linear predictors, with
Rice-coded residuals in one partition. Decoding goes through the frames in step, a sample of each at a time, so
the work is in array operations; checksums of headers (CRC-8) and frames (CRC-16) are verified, and a stream
whose checksum or MD5 is wrong raises."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.shared import with_fields
from ledgerloom.llm.textkit import ranges

BLOCK = 4096
RATE = 8000
LPC_ORDER, LPC_BITS = 2, 8
#: The predictors of subframe types FIXED 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _table(poly: int, bits: int) -> np.ndarray:
    out = []
    for i in range(256):
        v = i << (bits - 8)
        for _ in range(8):
            v = ((v << 1) ^ poly if v >> (bits - 1) else v << 1) & ((1 << bits) - 1)
        out.append(v)
    return np.array(out, np.uint16)


_CRC8, _CRC16 = _table(0x07, 8), _table(0x8005, 16)
_CRC8_LIST = _CRC8.tolist()


def crc8(data: bytes) -> int:
    v = 0
    for b in data:
        v = _CRC8_LIST[v ^ b]
    return v


#: Bytes up to which a range's CRC-16 is read off tables; longer ones go a byte at a time.
NEAR = BLOCK + 64
_PLACED: list[np.ndarray] = []


def _placed() -> np.ndarray:
    """The CRC-16 of each byte with i zero bytes after it, in row i: a range's is the exclusive or of its bytes'."""
    if not _PLACED:
        out = np.zeros((NEAR, 256), np.uint16)
        out[0] = _CRC16
        for i in range(1, NEAR):
            out[i] = (out[i - 1] << np.uint16(8)) ^ _CRC16[out[i - 1] >> np.uint16(8)]
        _PLACED.append(out.reshape(-1))
    return _PLACED[0]


def crc16(buf: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """CRC-16 of several byte ranges, of about `most` bytes together at a time."""
    out = np.zeros(len(start), np.uint16)
    near = np.flatnonzero((size > 0) & (size <= NEAR))
    cut = np.flatnonzero(np.diff(np.cumsum(size[near]) // most)) + 1
    for own in np.split(near, cut) if len(near) else []:
        n = size[own]
        ends = np.cumsum(n)
        after = np.repeat(ends, n) - np.arange(1, ends[-1] + 1)
        out[own] = np.bitwise_xor.reduceat(_placed()[after << 8 | buf[ranges(start[own], n)]], ends - n)
    far = np.flatnonzero(size > NEAR)
    if len(far):
        out[far] = _crc16_in_step(buf, start[far], size[far])
    return out


def _crc16_in_step(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of several byte ranges, a byte of each at a time."""
    order = np.argsort(-size, kind="stable")
    at, left = start[order].copy(), size[order]
    v = np.zeros(len(at), np.uint16)
    active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), side="right")
    for m in active:
        v[:m] = (v[:m] << np.uint16(8)) ^ _CRC16[(v[:m] >> np.uint16(8)) ^ buf[at[:m]]]
        at[:m] += 1
    out = np.zeros(len(at), np.uint16)
    out[order] = v
    return out


def _number(n: int) -> bytes:
    """The UTF-8-like code of a frame number."""
    if n < 0x80:
        return bytes([n])
    for more in range(1, 7):
        if n < 1 << (5 * more + 6):
            return bytes([(0xFF80 >> more & 0xFF) | n >> (6 * more), *(0x80 | n >> (6 * i) & 0x3F for i in range(more - 1, -1, -1))])
    raise ValueError(n)


def _predictors(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantized linear predictors of order two for each row of x (n samples each): coefficients, shifts."""
    f = x.astype(np.float32)
    r0, r1, r2 = (f * f).sum(1) + 1e-3, (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    k1 = r1 / r0
    e = r0 * (1 - k1 * k1) + 1e-3
    k2 = (r2 - k1 * r1) / e
    c = np.stack([k1 - k1 * k2, k2], axis=1)
    shift = np.full(len(x), 6)
    return np.clip(np.rint(c * 64), -(1 << (LPC_BITS - 1)), (1 << (LPC_BITS - 1)) - 1).astype(np.int32), shift


def _residual(x: np.ndarray, c: np.ndarray, shift: np.ndarray | int) -> np.ndarray:
    """x minus its prediction, from the order's sample on; c: (rows, order)."""
    k = c.shape[1]
    pred = np.zeros((len(x), x.shape[1] - k), np.int32)
    for j in range(k):
        pred += c[:, j : j + 1] * x[:, k - 1 - j : x.shape[1] - 1 - j]
    return x[:, k:] - (pred >> (shift if np.isscalar(shift) else shift[:, None]))


def _encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of one block size: x (frames, samples) int32."""
    rows, n = x.shape
    lpc, shift = _predictors(x, n)
    kinds = [(0, np.zeros((rows, 0), np.int32), 0), (1, np.tile(np.int32(FIXED[1]), (rows, 1)), 0), (2, np.tile(np.int32(FIXED[2]), (rows, 1)), 0), (32 + LPC_ORDER - 1, lpc, shift)]
    best, pick, rice, codes = np.full(rows, n * 8, np.int64), np.full(rows, -1), np.zeros(rows, np.int64), [None] * len(kinds)
    for i, (_, c, s) in enumerate(kinds):
        r = _residual(x, c, s)
        u = (r << 1) ^ (r >> 31)
        total = u.sum(1, dtype=np.int64)
        most = [u.shape[1] * (1 + p) + (total >> p) for p in range(9)]
        k, bits = np.argmin(most, axis=0), np.min(most, axis=0) + 10 + 8 * c.shape[1] + (9 + c.shape[1] * LPC_BITS if i == 3 else 0)
        better = bits < best
        best, pick, rice = np.where(better, bits, best), np.where(better, i, pick), np.where(better, k, rice)
        codes[i] = u
    for i, (_, c, _) in enumerate(kinds):  # the sum of quotients is at most the quotient of the sum; only the best is counted
        own = np.flatnonzero(pick == i)
        u, k = codes[i][own], rice[own]
        best[own] = (u >> k[:, None]).sum(1, dtype=np.int64) + u.shape[1] * (1 + k) + 10 + 8 * c.shape[1] + (9 + c.shape[1] * LPC_BITS if i == 3 else 0)
    heads, sizes, lead = [], np.zeros(rows, np.int64), []
    for f in range(rows):
        b = b"\xff\xf8" + bytes([(0xC0 if n == BLOCK else 0x70) | 4, 0x02]) + _number(numbers[f]) + (b"" if n == BLOCK else struct.pack(">H", n - 1))
        b += bytes([crc8(b)])
        i = pick[f]
        text = ""
        if i < 0:
            b += b"\x02"
        else:
            kind, c, s = kinds[i]
            k = c.shape[1]
            b += bytes([(kind if kind >= 32 else 8 + kind) << 1]) + (x[f, :k] & 0xFF).astype(np.uint8).tobytes()
            if i == 3:
                text = f"{LPC_BITS - 1:04b}{int(s[f]):05b}" + "".join(f"{int(v) & ((1 << LPC_BITS) - 1):0{LPC_BITS}b}" for v in c[f])
            text += f"000000{int(rice[f]):04b}"
        heads.append(b)
        lead.append(text)
        body = n if i < 0 else -(-(best[f] - 8 * kinds[i][1].shape[1]) // 8)
        sizes[f] = len(b) + body
    begin = np.r_[0, np.cumsum(sizes + 2)]
    buf = np.zeros(int(begin[-1]), np.uint8)
    bits_len = int(begin[-1]) * 8
    bits = np.zeros(bits_len, np.uint8)
    for i in range(len(kinds)):
        own = np.flatnonzero(pick == i)
        if not len(own):
            continue
        u, k = codes[i][own], rice[own][:, None]
        q = u >> k
        size = q + 1 + k
        base = np.array([(begin[f] + len(heads[f])) * 8 + len(lead[f]) for f in own])
        stop = base[:, None] + np.cumsum(size, axis=1)
        one = stop - k - 1
        bits[one] = 1
        for j in range(int(k.max())):
            some = np.flatnonzero(k[:, 0] > j)
            bits[stop[some] - 1 - j] = (u[some] >> j) & 1
        for f in own:
            at = (begin[f] + len(heads[f])) * 8
            bits[at : at + len(lead[f])] = np.frombuffer(lead[f].encode(), np.uint8) - 48
    buf = np.packbits(bits)
    for f in range(rows):
        buf[begin[f] : begin[f] + len(heads[f])] = np.frombuffer(heads[f], np.uint8)
        if pick[f] < 0:
            buf[begin[f] + len(heads[f]) : begin[f] + sizes[f]] = (x[f] & 0xFF).astype(np.uint8)
    crc = crc16(buf, begin[:-1], sizes)
    buf[begin[1:] - 2], buf[begin[1:] - 1] = crc >> 8, crc & 0xFF
    whole = buf.tobytes()
    return [whole[begin[f] : begin[f + 1]] for f in range(rows)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload (at least one byte each): byte b is the sample b - 128."""
    blocks: dict[int, list[tuple[int, int]]] = {}
    for p, data in enumerate(payloads):
        for no, at in enumerate(range(0, len(data), BLOCK)):
            blocks.setdefault(min(BLOCK, len(data) - at), []).append((p, no))
    frames: list[dict[int, bytes]] = [{} for _ in payloads]
    for n, where in blocks.items():
        for at in range(0, len(where), max(1, (1 << 20) // n)):
            own = where[at : at + max(1, (1 << 20) // n)]
            raw = np.frombuffer(b"".join(payloads[p][no * BLOCK : no * BLOCK + n] for p, no in own), np.uint8).reshape(len(own), n)
            for (p, no), frame in zip(own, _encode_frames(raw.astype(np.int32) - 128, [no for _, no in own]), strict=True):
                frames[p][no] = frame
    out = []
    for data, own in zip(payloads, frames, strict=True):
        seq = [own[i] for i in range(len(own))]
        md5 = hashlib.md5((np.frombuffer(data, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(map(len, seq)).to_bytes(3, "big") + max(map(len, seq)).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(data)).to_bytes(8, "big") + md5
        offset, points = 0, []
        for i, f in enumerate(seq):
            points.append(struct.pack(">QQH", i * BLOCK, offset, min(BLOCK, len(data) - i * BLOCK)))
            offset += len(f)
        seek = b"".join(points)
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(seq))
    return out


class Stream:
    """The metadata of a FLAC file; frames[i]: (offset in the file, size, first sample, samples)."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != b"fLaC":
            raise ValueError("not FLAC")
        at, last, self.frames = 4, False, []
        points: list[tuple[int, int, int]] = []
        while not last:
            last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + size]
            if kind == 0:
                v = int.from_bytes(body[10:18], "big")
                self.rate, self.channels, self.bits, self.samples, self.md5 = v >> 44, (v >> 41 & 7) + 1, (v >> 36 & 31) + 1, v & (1 << 36) - 1, body[18:34]
            elif kind == 3:
                points = list(struct.iter_unpack(">QQH", body))
            at += 4 + size
        ends = [p[1] for p in points[1:]] + [len(data) - at]
        self.frames = [(at + off, end - off, first, n) for (first, off, n), end in zip(points, ends, strict=True)]


def _bits(data: bytes, at: int, n: int) -> int:
    """n bits of data from bit `at` on."""
    v = int.from_bytes(data[at >> 3 : (at + n + 7) >> 3], "big")
    return v >> (-(at + n) & 7) & ((1 << n) - 1)


def _signed(v: int, bits: int) -> int:
    return v - (1 << bits) if v >> (bits - 1) else v


def _decode_frames(data: bytes, start: list[int], size: list[int], samples: list[int]) -> list[np.ndarray]:
    """Samples (int8) of frames that lie in data; header and frame checksums are verified."""
    buf = np.frombuffer(data + b"\0" * 16, np.uint8)
    s, z = np.array(start, np.int64), np.array(size, np.int64)
    if (crc16(buf, s, z - 2) != buf[s + z - 2].astype(np.uint16) << np.uint16(8) | buf[s + z - 1]).any():
        raise ValueError("a frame's checksum is wrong")
    out: list[np.ndarray | None] = [None] * len(start)
    own, pos, rice, order, coef, shift, warm = [], [], [], [], [], [], []
    for f, (at, n) in enumerate(zip(start, samples, strict=True)):
        head, code = at + 4, data[at + 2] >> 4
        first = data[head]
        head += 1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
        got = {7: lambda h=head: int.from_bytes(data[h : h + 2], "big") + 1, 6: lambda h=head: data[h] + 1}.get(code, lambda c=code: 256 << (c - 8) if c >= 8 else 576 << (c - 2) if c > 1 else 192)()
        head += {7: 2, 6: 1}.get(code, 0)
        if data[at : at + 2] != b"\xff\xf8" or got != n or crc8(data[at:head]) != data[head]:
            raise ValueError("a frame's header is wrong")
        kind = data[head + 1] >> 1
        bit = (head + 2) * 8
        if kind == 1:
            out[f] = buf[head + 2 : head + 2 + n].view(np.int8)
            continue
        if kind == 0:
            out[f] = np.full(n, buf[head + 2]).view(np.int8)
            continue
        k = kind - 31 if kind >= 32 else kind - 8
        w = buf[head + 2 : head + 2 + k].view(np.int8).astype(np.int64)
        bit += 8 * k
        if kind >= 32:
            p, sh = _bits(data, bit, 4) + 1, _bits(data, bit + 4, 5)
            c = [_signed(_bits(data, bit + 9 + i * p, p), p) for i in range(k)]
            bit += 9 + k * p
        else:
            sh, c = 0, list(FIXED[k])
        if _bits(data, bit, 6):
            raise ValueError("more than one Rice partition")
        own.append(f)
        pos.append(bit + 10)
        rice.append(_bits(data, bit + 6, 4))
        order.append(k)
        coef.append(c)
        shift.append(sh)
        warm.append(w)
    if own:
        left = np.array([samples[f] for f in own]) - np.array(order)
        by = np.argsort(-left, kind="stable")
        left, top = left[by], max(order)
        pos, rice, shift = np.array(pos)[by], np.array(rice)[by].astype(np.uint64), np.array(shift)[by]
        c = np.zeros((max(top, 1), len(own)), np.int64)
        x = np.zeros((top + int(left[0]), len(own)), np.int64)
        for i, b in enumerate(by):
            c[: order[b], i] = coef[b]
            x[top - order[b] : top, i] = warm[b]
        words = np.zeros(len(buf) - 8, np.uint64)
        for i in range(8):
            words |= buf[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
        one, seven = np.uint64(1), np.uint64(7)
        active = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1), side="right")
        pos = pos.astype(np.uint64)
        shift_down, any_shift = np.uint64(63) - rice, bool(shift.any())
        for r in range(int(left[0])):
            m = active[r]
            p = pos[:m]
            window = words[p >> np.uint64(3)] << (p & seven)
            high = window >> np.uint64(12)
            q = np.uint64(1074) - (high.astype(np.float64).view(np.uint64) >> np.uint64(52))
            for i in np.flatnonzero(high < np.uint64(256)):  # a long run of zeros, beyond the window
                q[i] = 0
                while not data[int(p[i] + q[i]) >> 3] >> (7 - int(p[i] + q[i]) % 8) & 1:
                    q[i] += one
            p = p + q + one
            rest = words[p >> np.uint64(3)] << (p & seven)
            k = rice[:m]
            u = (q << k) | (rest >> one) >> shift_down[:m]
            pos[:m] = p + k
            e = (u >> one).astype(np.int64) ^ -(u & one).astype(np.int64)
            if top:
                pred = c[0, :m] * x[top + r - 1, :m]
                for j in range(1, top):
                    pred += c[j, :m] * x[top + r - 1 - j, :m]
                e += pred >> shift[:m] if any_shift else pred
            x[top + r, :m] = e
        flat = x.astype(np.int8)
        for i, b in enumerate(by):
            out[own[b]] = flat[top - order[b] : top + left[i], i]
    return out


def decode_streams(files: list[bytes], limit: int = 1 << 21) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(number, PCM blocks) of each file in turn; a block is (first sample, bytes b = sample + 128).

    Frames of several files are decoded together, up to about `limit` samples; the MD5 is verified."""
    streams = [Stream(f) for f in files]
    at = 0
    while at < len(files):
        stop, load = at, 0
        while stop < len(files) and (stop == at or load + streams[stop].samples <= limit):
            load += streams[stop].samples
            stop += 1
        base, start, size, samples = 0, [], [], []
        for i in range(at, stop):
            for off, n, _, count in streams[i].frames:
                start.append(base + off)
                size.append(n)
                samples.append(count)
            base += len(files[i])
        pcm = iter(_decode_frames(b"".join(files[at:stop]), start, size, samples))
        for i in range(at, stop):
            own = [(first, next(pcm)) for _, _, first, _ in streams[i].frames]
            if hashlib.md5(b"".join(b.tobytes() for _, b in own)).digest() != streams[i].md5:
                raise ValueError("the samples' MD5 is wrong")
            yield i, [(first, (b.view(np.uint8) ^ 0x80).tobytes()) for first, b in own]
        at = stop


def payload(text: str | None) -> tuple[bytes, int]:
    """The text in UTF-8 with zeros up to a positive multiple of 64, and its size without them."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b"\0" * (-len(b) % 64 or (0 if b else 64)), len(b)


def encode_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): a FLAC file of each row's text; null counts as empty. Rows with equal texts
    get equal files; further columns are not carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < len(ids):
                own, load, stop = [], 0, at
                while stop < len(ids) and (not own or load < 1 << 22):
                    own.append(payload(texts[stop].as_py()))
                    load += len(own[-1][0])
                    stop += 1
                yield pa.RecordBatch.from_arrays([ids.slice(at, stop - at), pa.array([n for _, n in own], pa.int64()), pa.array(encode_streams([p for p, _ in own]), pa.binary())], [id_col, "n_bytes", "media"])
                at = stop

    return docs.select(id_col, text_col).mapInArrow(run, with_fields(docs, id_col, "n_bytes long, media binary"))


def pcm_blocks(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, block, first_sample, pcm): the decoded blocks of each file, seekable by their first sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blocks in decode_streams(b.column(1).to_pylist()):
                n = len(blocks)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, b.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array([f for f, _ in blocks], pa.int64()), pa.array([x for _, x in blocks], pa.binary())], [id_col, "block", "first_sample", "pcm"])

    return media.select(id_col, "media").mapInArrow(run, with_fields(media, id_col, "block int, first_sample long, pcm binary"))


def feature(samples: bytes) -> str:
    """Peak, energy, mean and zero crossings of a stream, as whole numbers."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    return f"rate={RATE};samples={len(x)};peak={int(np.abs(x).max())};energy={int((x * x).sum())};sum={int(x.sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def digests(media: DataFrame) -> DataFrame:
    """What is read back from the files of encode_table: sizes, digests and the feature of each row."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files, rows = b.column(2).to_pylist(), []
            for i, blocks in decode_streams(files):
                data = b"".join(x for _, x in blocks)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(files[i]), hashlib.sha256(files[i]).hexdigest(), feature(data)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds[2:], strict=True))], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, with_fields(media, "doc_id", "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))
