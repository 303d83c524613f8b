"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import STEP, buffers, mix, runs, slices

SPACE = "▁"  # stands for a space in pieces
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
NONE = np.int64(1) << np.int64(40)


class Bpe(NamedTuple):
    """A model as arrays. Symbols are piece ids; characters that occur only inside pieces follow them."""

    n_pieces: int
    chars: np.ndarray  # sorted code points that are symbols
    char_symbol: np.ndarray
    pair_key: np.ndarray  # sorted left * n_symbols + right
    pair_piece: np.ndarray
    rank: np.ndarray  # of each piece; equal scores have equal ranks
    unsafe: np.ndarray  # pieces that may go on merging at no worse a rank
    n_symbols: int
    byte_id: np.ndarray
    piece_bytes: np.ndarray
    piece_start: np.ndarray
    inner: np.ndarray  # sorted first << 32 | second of the neighbouring code points that occur inside pieces


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a serialised protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


@functools.lru_cache(maxsize=2)
def load_model(raw: bytes) -> Bpe:
    """Reads a BPE model with identity normalisation, a dummy prefix and byte fallback; refuses others."""
    pieces, scores, kinds = [], [], []
    spec = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}
    trainer: dict[int, object] = {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode("utf-8"))
            scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            spec |= dict(_fields(value))
    byte_id = np.zeros(256, np.int64)
    known = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == NORMAL}
    bytes_found = [int(p[1:-1], 16) for p, k in zip(pieces, kinds, strict=True) if k == BYTE]
    if trainer.get(3) != 2 or spec[2] or not spec[3] or spec[4] or not spec[5] or len(bytes_found) != 256 or {USER_DEFINED, UNUSED} & set(kinds) or any(SPACE in p.lstrip(SPACE) for p in known):
        raise ValueError("only BPE models with identity normalisation, dummy prefix, kept white space, byte fallback, no user-defined pieces and no space inside a piece are supported")
    for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
        if k == BYTE:
            byte_id[int(p[1:-1], 16)] = i
    symbol = dict(known)
    for p in known:
        for c in p:
            symbol.setdefault(c, len(pieces) + len(symbol) - len(known))
    rank = np.full(len(pieces), NONE)
    order = sorted({-scores[i] for i in known.values()})
    place = {s: k for k, s in enumerate(order)}
    for i in known.values():
        rank[i] = place[-scores[i]]
    n = max(symbol.values()) + 1
    best = np.full(n, NONE)
    keys, made = [], []
    for p, i in known.items():
        for cut in range(1, len(p)):
            a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
            if a is not None and b is not None:
                keys.append(a * n + b)
                made.append(i)
                best[a], best[b] = min(best[a], rank[i]), min(best[b], rank[i])
    keys, made = np.array(keys, np.int64), np.array(made, np.int64)
    by_key = np.argsort(keys)
    singles = sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1)
    shown = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
    return Bpe(len(pieces), np.array([c for c, _ in singles], np.int64), np.array([i for _, i in singles], np.int64), keys[by_key], made[by_key], rank, best[: len(pieces)] <= rank, n, byte_id,
               np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in shown])]),
               np.array(sorted({ord(a) << 32 | ord(b) for p in known for a, b in zip(p, p[1:], strict=False)}), np.int64))


def pair_pieces(m: Bpe, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece, rank) that neighbouring symbols make; rank ``NONE`` where they make none (also: symbol -1)."""
    key = np.where((left >= 0) & (right >= 0), left * m.n_symbols + right, -1)
    spot = np.minimum(np.searchsorted(m.pair_key, key), len(m.pair_key) - 1)
    made = m.pair_piece[spot]
    return made, np.where(m.pair_key[spot] == key, m.rank[made], NONE)


def merge_rounds(m: Bpe, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the symbols of each word until no pair of neighbours is a piece.

    ``sym``: symbol or -1 of each character, ``word``: its word, rising. In each round every word merges
    all leftmost, non-overlapping places of its best-ranked pair at once, up to the first place whose new
    piece could merge on with a neighbour at the same or a better rank, so that the outcome is that of
    merging one pair at a time. Words without a pair leave. Returns (symbol, index of its first character, word).
    """
    at = np.arange(len(sym))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(sym):
        first = runs(word)
        dense = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        made[:-1], rank[:-1] = pair_pieces(m, np.where(word[:-1] == word[1:], sym[:-1], -1), sym[1:])
        least = np.minimum.reduceat(rank, first)
        over = least[dense] == NONE
        if over.any():
            done.append((sym[over], at[over], word[over]))
            stay = ~over
            sym, at, word, rank, made, dense, first = sym[stay], at[stay], word[stay], rank[stay], made[stay], dense[stay], None
            if not len(sym):
                break
        best = rank == least[dense]
        places = np.flatnonzero(best)
        # every second place of a run of overlapping places
        begin = np.concatenate([[True], np.diff(places) != 1])
        start = places[np.maximum.accumulate(np.where(begin, np.arange(len(places)), 0))]
        places = places[(places - start) % 2 == 0]
        again = np.flatnonzero(m.unsafe[made[places]])
        if len(again):
            p = places[again]
            w, piece = dense[p], made[p]
            merged = np.zeros(len(sym) + 2, bool)
            merged[places] = True
            # to the left stands what the place before it became, to the right what is there before later merges
            left = np.where(merged[p - 2] & (p >= 2), made[p - 2], sym[p - 1])
            left = np.where((p >= 1) & (dense[p - 1] == w), left, -1)
            next_ = np.minimum(p + 2, len(sym) - 1)
            right = np.where((p + 2 < len(sym)) & (dense[next_] == w), sym[next_], -1)
            risky = np.minimum(pair_pieces(m, left, piece)[1], pair_pieces(m, piece, right)[1]) <= least[w]
            if risky.any():
                stop = np.full(len(least), len(sym))
                np.minimum.at(stop, w[risky], p[risky])
                places = places[places <= stop[dense[places]]]
        sym = sym.copy()
        sym[places] = made[places]
        keep = np.ones(len(sym), bool)
        keep[places + 1] = False
        sym, at, word = sym[keep], at[keep], word[keep]
    if not done:
        return (np.empty(0, np.int64),) * 3
    sym, at, word = (np.concatenate([d[k] for d in done]) for k in range(3))
    order = np.lexsort((at, word))
    return sym[order], at[order], word[order]


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + size)."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - start, size)


def encode_batch(m: Bpe, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets by document) for UTF-8 ``data`` cut at ``offsets``."""
    n_docs = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    full = np.flatnonzero(lead[1:] > lead[:-1])
    points = np.where(points == 0x20, ord(SPACE), points)
    points = np.insert(points, lead[full], ord(SPACE))
    starts = lead[full] + np.arange(len(full))
    if not len(points):
        return np.empty(0, np.int32), np.zeros(n_docs + 1, np.int64)
    gap = points == ord(SPACE)
    head = gap.copy()
    head[1:] &= ~gap[:-1]
    head[starts] = True
    unit = np.flatnonzero(head)
    # equal units (by 64-bit hash; a part of a batch has some 10**5 of them) are encoded once
    size = np.diff(np.append(unit, len(points)))
    h = _hash_units(points, unit, size)
    _, chosen, which = np.unique(h, return_index=True, return_inverse=True)
    chars = gather(unit[chosen], size[chosen])
    word = np.repeat(np.arange(len(chosen)), size[chosen])
    code = points[chars]
    # no piece reaches over neighbours that occur inside none: words fall into parts there
    pair = code[:-1] << 32 | code[1:]
    near = np.minimum(np.searchsorted(m.inner, pair), len(m.inner) - 1)
    part = np.cumsum(np.concatenate([[True], (word[1:] != word[:-1]) | (m.inner[near] != pair)])) - 1
    spot = np.minimum(np.searchsorted(m.chars, code), len(m.chars) - 1)
    sym, at, _ = merge_rounds(m, np.where(m.chars[spot] == code, m.char_symbol[spot], -1), part)
    word = word[at]
    # symbols that are no pieces fall back to the bytes of their character
    plain = (sym >= 0) & (sym < m.n_pieces)
    lost = np.flatnonzero(~plain)
    count = np.ones(len(sym), np.int64)
    c = code[at[lost]]
    count[lost] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
    begin = np.cumsum(count) - count
    ids = np.repeat(sym, count)
    for n, mark in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
        at_n, c_n = begin[lost][count[lost] == n], c[count[lost] == n]
        for k in range(n):
            low = c_n >> 6 * (n - 1 - k)
            ids[at_n + k] = m.byte_id[mark | low if k == 0 else 0x80 | low & 0x3F]
    per_word = np.bincount(word, count, minlength=len(chosen)).astype(np.int64)
    from_word = np.cumsum(per_word) - per_word
    out = ids[gather(from_word[which], per_word[which])].astype(np.int32)
    ends = np.concatenate([[0], np.cumsum(per_word[which])])
    bound = np.zeros(n_docs + 1, np.int64)
    first_unit = np.searchsorted(unit, starts)
    bound[full + 1] = ends[np.append(first_unit[1:], len(unit))]
    return out, np.maximum.accumulate(bound)


def _hash_units(points: np.ndarray, unit: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of code points: sums of mixed (place, code point) numbers in two ways."""
    place = np.arange(len(points)) - np.repeat(unit, size)
    a = mix(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(place.astype(np.uint64)))
    return mix(np.add.reduceat(a, unit) ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def decode_batch(m: Bpe, ids: np.ndarray, bound: np.ndarray) -> list[str]:
    """Texts of id lists: pieces joined, spaces for the space sign, the dummy prefix dropped, byte runs
    read as UTF-8 with a replacement character where they are none."""
    size = np.diff(m.piece_start)[ids]
    raw = m.piece_bytes[gather(m.piece_start[ids], size)].tobytes()
    edge = np.concatenate([[0], np.cumsum(size)])[bound]
    texts = (raw[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))
    lead = m.piece_bytes[m.piece_start[np.minimum(ids, m.n_pieces - 1)]] if len(ids) else ids
    out = []
    for k, t in enumerate(texts):
        a = bound[k]
        drop = a < bound[k + 1] and size[a] and lead[a] == 0x20
        out.append(t[1 if drop else 0 :].decode("utf-8", "replace"))
    return out


def encode_pieces(docs: DataFrame, model: str, text: str = "text", decode: bool = True) -> DataFrame:
    """Adds ``ids array<int>`` and, if asked, ``decoded string`` (of the ids) to ``docs``.

    ``model`` is the path of a SentencePiece BPE model, read on the driver (its vocabulary is bounded)
    and sent with the tasks. No begin or end ids, no sampling. Null and empty texts have no ids and
    decode to an empty text. Texts of any length are encoded whole; each task holds one part of a batch.
    Repeated rows are encoded alike, empty tables give no rows.
    Other columns are kept; columns named ``ids`` or ``decoded`` are replaced.
    """
    with open(model, "rb") as f:
        raw = f.read()
    load_model(raw)
    docs = docs.select(*[c for c in docs.columns if c not in ("ids", "decoded")])
    place = docs.columns.index(text)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load_model(raw)
        for batch in batches:
            for part in slices(batch, place, STEP // 2):  # arrays of a part take over a hundred bytes a character
                ids, bound = encode_batch(m, *buffers(part.column(place)))
                columns = [*part.columns, pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()))]
                names = [*part.schema.names, "ids"]
                if decode:
                    columns.append(pa.array(decode_batch(m, ids, bound), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = docs.withColumn("ids", F.array().cast("array<int>"))
    schema = (schema.withColumn("decoded", F.lit("")) if decode else schema).schema
    return docs.mapInArrow(task, schema)
