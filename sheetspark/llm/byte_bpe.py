"""Byte-level BPE: encoding by a rank file, and decoding with offsets.

Text is cut without regular expressions. Every code point has a class; a class is
a function from state to state of a small machine that knows which kind of piece
is open. Functions compose associatively, and the machine's functions and their
compositions are few, so each is one byte and a composition is one table look-up.
A scan over blocks (all blocks at once, position by position, then the blocks'
totals) gives the state before each code point, and state and class tell whether
a piece begins there. The pieces feed pair merging with a cache.

The pattern is that of the vocabulary package: contractions after an apostrophe,
runs of letters, numbers or other signs with one space in front, and runs of white
space that leave one blank for what follows.

Results at the edges: null text gives no ids, as does empty text; any id list
decodes to bytes; a null id list decodes to empty bytes; equal rows get equal ids; an
empty table stays empty; result columns replace input columns of their names, all others
pass, whatever their names. A very long text is cut before a space that is followed by
a letter and preceded by one, where a piece begins whatever stands around; only a text without such
places is taken as one.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetspark.llm.common import runs, texts_of, with_arrow

# classes of code points; the last four depend on what follows
LETTER, NUMBER, OTHER, BLANK, APOS1, APOS2, SPACE_THEN, BLANK_THEN, GAP = range(9)
N_CLASSES = 9
# states: nothing open, a letter, number, sign or blank run, one space, and one or two more letters of a contraction
NONE, IN_L, IN_N, IN_O, IN_B, ONE_SPACE, ONE_MORE, TWO_MORE = range(8)
N_STATES = 8
BLOCK = 64
TEXT_RUN = 500_000


def step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a code point of this class, and whether a piece begins with it."""
    if kind == GAP:
        return NONE, True
    if state in (ONE_MORE, TWO_MORE) and kind == LETTER:
        return (NONE if state == ONE_MORE else ONE_MORE), False
    run = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}.get(kind)
    if run is not None:
        return run, state not in (run, ONE_SPACE)
    if kind in (APOS1, APOS2):  # an apostrophe begins a contraction only where a piece begins
        if state in (IN_O, ONE_SPACE):
            return IN_O, False
        return (ONE_MORE if kind == APOS1 else TWO_MORE), True
    if kind == BLANK:
        return IN_B, state != IN_B
    return (ONE_SPACE if kind == SPACE_THEN else NONE), True


@cache
def machine() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compositions, effects and beginnings of the machine's functions.

    Elements 0 to 8 are the classes; the others are compositions of them.
    ``compose[a << 8 | b]`` is first a, then b; ``apply[e << 3 | s]`` the state
    after e from s; ``begins[s * 9 + class]`` whether a piece begins.
    """
    functions = [tuple(step(s, c)[0] for s in range(N_STATES)) for c in range(N_CLASSES)]
    number = {}
    for i, f in enumerate(functions):
        number.setdefault(f, i)
    i = 0
    while i < len(functions):
        for j in range(N_CLASSES):
            f = tuple(functions[j][s] for s in functions[i])
            if f not in number:
                number[f] = len(functions)
                functions.append(f)
        i += 1
    if len(functions) > 256:
        raise AssertionError("the machine's functions don't fit a byte")
    compose = np.zeros(1 << 16, np.uint8)
    for a, f in enumerate(functions):
        for b, g in enumerate(functions):
            compose[a << 8 | b] = number[tuple(g[s] for s in f)]
    apply = np.zeros(256 * N_STATES, np.uint8)
    for e, f in enumerate(functions):
        apply[e << 3 : (e << 3) + 8] = f
    begins = np.array([step(s, c)[1] for s in range(N_STATES) for c in range(N_CLASSES)])
    return compose, apply, begins


def scanned(elements: np.ndarray, compose: np.ndarray) -> np.ndarray:
    """Inclusive scan of function elements under composition."""
    n = len(elements)
    if n <= BLOCK:
        out = elements.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) << 8 | int(out[i])]
        return out
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, GAP, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    for j in range(1, BLOCK):
        grid[j] = compose[(grid[j - 1].astype(np.uint16) << 8) | grid[j]]
    before = scanned(grid[-1], compose)[:-1].astype(np.uint16) << 8
    grid[:, 1:] = compose[before[None, :] | grid[:, 1:]]
    return grid.T.reshape(-1)[:n]


@cache
def class_table() -> np.ndarray:
    """LETTER, NUMBER, BLANK or OTHER of each code point, as the tiktoken library's own engine says.

    Whatever a pattern doesn't match, the library drops; so encoding all code
    points as single bytes shows which ones a class holds, in its Unicode version.
    """
    import tiktoken

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        engine = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[[ord(c) for c in bytes(engine.encode_ordinary(text)).decode()]] = kind
    return table


def class_bytes() -> bytes:
    return class_table().tobytes()


def piece_starts(texts: list[str], classes: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined by a gap each, where pieces and gaps begin, and the gaps' places.

    What stands between two starts is a piece, except for the gaps.
    """
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = classes[codes]
    gaps = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[gaps] = GAP
    blank = kinds == BLANK
    # white space that stands before something else than white space, the end included
    last = blank.copy()
    last[:-1] &= ~blank[1:] & (kinds[1:] != GAP)
    space = codes == 32
    kinds[last & space] = SPACE_THEN
    kinds[last & ~space] = BLANK_THEN
    apostrophes = np.flatnonzero((codes == 39) & (kinds == OTHER))
    if len(apostrophes):
        inside = kinds != GAP
        size = len(codes)
        one, two = np.minimum(apostrophes + 1, size - 1), np.minimum(apostrophes + 2, size - 1)
        a = np.where(inside[one], codes[one], 0)
        b = np.where(inside[one] & inside[two], codes[two], 0)
        kinds[apostrophes[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        pairs = np.zeros(len(a), bool)
        for x, y in ("re", "ve", "ll"):
            pairs |= (a == ord(x)) & (b == ord(y))
        kinds[apostrophes[pairs]] = APOS2
    compose, apply, begins = machine()
    after = apply[(scanned(kinds, compose).astype(np.uint16) << 3) | NONE]
    state = np.empty_like(after)
    state[0], state[1:] = NONE, after[:-1]
    return joined, np.flatnonzero(begins[state * np.uint8(N_CLASSES) + kinds]), gaps


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Joins the adjacent pair of least rank, leftmost first, until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 48:
        return merged_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
    while True:
        known = [r for r in pair if r is not None]
        if not known:
            return [ranks[p] for p in parts]
        i = pair.index(min(known))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1])
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i])


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap and links, in n log n steps, for pieces that may be very long."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and end[i] < n:
            r = ranks.get(piece[i : end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
        offer(i)
        offer(before[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class PieceCache(dict):
    """Ids of a piece as packed int32; emptied when it holds ``limit`` pieces, or 32 characters for each of as many."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 300_000):
        self.ranks, self.limit, self.held = ranks, limit, 0

    def __missing__(self, piece: str) -> bytes:
        self.held += len(piece)
        if len(self) >= self.limit or self.held >= 32 * self.limit:
            self.clear()
            self.held = len(piece)
        self[piece] = packed = np.asarray(merged(piece.encode(), self.ranks), np.int32).tobytes()
        return packed


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, classes: np.ndarray | None = None):
        self.ranks = load_ranks(ranks_path)
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int32)
        self.classes = class_table() if classes is None else classes
        self.cache = PieceCache(self.ranks)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a very long one by its parts."""
        if not any(len(t) > 2 * TEXT_RUN for t in texts):
            return self.encode_runs(texts)
        parts = [split_long(t) for t in texts]
        ids = iter(self.encode_runs([p for own in parts for p in own]))
        return [np.concatenate([next(ids) for _ in own]) for own in parts]

    def encode_runs(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for a, b in runs(texts, TEXT_RUN):
            joined, starts, gaps = piece_starts(texts[a:b], self.classes)
            places = starts.tolist()
            look = self.cache.__getitem__
            first = 0
            for stop in np.searchsorted(starts, gaps).tolist():
                cuts = places[first : stop + 1]
                pieces = [joined[x:y] for x, y in zip(cuts, cuts[1:])]
                out.append(np.frombuffer(b"".join(map(look, pieces)), np.int32))
                first = stop + 1
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token begins in the decoded text."""
        sizes = self.lengths[ids]
        return (np.cumsum(sizes) - sizes).astype(np.int32)

    def check(self, ids: np.ndarray, lengths: np.ndarray, given: pa.ListArray) -> None:
        """Raises ValueError unless ``given`` has the offsets of the ids, of which each row has so many."""
        sizes = self.lengths[ids]
        starts = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        own = starts[:-1] - np.repeat(starts[np.cumsum(lengths) - lengths], lengths)
        told = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        if not np.array_equal(told, lengths) or not np.array_equal(given.flatten().to_numpy(zero_copy_only=False), own):
            raise ValueError("token offsets are not those of the ids")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: A space between two letters of the Latin alphabet: there a piece begins, under any pattern of this kind.
SEAM = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def split_long(text: str) -> list[str]:
    """A text in parts of about ``TEXT_RUN`` characters, whose pieces are those of the text."""
    out, at = [], 0
    while len(text) - at > 2 * TEXT_RUN and (seam := SEAM.search(text, at + TEXT_RUN)):
        out.append(text[at : seam.start()])
        at = seam.start()
    return [*out, text[at:]]


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str, classes: bytes | None = None) -> ByteBpe:
    """One encoder a worker process and rank file."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path, None if classes is None else np.frombuffer(classes, np.uint8))
    return _loaded[path]


def int_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))


def covering(offsets: np.ndarray, start: int, stop: int) -> tuple[int, int]:
    """The range of tokens, told by the byte at which each begins, that covers bytes start to stop."""
    first = max(int(np.searchsorted(offsets, start, "right")) - 1, 0)
    return first, max(first, int(np.searchsorted(offsets, stop, "left")))


INTS = T.ArrayType(T.IntegerType())


def encode(docs: DataFrame, ranks_path: str, text: str = "text", offsets: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Adds ``token_ids`` and, if asked for, ``token_offsets`` (the byte at which each token begins)."""
    shared = docs.sparkSession.sparkContext.broadcast(class_bytes())  # 1.1 MB, whatever the data
    fields = [T.StructField("token_ids", INTS), T.StructField("token_offsets", INTS)][: 1 + offsets]

    def make():
        bpe = loaded(ranks_path, shared.value)

        def call(column: pa.Array) -> list[pa.Array]:
            ids = bpe.encode(texts_of(column))
            return [int_lists(ids), int_lists([bpe.offsets(x) for x in ids])][: 1 + offsets]

        call.close = bpe.cache.clear  # texts of another task have other rare pieces
        return call

    return with_arrow(docs, [text], fields, make, keep)


def decode(rows: DataFrame, ranks_path: str, ids: str = "token_ids", keep: list[str] | None = None, offsets: str | None = None) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids; they needn't be whole characters.

    With a column of ``offsets`` each token must begin where that says; if one doesn't, this raises ValueError.
    """

    def make():
        bpe = loaded(ranks_path)

        def call(column: pa.Array, given: pa.Array | None = None) -> list[pa.Array]:
            filled = np.asarray(column.flatten(), np.int32)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            if given is not None:
                bpe.check(filled, lengths, given)
            return [pa.array([bpe.decode(filled[e - n : e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)], pa.binary())]

        return call

    return with_arrow(rows, [ids] if offsets is None else [ids, offsets], [T.StructField("decoded", T.BinaryType())], make, keep)


def decode_range(rows: DataFrame, ranks_path: str, start: str, stop: str, ids: str = "token_ids", offsets: str = "token_offsets", keep: list[str] | None = None) -> DataFrame:
    """Adds ``decoded_range``, the bytes from ``start`` to ``stop`` (columns) of what the ids decode to.

    The offsets tell which tokens cover them, and only those are decoded. A range beyond the end ends there; null bounds, or
    a null list, give null.
    """

    def make():
        bpe = loaded(ranks_path)

        def call(column: pa.Array, places: pa.Array, starts: pa.Array, stops: pa.Array) -> list[pa.Array]:
            out = []
            for k, (a, b) in enumerate(zip(starts.to_pylist(), stops.to_pylist(), strict=True)):
                if a is None or b is None or not column[k].is_valid or not places[k].is_valid:
                    out.append(None)
                    continue
                at = places[k].values.to_numpy(zero_copy_only=False)
                a = max(a, 0)
                first, last = covering(at, a, max(a, b))
                begin = int(at[first]) if first < len(at) else 0
                out.append(bpe.decode(column[k].values.to_numpy(zero_copy_only=False)[first:last])[a - begin : max(a, b) - begin])
            return [pa.array(out, pa.binary())]

        return call

    return with_arrow(rows, [ids, offsets, start, stop], [T.StructField("decoded_range", T.BinaryType())], make, keep)
