"""Decompression of the five blob formats: magic, big-endian size, then bits, most significant first.

`inflate` never raises: it returns the bytes, or the reason why there are none. The matching
encoders are what test payloads are made with.
"""

from __future__ import annotations

import itertools

import numpy as np

TRUNCATED, LIMIT, CORRUPT = "Truncated", "LimitExceeded", "CompressionError"
DEFAULT_LIMIT = 64 << 20
#: Bit that announces a literal, by magic.
_LITERAL = {b"EA04": 0, b"EA05": 0, b"EA06": 1}
_HUFFMAN = (b"JB00", b"JB01")
#: Match lengths: least length of a stage and the bits that tell the length; all ones go on to the next stage.
_STAGES = ((3, 2), (6, 3), (13, 5), (44, 8), (299, 8))
_LZ_OFFSET_BITS = 15
_REACH = (1 << _LZ_OFFSET_BITS) - 1
#: More than any count.
_NEVER = 1 << 62
#: Symbols of the two adaptive codes, the first that is a length, the shortest match, the longest code.
_SYMBOLS, _FIRST_LENGTH, _OFFSETS, _SHORTEST, _LONGEST_CODE = 288, 256, 32, 3, 16


class _Stop(Exception):
    pass


class BitWriter:
    """Collects bits, most significant first; the last byte is filled with zeros."""

    def __init__(self):
        self.held, self.count, self.out = 0, 0, bytearray()

    def put(self, value: int, n: int) -> None:
        self.held = (self.held << n) | value
        self.count += n
        if self.count >= 64:
            self._spill()

    def _spill(self) -> None:
        whole = self.count // 8
        left = self.count - 8 * whole
        self.out += (self.held >> left).to_bytes(whole, "big")
        self.held, self.count = self.held & ((1 << left) - 1), left

    def bytes(self) -> bytes:
        self._spill()
        return bytes(self.out) + ((self.held << (8 - self.count)).to_bytes(1, "big") if self.count else b"")


def inflate(blob: bytes, limit: int = DEFAULT_LIMIT) -> tuple[bytes | None, str | None]:
    """(bytes, None) or (None, reason)."""
    return inflate_many([blob], limit)[0]


def inflate_many(blobs: list[bytes], limit: int = DEFAULT_LIMIT) -> list[tuple[bytes | None, str | None]]:
    """inflate of each, with the trees of all adaptive codes built together."""
    out: list = [None] * len(blobs)
    later = []
    for k, blob in enumerate(blobs):
        magic, size = blob[:4], int.from_bytes(blob[4:8], "big")
        if len(blob) < 8:
            out[k] = None, TRUNCATED
        elif size > limit:
            out[k] = None, LIMIT
        elif magic in _LITERAL:
            try:
                out[k] = _lz(blob, size, _LITERAL[magic]), None
            except _Stop as stop:
                out[k] = None, str(stop)
        elif magic in _HUFFMAN:
            later.append(k)
        else:
            out[k] = None, CORRUPT
    found = _abreast([blobs[k] for k in later]) if len(later) >= _ABREAST else [None] * len(later)
    tasks = [_adaptive(blobs[k], int.from_bytes(blobs[k][4:8], "big"), *(f or ())) for k, f in zip(later, found, strict=True) if not isinstance(f, (bytes, _Stop))]
    rest = iter(_together(tasks, False))
    for k, f in zip(later, found, strict=True):
        found = f if isinstance(f, (bytes, _Stop)) else next(rest)
        out[k] = (None, str(found)) if isinstance(found, _Stop) else (found, None)
    return out


def _copy(out: bytearray, offset: int, length: int, size: int) -> None:
    if not 0 < offset <= len(out) or len(out) + length > size:
        raise _Stop(CORRUPT)
    if offset >= length:
        out += out[len(out) - offset : len(out) - offset + length]
    else:
        unit = bytes(out[-offset:])
        out += (unit * (length // offset + 1))[:length]


def _length_digits(length: int) -> str:
    """A match length as binary digits."""
    digits = ""
    for least, width in _STAGES:
        full = (1 << width) - 1
        if length - least < full:
            return digits + format(length - least, f"0{width}b")
        digits += "1" * width
    whole, rest = divmod(length - least - full, full)
    return digits + "1" * (width * whole) + format(rest, f"0{width}b")


def _lz(blob: bytes, size: int, literal: int) -> bytes:
    """Bits are read as digits, so that a literal and a short match length are one lookup each."""
    out, digits, p, at, flag = bytearray(), "", 0, 8, _DIGIT[literal]
    single, short, append = _SINGLE[literal].get, _SHORT.get, out.append
    last, end = -1, len(blob)
    while len(out) < size:
        if p > last and at < end:
            chunk = blob[at : at + _WINDOW]
            at += len(chunk)
            digits, p = digits[p:] + format(int.from_bytes(chunk, "big"), f"0{8 * len(chunk)}b"), 0
            last = len(digits) - _LONGEST_TOKEN
        if digits[p : p + 1] == flag:
            byte = single(digits[p : p + 9])
            if byte is None:
                raise _Stop(TRUNCATED)
            append(byte)
            p += 9
            continue
        head = digits[p + 1 : p + 16]
        if len(head) < _LZ_OFFSET_BITS:
            raise _Stop(TRUNCATED)
        offset, p = int(head, 2), p + 16
        length, used = short(digits[p : p + 10], (0, 0))
        if not length:
            length, used = _match_length(digits, p)
            if not length:
                # The length goes on beyond what is held, or the data ends in it.
                digits = digits[p:] + "".join(format(b, "08b") for b in blob[at:])
                p, at, last = 0, end, -1
                length, used = _match_length(digits, p)
                if not length:
                    raise _Stop(TRUNCATED)
        p += used
        done = len(out)
        if offset >= length and offset <= done and done + length <= size:
            out += out[done - offset : done - offset + length]
        else:
            _copy(out, offset, length, size)
    return bytes(out)


def _match_length(digits: str, p: int) -> tuple[int, int]:
    """The length that begins at p and its digits; zeros where digits end before."""
    began = p
    for least, width in _STAGES:
        part = digits[p : p + width]
        if len(part) < width:
            return 0, 0
        p += width
        if "0" in part:
            return least + int(part, 2), p - began
    length, ones = _STAGES[-1][0] + (1 << width) - 1, "1" * width
    while (part := digits[p : p + width]) == ones:
        length += (1 << width) - 1
        p += width
    return (length + int(part, 2), p + width - began) if len(part) == width else (0, 0)


#: Bytes by their digits behind a flag, match lengths as codes, and what the first ten digits of a length say.
_DIGIT = "01"
_SINGLE = [{f"{flag}{b:08b}": b for b in range(256)} for flag in (0, 1)]
_LONGEST_LZ = 2000
_LENGTH_DIGITS = ["0"] * 3 + [_length_digits(n) for n in range(3, _STAGES[-1][0] + (1 << _STAGES[-1][1]) - 1)]
_LENGTH_CODES, _LENGTH_SIZES = np.array([int(d, 2) for d in _LENGTH_DIGITS]), np.array([len(d) for d in _LENGTH_DIGITS])
_SHORT = {f"{v:010b}": _match_length(f"{v:010b}", 0) for v in range(1024)}
#: Bytes turned to digits at once, and digits that the next token may need unless its match is very long.
_WINDOW, _LONGEST_TOKEN = 8192, 64


class AdaptiveCode:
    """A Huffman code that is rebuilt from its symbols' counts, often at first and rarely later."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.first_wait, self.full_wait = symbols // 4, symbols * 12
        self.counts = [1] * symbols
        self.settled, self.grown, self.left, self.halve = False, self.first_wait, self.first_wait, False
        self.kids, self.table, self.look = None, None, None

    def _build(self) -> None:
        """The tree: kids holds each node's two children. Leaves by count and new nodes are two queues, both ascending; of equal ones the leaf goes first."""
        n = self.symbols
        while True:
            order = sorted(range(n), key=self.counts.__getitem__)
            leaf = [self.counts[i] for i in order] + [_NEVER] * 2
            made = [_NEVER] * (n + 1)
            kids, i, j = [0] * (4 * n - 2), 0, 0
            for k in range(n - 1):
                total = 0
                for side in (2 * (n + k), 2 * (n + k) + 1):
                    if leaf[i] <= made[j]:
                        kids[side] = order[i]
                        total += leaf[i]
                        i += 1
                    else:
                        kids[side] = n + j
                        total += made[j]
                        j += 1
                made[k] = total
            depth = [0] * (2 * n - 1)
            for node in range(2 * n - 2, n - 1, -1):
                depth[kids[2 * node]] = depth[kids[2 * node + 1]] = depth[node] + 1
            if max(depth[:n]) <= _LONGEST_CODE:
                self.kids = kids
                return
            self.counts = [(c >> 2) + 1 for c in self.counts]

    def due(self) -> None:
        """Set the next wait; called when the last has run out, before the code is rebuilt."""
        self.halve = self.settled
        if self.settled:
            self.left = self.full_wait
        else:
            # The wait stays short until the grown interval has reached the full one.
            self.grown += self.first_wait
            self.settled = self.grown >= self.full_wait
            self.left = self.first_wait


#: From this number of codes on, their trees are built together.
_MANY = 12
#: No code of counts that add up to less is longer than _LONGEST_CODE: each bit more takes the next Fibonacci number.
_SURELY_SHORT = 4181
#: Bits of a code that are looked up at once, by the number of symbols; the tree's steps follow.
_FIRST_BITS = {_SYMBOLS: 7, _OFFSETS: 5}
#: Trees built at once, so that their arrays stay small.
_COLUMNS = 4096


def rebuild(codes: list[AdaptiveCode], writing: bool) -> None:
    """Build the trees of codes over equally many symbols, and what reading or writing needs of them."""
    n, alone = codes[0].symbols, codes
    if len(codes) >= _MANY:
        counts = np.array([c.counts for c in codes], np.int64).T
        kids, alone = _trees(counts), []
        if writing or counts.sum(0).max() >= _SURELY_SHORT:
            words = _many_words(kids)
            # Trees that are too deep are built one by one, as their counts shrink.
            alone = [c for c, x in zip(codes, (words.max(0) >> (_LONGEST_CODE + 1)).tolist(), strict=True) if x]
        _give(codes, words.T if writing else np.where(kids < n, ~kids, 2 * (kids - n)), writing)
    for code in alone:
        code._build()
        _give([code], np.array([_words(code.kids, n)]) if writing else np.array([[~k if k < n else 2 * (k - n) for k in code.kids[2 * n :]]]).T, writing)
    for code in codes:
        if code.halve:
            code.counts = [(c >> 1) + 1 for c in code.counts]


def _give(codes: list[AdaptiveCode], made: np.ndarray, writing: bool) -> None:
    """Set the tables of codes: to write, words by symbol (a row a code); to read, steps in the tree (a column a code) and what the first bits lead to."""
    for code, table in zip(codes, (made if writing else made.T).tolist(), strict=True):
        code.table = table
    if writing:
        return
    for code, look in zip(codes, _looks(made, _FIRST_BITS[codes[0].symbols]).T.tolist(), strict=True):
        code.look = look


def _looks(steps: np.ndarray, first: int) -> np.ndarray:
    """What the first bits lead to in each column's tree: a symbol and its bits, or (negative) the step to go on from."""
    many, flat = steps.shape[1], steps.ravel()
    columns, at, used = np.arange(many), np.full((1, many), len(steps) - 2), np.zeros((1, many), np.int64)
    for _ in range(first):
        inner = at >= 0
        place = np.maximum(at, 0) * many + columns
        at = np.stack([np.where(inner, flat.take(place), at), np.where(inner, flat.take(place + many), at)], 1).reshape(-1, many)
        used = np.repeat(used + inner, 2, 0)
    return np.where(at < 0, ~at << 4 | used, ~at)


def _words(kids: list[int], n: int) -> list[int]:
    """Each symbol's code behind a one."""
    words = [1] * (2 * n - 1)
    for node in range(2 * n - 2, n - 1, -1):
        words[kids[2 * node]], words[kids[2 * node + 1]] = 2 * words[node], 2 * words[node] + 1
    return words[:n]


def _trees(counts: np.ndarray) -> np.ndarray:
    """AdaptiveCode._build for each column of counts: the children of inner nodes, two rows a node."""
    n, many = counts.shape
    if many > _COLUMNS:
        return np.hstack([_trees(counts[:, k : k + _COLUMNS]) for k in range(0, many, _COLUMNS)])
    # Count and place in one number, leaves before nodes: the lesser of the queues' heads is the next child.
    bits = (2 * n).bit_length()
    kind = np.int32 if int(counts.sum(0).max()) << bits < 1 << 31 else np.int64
    mask, never = kind((1 << bits) - 1), np.iinfo(kind).max
    leaf, made = np.full((n + 2, many), never, kind), np.full((n + 1, many), never, kind)
    leaf[:n] = np.sort(counts.T.astype(kind) << bits | np.arange(n, dtype=kind), 1).T
    kids, leaf, flat = np.empty((2 * n - 2, many), kind), leaf.ravel(), made.ravel()
    i = np.arange(many)
    # A child is taken from one queue or the other, so both places add up to what was taken.
    both, j, own, other, step = 2 * i, np.empty_like(i), np.empty(many, kind), np.empty(many, kind), np.empty_like(i)
    for k in range(n - 1):
        for side in (2 * k, 2 * k + 1):
            leaf.take(i, out=own, mode="clip")
            np.subtract(both, i, out=j)
            flat.take(j, out=other, mode="clip")
            np.minimum(own, other, out=kids[side])
            np.multiply(own < other, many, out=step)
            i += step
            both += many
        made[k] = (kids[2 * k] & ~mask) + (kids[2 * k + 1] & ~mask) | kind(n + k)
    return kids & mask


def _many_words(kids: np.ndarray) -> np.ndarray:
    """_words for each column of kids."""
    inner, many = kids.shape
    n, columns = inner // 2 + 1, np.arange(many)
    words = np.ones((2 * n - 1, many), np.int64)
    flat, places = words.ravel(), kids * many + columns
    for k in range(n - 2, -1, -1):
        double = words[n + k] << 1
        flat[places[2 * k]] = double
        flat[places[2 * k + 1]] = double + 1
    return words[:n]


def _together(tasks: list, writing: bool) -> list:
    """Run generators that yield codes to be rebuilt, and rebuild those of all together; their results, or what they raise."""
    out: list = [None] * len(tasks)
    running, due = [*enumerate(tasks)], {}
    while running:
        for k, task in running:
            try:
                code = next(task)
            except StopIteration as end:
                out[k] = end.value
            except _Stop as stop:
                out[k] = stop
            else:
                due.setdefault(code.symbols, []).append((k, task, code))
        # The small codes go first, until every task waits for its large one.
        running = due.pop(min(due)) if due else []
        if running:
            rebuild([code for _, _, code in running], writing)
            running = [(k, task) for k, task, _ in running]
    return out


#: Of symbols from _FIRST_LENGTH on and of offsets: the least value, and the number of bits that follow.
_LENGTH_VALUES = [(k, 0) for k in range(8)] + [((1 << (e + 2)) + (part << e), e) for e in range(1, 7) for part in range(4)]
_OFFSET_VALUES = [(k, 0) for k in range(4)] + [((1 << (e + 1)) + (part << e), e) for e in range(1, 15) for part in range(2)]
#: Bytes of a blob that are turned to bits at once, and the most that a literal or match takes.
_BITS_WINDOW, _LONGEST_STEP = 16384, 64


def _start(writing: bool) -> tuple[AdaptiveCode, AdaptiveCode]:
    codes = AdaptiveCode(_SYMBOLS), AdaptiveCode(_OFFSETS)
    for code in codes:
        if (writing, code.symbols) not in _FIRST_TABLES:
            rebuild([code], writing)
            _FIRST_TABLES[writing, code.symbols] = code.table, code.look
        code.table, code.look = _FIRST_TABLES[writing, code.symbols]
    return codes


_FIRST_TABLES: dict[tuple[bool, int], tuple] = {}


def _adaptive(blob: bytes, size: int, codes: tuple[AdaptiveCode, AdaptiveCode] | None = None, so_far: bytes = b"", place: int = 64):
    """Reads a blob, or goes on from what is so far read of it; yields each code that is to be rebuilt."""
    literals, offsets = codes or _start(False)
    table, look, counts, left, first = literals.table, literals.look, literals.counts, literals.left, _FIRST_BITS[_SYMBOLS]
    table2, look2, counts2, left2, first2 = offsets.table, offsets.look, offsets.counts, offsets.left, _FIRST_BITS[_OFFSETS]
    out, number, total = bytearray(so_far), int.from_bytes, 8 * len(blob)
    bits, ahead, base, p, last, at, skipped = b"", b"", place & ~7, 0, -1, place >> 3, place & 7

    def extra(place: int, n: int) -> int:
        if place + n > total:
            raise _Stop(TRUNCATED)
        byte = place >> 3
        return number(blob[byte : byte + 4], "big") >> (8 * min(4, len(blob) - byte) - (place & 7) - n) & ((1 << n) - 1)

    try:
        while len(out) < size:
            if p > last and at < len(blob):
                chunk = blob[at : at + _BITS_WINDOW]
                base, bits, p, at, skipped = base + p, bits[p:] + np.unpackbits(np.frombuffer(chunk, np.uint8)).tobytes(), skipped, at + len(chunk), 0
                last = len(bits) - _LONGEST_STEP
                # The next bits of every place as a number, so that a code's first ones are one lookup.
                padded, most = np.frombuffer(bits + bytes(first), np.uint8), len(bits)
                ahead = padded[:most] << (first - 1)
                for k in range(1, first):
                    ahead |= padded[k : most + k] << (first - 1 - k)
                ahead = ahead.tobytes()
            x = look[ahead[p]]
            if x >= 0:
                p += x & 15
                symbol = x >> 4
            else:
                x = ~x
                p += first
                while x >= 0:
                    x = table[x + bits[p]]
                    p += 1
                symbol = ~x
            if base + p > total:
                raise _Stop(TRUNCATED)
            counts[symbol] += 1
            left -= 1
            if not left:
                literals.due()
                yield literals
                table, look, counts, left = literals.table, literals.look, literals.counts, literals.left
            if symbol < _FIRST_LENGTH:
                out.append(symbol)
                continue
            length, n = _LENGTH_VALUES[symbol - _FIRST_LENGTH]
            if n:
                length += extra(base + p, n)
                p += n
            x = look2[ahead[p] >> first - first2]
            if x >= 0:
                p += x & 15
                symbol = x >> 4
            else:
                x = ~x
                p += first2
                while x >= 0:
                    x = table2[x + bits[p]]
                    p += 1
                symbol = ~x
            if base + p > total:
                raise _Stop(TRUNCATED)
            counts2[symbol] += 1
            left2 -= 1
            if not left2:
                offsets.due()
                yield offsets
                table2, look2, counts2, left2 = offsets.table, offsets.look, offsets.counts, offsets.left
            offset, n = _OFFSET_VALUES[symbol]
            if n:
                offset += extra(base + p, n)
                p += n
            length += _SHORTEST
            done = len(out)
            if length <= offset <= done and done + length <= size:
                out += out[done - offset : done - offset + length]
            else:
                _copy(out, offset, length, size)
    except IndexError:
        raise _Stop(TRUNCATED) from None
    return bytes(out)


#: Fewer blobs than this are read one after the other.
_ABREAST = 64
_LENGTHS, _OFFSET_STARTS = np.array(_LENGTH_VALUES).T, np.array(_OFFSET_VALUES).T
_MATCH = 17


class _Codes:
    """One adaptive code of each of many blobs, as arrays with a row a blob."""

    def __init__(self, many: int, first: AdaptiveCode):
        n = self.symbols = first.symbols
        self.first, self.width = _FIRST_BITS[n], 2 * n - 2
        self.counts, self.left, self.dues = np.ones((many, n), np.int32), np.full(many, first.first_wait), np.zeros(many, np.int64)
        self.steps, self.look = np.tile(np.array(first.table, np.int16), (many, 1)), np.tile(np.array(first.look, np.int32), (many, 1))
        self.flat_counts, self.flat_steps, self.flat_look = self.counts.ravel(), self.steps.ravel(), self.look.ravel()

    def read(self, rows: np.ndarray, words: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places of the bits, and how many bits they take."""
        ahead = words.take(place >> 3) >> (16 - (place & 7)) & 0xFFFF
        found = self.flat_look.take((rows << self.first) + (ahead >> (16 - self.first)))
        symbol, used = found >> 4, found & 15
        at = np.flatnonzero(found < 0)
        if at.size:
            step, bits, base, n = ~found[at], ahead[at], rows[at] * self.width, self.first
            while at.size:
                step = self.flat_steps.take(base + step + (bits >> (15 - n) & 1))
                n += 1
                leaf = step < 0
                symbol[at[leaf]], used[at[leaf]] = ~step[leaf], n
                inner = ~leaf
                at, step, bits, base = at[inner], step[inner], bits[inner], base[inner]
        return symbol, used

    def count(self, rows: np.ndarray, symbol: np.ndarray) -> None:
        self.flat_counts[rows * self.symbols + symbol] += 1
        self.left[rows] -= 1

    def rebuild(self, rows: np.ndarray) -> None:
        n = self.symbols
        self.dues[rows] += 1
        late = self.dues[rows] >= _DUES
        self.left[rows] = np.where(late, 12 * n, n // 4)
        deep = late & (self.counts[rows].sum(1) >= _SURELY_SHORT)
        for row in rows[deep].tolist():
            code = self.one(row)
            code._build()
            self.counts[row], kids = code.counts, np.array(code.kids[2 * n :])[:, None]
            self._set(np.array([row]), kids)
        if not deep.all():
            self._set(rows[~deep], _trees(self.counts[rows[~deep]].T))
        self.counts[rows[late]] = (self.counts[rows[late]] >> 1) + 1

    def _set(self, rows: np.ndarray, kids: np.ndarray) -> None:
        steps = np.where(kids < self.symbols, ~kids, 2 * (kids - self.symbols))
        self.steps[rows], self.look[rows] = steps.T, _looks(steps, self.first).T

    def one(self, row: int) -> AdaptiveCode:
        """A row's code by itself."""
        code = AdaptiveCode(self.symbols)
        code.counts, code.left, code.settled = self.counts[row].tolist(), int(self.left[row]), bool(self.dues[row] >= _DUES - 1)
        code.grown = code.first_wait * (1 + min(int(self.dues[row]), _DUES - 1))
        code.table, code.look = self.steps[row].tolist(), self.look[row].tolist()
        return code


#: The rebuild from which on waits are full and counts are halved.
_DUES = 48


def _abreast(blobs: list[bytes]) -> list:
    """Reads many blobs, a symbol of each at a time: bytes, a reason to stop, or where _adaptive() goes on once few are left."""
    literals, offsets = (_Codes(len(blobs), code) for code in _start(False))
    sizes, lengths = np.array([int.from_bytes(b[4:8], "big") for b in blobs]), np.array([len(b) for b in blobs])
    starts = 8 * (np.cumsum(lengths) - lengths)
    raw = b"".join([*blobs, bytes(16)])
    words = np.ndarray(len(raw) - 3, ">u4", raw, 0, (1,)).astype(np.uint32)
    p, total, done, broken = starts + 64, starts + 8 * lengths, np.zeros(len(blobs), np.int64), np.zeros(len(blobs), np.int8)
    rows_of, values = [], []
    run, due, waiting = np.flatnonzero(sizes > 0), [], []
    alive = len(run)
    while alive >= _ABREAST:
        rows, place = run, p[run]
        symbol, used = literals.read(rows, words, place)
        place += used
        good = place <= total[rows]
        if not good.all():
            broken[rows[~good]] = 1
            rows, place, symbol = rows[good], place[good], symbol[good]
        literals.count(rows, symbol)
        value, grown = symbol, np.ones(len(rows), np.int64)
        at = np.flatnonzero(symbol >= _FIRST_LENGTH)
        if at.size:
            own, here, kind = rows[at], place[at], symbol[at] - _FIRST_LENGTH
            extra = _LENGTHS[1].take(kind)
            length = _LENGTHS[0].take(kind) + _SHORTEST + (words.take(here >> 3) >> (32 - (here & 7) - extra) & ((1 << extra) - 1))
            here += extra
            symbol, used = offsets.read(own, words, here)
            here += used
            offsets.count(own, symbol)
            extra = _OFFSET_STARTS[1].take(symbol)
            offset = _OFFSET_STARTS[0].take(symbol) + (words.take(here >> 3) >> (32 - (here & 7) - extra) & ((1 << extra) - 1))
            here += extra
            before = done[own]
            broken[own] = np.where(here > total[own], 1, 2 * ((offset == 0) | (offset > before) | (before + length > sizes[own])))
            value = value.astype(np.int32)
            value[at], grown[at], place[at] = length << _MATCH | offset, length, here
        p[rows] = place
        done[rows] += grown
        rows_of.append(rows.astype(np.uint16 if len(blobs) < 1 << 16 else np.int32))
        values.append(value.astype(np.int32))
        rows = rows[(done[rows] < sizes[rows]) & (broken[rows] == 0)]
        small, large = offsets.left[rows] == 0, literals.left[rows] == 0
        run = rows[~small & ~large]
        due.append(rows[small])
        waiting.append(rows[large & ~small])
        n_due, n_waiting = sum(map(len, due)), sum(map(len, waiting))
        alive = len(run) + n_due + n_waiting
        # Blobs wait until most do: the small codes go first, until all wait for their large one.
        last = alive < _ABREAST
        if n_due and (last or n_due >= len(run)):
            ready = np.concatenate(due)
            offsets.rebuild(ready)
            large, due = literals.left[ready] == 0, []
            run = np.concatenate([run, ready[~large]])
            waiting.append(ready[large])
            n_waiting = sum(map(len, waiting))
        if n_waiting and (last or not len(run)):
            ready = np.concatenate(waiting)
            literals.rebuild(ready)
            run, waiting = np.concatenate([run, ready]), []
    ends = np.zeros(len(blobs), np.int64)
    if values:
        rows = np.concatenate(rows_of)
        value, ends = np.concatenate(values)[np.argsort(rows, kind="stable")], np.cumsum(np.bincount(rows, minlength=len(blobs)))
        del rows_of, values
    out: list = []
    for row, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        out.append(_Stop(TRUNCATED if broken[row] == 1 else CORRUPT) if broken[row] else _expand(value[a:b].tolist() if a < b else []))
    for row in run.tolist():
        out[row] = (literals.one(row), offsets.one(row)), out[row], int(p[row] - starts[row])
    return out


def _expand(values: list[int]) -> bytes:
    """Bytes of literals and of matches that are known to be good."""
    out = bytearray()
    append, mask = out.append, (1 << _MATCH) - 1
    for value in values:
        if value < _FIRST_LENGTH:
            append(value)
            continue
        length, offset, done = value >> _MATCH, value & mask, len(out)
        if offset >= length:
            out += out[done - offset : done - offset + length]
        else:
            _copy(out, offset, length, done + length)
    return bytes(out)


def _greedy(data: bytes, longest: int) -> list[int]:
    """From left to right literals (below 256) and matches (length << 15 | offset), by the last place of the same three bytes."""
    n = len(data)
    raw = np.frombuffer(data, np.uint8).astype(np.int32)
    keys = (raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16).tolist()
    last: dict[int, int] = {}
    out: list[int] = []
    get, append, at = last.get, out.append, 0
    while at < n - 2:
        key = keys[at]
        back = at - get(key, -_REACH - 1)
        last[key] = at
        if back > _REACH:
            append(data[at])
            at += 1
            continue
        to, most = at + 3, min(at + longest, n)
        while to < most and data[to - back] == data[to]:
            to += 1
            if to - at >= 24:
                while to + 64 <= most and data[to - back : to - back + 64] == data[to : to + 64]:
                    to += 64
        append((to - at) << _LZ_OFFSET_BITS | back)
        at = to
    out += data[at:]
    return out


def _pack(codes: np.ndarray, sizes: np.ndarray) -> bytes:
    """Codes of `sizes` bits (57 at most) one behind the other; the last byte is filled with zeros."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    words = (codes.astype(np.uint64) << (64 - sizes - (starts & 7)).astype(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)
    first, total = starts >> 3, int(ends[-1] + 7) >> 3
    out = np.zeros(total + 8)
    for k in range((int(sizes.max()) + 14) >> 3):
        # Codes share a byte, but no bit.
        out += np.bincount(first + k, words[:, k], total + 8)
    return out[:total].astype(np.uint8).tobytes()


def deflate_lz(data: bytes, magic: bytes = b"EA06", matches: bool = True) -> bytes:
    """A bit-LZ blob; with literals only if matches is false."""
    head, literal = magic + len(data).to_bytes(4, "big"), _LITERAL[magic]
    if not data:
        return head
    values = np.array(_greedy(data, _LONGEST_LZ), np.int64) if matches else np.frombuffer(data, np.uint8).astype(np.int64)
    length, single = values >> _LZ_OFFSET_BITS, values < 256
    if length.max() < len(_LENGTH_SIZES):
        size = _LENGTH_SIZES[length]
        codes = np.where(single, literal << 8 | values, ((1 - literal) << _LZ_OFFSET_BITS | values & _REACH) << size | _LENGTH_CODES[length])
        return head + _pack(codes, np.where(single, 9, 1 + _LZ_OFFSET_BITS + size))
    # The longest matches take more bits than one code may have.
    parts = []
    for v in values.tolist():
        digits = f"{literal}{v:08b}" if v < 256 else f"{1 - literal}{v & _REACH:0{_LZ_OFFSET_BITS}b}" + _length_digits(v >> _LZ_OFFSET_BITS)
        parts += [digits[k : k + 32] for k in range(0, len(digits), 32)]
    codes, sizes = np.array([int(d, 2) for d in parts], np.int64), np.array([len(d) for d in parts], np.int64)
    return head + _pack(codes, sizes)


def _found(data: np.ndarray, ends: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and what _greedy gives for them, of many texts one behind the other (ends: where each place's text ends), with the nearest place of the same three bytes."""
    n = len(data)
    words = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.as_strided(words, (n, 8), (1, 1))).view("<u8").ravel()
    place, width = np.arange(n), n.bit_length()
    known = place + 3 <= ends
    both = np.sort(((words & np.uint64(0xFFFFFF)).astype(np.int64) << width | place)[known])
    key, at = both >> width, both & ((1 << width) - 1)
    again = (key[1:] == key[:-1]) & (at[1:] - at[:-1] <= _REACH) & (ends[at[1:]] == ends[at[:-1]])
    at, before = at[1:][again], at[:-1][again]
    back = np.zeros(n, np.int64)
    back[at] = at - before
    differ = words[at] ^ words[before]
    # The lowest bit that differs tells how many of the eight bytes are alike; more are compared only where a match is taken.
    same = np.where(differ == 0, 8, (np.frexp((differ & -differ.astype(np.int64).view(np.uint64)).astype(np.float64))[1] - 1) >> 3)
    most = np.minimum(ends[at] - at, longest)
    onward = place + 1
    onward[at] = np.where((same == 8) & (most > 8), before - at, at + np.minimum(same, most))
    taken, step, next_, whole = [], 0, onward.tolist(), data.tobytes()
    while step < n:
        taken.append(step)
        if (to := next_[step]) < 0:
            off, to, stop = to, step + 8, min(step + longest, int(ends[step]))
            while to + 64 <= stop and whole[to + off : to + off + 64] == whole[to : to + 64]:
                to += 64
            while to < stop and whole[to + off] == whole[to]:
                to += 1
        step = to
    taken = np.array(taken, np.int64)
    return taken, np.where(back[taken] > 0, np.diff(taken, append=n) << _LZ_OFFSET_BITS | back[taken], data[taken])


def _ranked(values: np.ndarray, starts: list[int], powers: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value's place among starts (least value, extra bits), its extra bits and how many they are."""
    least = np.array(starts)
    symbol = np.searchsorted(least, values, "right") - 1
    return symbol, values - least[symbol], np.array([n for _, n in powers])[symbol]


def _coded(symbol: np.ndarray, text: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each symbol and its bits, where symbols follow each other within ascending texts and the code adapts."""
    n, first, full = symbols, symbols // 4, symbols * 12
    begin = np.flatnonzero(np.diff(text, prepend=-1))
    many = np.diff(np.append(begin, len(symbol)))
    rank = np.arange(len(symbol)) - np.repeat(begin, many)
    # A text's code is rebuilt as often as it has begun another wait; the last waits are the full ones.
    wait = np.where(rank < full, rank // first, _DUES - 1 + rank // full)
    dues = np.minimum((many - 1) // first, _DUES)
    base = np.cumsum(dues) - dues
    owner = np.repeat(np.arange(len(begin)), many)
    counted = wait < dues[owner]
    columns = int(dues.sum())
    words = np.empty((columns + 1, n), np.int64)
    words[0] = [*_start(True)[symbols != _SYMBOLS].table]
    counts = np.bincount((base[owner] + wait)[counted] * n + symbol[counted], minlength=columns * n).reshape(columns, n).astype(np.int32).cumsum(0, dtype=np.int32)
    before = np.vstack([np.zeros((1, n), np.int32), counts])[np.repeat(base, dues)]
    counts += 1 - before
    for k in range(0, columns, _COLUMNS):
        words[1 + k : 1 + k + _COLUMNS] = _many_words(_trees(counts[k : k + _COLUMNS].T)).T
    # Column 0 is the first code, then each text has its own in order.
    code = words[np.where(wait > 0, base[owner] + np.minimum(wait, _DUES), 0), symbol]
    for k in np.flatnonzero(many > full + full).tolist():
        one, own = AdaptiveCode(n), slice(begin[k], begin[k] + many[k])
        one.counts = ((counts[base[k] + _DUES - 1] >> 1) + 1).tolist()
        one.settled, one.halve = True, True
        for at in range(2 * full, int(many[k]), full):
            one.counts = (np.array(one.counts) + np.bincount(symbol[own][at - full : at], minlength=n)).tolist()
            rebuild([one], True)
            part = slice(begin[k] + at, min(begin[k] + at + full, begin[k] + many[k]))
            code[part] = np.array(one.table)[symbol[part]]
    size = np.frexp(code.astype(np.float64))[1].astype(np.int64) - 1
    return code - (1 << size), size


#: Bytes of texts that are encoded together.
_WRITTEN_BYTES = 1 << 19


def deflate_adaptive_many(datas: list[bytes], magic: bytes = b"JB01") -> list[bytes]:
    """deflate_adaptive of each: matches, counts and trees of all are found together."""
    sizes = np.array([len(d) for d in datas], np.int64)
    # Arrays take some two hundred times the bytes of texts, so they are of a few at once.
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // _WRITTEN_BYTES)) + 1).tolist(), len(datas)]
    if len(cuts) > 2:
        return [blob for a, b in itertools.pairwise(cuts) for blob in deflate_adaptive_many(datas[a:b], magic)]
    heads = [magic + len(d).to_bytes(4, "big") for d in datas]
    if not sizes.sum():
        return heads
    ends = np.cumsum(sizes)
    place, values = _found(np.frombuffer(b"".join(datas), np.uint8), np.repeat(ends, sizes), 258)
    text = np.repeat(np.arange(len(datas)), sizes)[place]
    match = np.flatnonzero(values >= 256)
    symbol, more, wide = values.copy(), np.zeros_like(values), np.zeros_like(values)
    rank, more[match], wide[match] = _ranked((values[match] >> _LZ_OFFSET_BITS) - _SHORTEST, [v for v, _ in _LENGTH_VALUES], _LENGTH_VALUES)
    symbol[match] = _FIRST_LENGTH + rank
    code, size = _coded(symbol, text, _SYMBOLS)
    # A token's code, length and offset have 52 bits at most.
    code, size = code << wide | more, size + wide
    if match.size:
        rank, more, wide = _ranked(values[match] & _REACH, [v for v, _ in _OFFSET_VALUES], _OFFSET_VALUES)
        far, far_size = _coded(rank, text[match], _OFFSETS)
        code[match] = (code[match] << far_size | far) << wide | more
        size[match] += far_size + wide
    cuts = np.searchsorted(text, np.arange(len(datas) + 1)).tolist()
    return [head + (_pack(code[a:b], size[a:b]) if a < b else b"") for head, a, b in zip(heads, cuts, cuts[1:], strict=False)]


def deflate_adaptive(data: bytes, magic: bytes = b"JB01") -> bytes:
    """An adaptive-Huffman blob."""
    return deflate_adaptive_many([data], magic)[0]
