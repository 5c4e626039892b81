"""The two XOR keystreams. Both are symmetric, so encoding a fixture and decoding it is one function."""

from __future__ import annotations

import numpy as np

MT, LAME = "Ea05Mt", "Ea06Lame"

#: Fixed values of the lagged generator: words of state, start of the second lag, factor of the seeding chain, warm-up steps.
_WORDS, _LAG, _FACTOR, _WARM = 17, 10, 0x53A9B4FB, 9
_M = 0xFFFFFFFF

#: Streams made so far by (cipher, seed), and for the lagged one the state to go on from.
_made: dict[tuple[str, int], bytes] = {}
_state: dict[int, list[int]] = {}
_MOST_STREAMS = 512


def _mt(seed: int, n: int) -> bytes:
    """Bits 1 to 8 of each word of the standard Mersenne Twister."""
    words = np.random.RandomState(seed & _M).randint(0, 1 << 32, size=n, dtype=np.uint32)
    return ((words >> np.uint32(1)) & np.uint32(0xFF)).astype(np.uint8).tobytes()


def _lame(seed: int, n: int) -> bytes:
    """The top byte of every second word of r[i] = rotl(r[i-17], 9) + rotl(r[i-10], 13), after the warm-up."""
    done = _made.get((LAME, seed), b"")
    if seed not in _state:
        word, chain = seed & _M, []
        for _ in range(_WORDS):
            word = (1 - word * _FACTOR) & _M
            chain.append(word)
        # The generator walks its words downwards from the first, so in time order they are reversed.
        r = [chain[0], *chain[:0:-1]]
        for _ in range(_WARM):
            _step(r)
        _state[seed] = r[-_WORDS:]
    r = _state[seed]
    need = 2 * (n - len(done))
    if need > 0:
        out = bytearray(done)
        for i in range(need):
            a, b = r[-_WORDS], r[-_LAG]
            v = (((a << 9 | a >> 23) & _M) + ((b << 13 | b >> 19) & _M)) & _M
            r.append(v)
            if i & 1:
                out.append(v >> 24)
            if len(r) > 65536:
                del r[: -_WORDS]
        del r[: -_WORDS]
        done = bytes(out)
    return done


def _step(r: list[int]) -> None:
    a, b = r[-_WORDS], r[-_LAG]
    r.append((((a << 9 | a >> 23) & _M) + ((b << 13 | b >> 19) & _M)) & _M)


def keystream(cipher: str, seed: int, n: int) -> bytes:
    """The first n bytes; what was made stays for the next call with the same seed."""
    seed &= _M
    have = _made.get((cipher, seed), b"")
    if len(have) < n:
        if len(_made) >= _MOST_STREAMS:
            _made.clear()
            _state.clear()
        have = (_lame if cipher == LAME else _mt)(seed, max(n, 2 * len(have), 64))
        _made[cipher, seed] = have
    return have[:n]


def crypt(cipher: str, data: bytes, seed: int) -> bytes:
    if not data:
        return b""
    return (np.frombuffer(data, np.uint8) ^ np.frombuffer(keystream(cipher, seed, len(data)), np.uint8)).tobytes()
