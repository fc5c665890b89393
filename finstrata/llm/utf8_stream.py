"""Incremental UTF-8: a state machine over bytes, and the same machine over tokens for streaming decoders."""

from __future__ import annotations

import numpy as np

ACCEPT, REJECT = 0, 1


def _machine() -> np.ndarray:
    """next[state, byte]. A state says which bytes may follow: one, two or three continuation bytes, the first of them from a narrower range
    after E0, ED, F0 and F4 (no overlong forms, no surrogates, nothing beyond U+10FFFF)."""
    one, two, three, after_e0, after_ed, after_f0, after_f4 = range(2, 9)
    table = np.full((9, 256), REJECT, np.uint8)
    table[ACCEPT, :0x80] = ACCEPT
    table[ACCEPT, 0xC2:0xE0] = one
    table[ACCEPT, 0xE0:0xF0] = two
    table[ACCEPT, [0xE0, 0xED]] = [after_e0, after_ed]
    table[ACCEPT, 0xF0:0xF5] = three
    table[ACCEPT, [0xF0, 0xF4]] = [after_f0, after_f4]
    for state, low, high, then in (
        (one, 0x80, 0xC0, ACCEPT), (two, 0x80, 0xC0, one), (three, 0x80, 0xC0, two), (after_e0, 0xA0, 0xC0, one),
        (after_ed, 0x80, 0xA0, one), (after_f0, 0x90, 0xC0, two), (after_f4, 0x80, 0x90, two),
    ):
        table[state, low:high] = then
    return table


MACHINE = _machine()


def run(state: int, data: bytes) -> int:
    for byte in data:
        state = MACHINE[state, byte]
    return int(state)


class TokenMachine:
    """next[state, token]: where a token's bytes lead from each state."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens, default=-1) + 1
        self.bytes: list[bytes | None] = [tokens.get(i) for i in range(size)]
        width = max(map(len, tokens.values()), default=0)
        lengths = np.array([len(t) if t is not None else -1 for t in self.bytes])
        padded = np.frombuffer(b"".join((t or b"").ljust(width, b"\0") for t in self.bytes), np.uint8).reshape(size, width)
        self.next = np.repeat(np.arange(len(MACHINE), dtype=np.uint8)[:, None], size, axis=1)
        for at in range(width):
            live = lengths > at
            self.next[:, live] = MACHINE[self.next[:, live], padded[live, at]]
        self.whole = self.next[ACCEPT] == ACCEPT  # starts and ends between characters

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """All bytes of the ids, and whether they are well-formed UTF-8."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())), self.follow(ids) == ACCEPT

    def follow(self, ids: np.ndarray, state: int = ACCEPT) -> int:
        """The state after the ids. Tokens that are whole characters are passed over at once; only those between them are stepped through."""
        if state == ACCEPT:
            ids = ids[~self.whole[ids]] if self._balanced(ids) else ids
        for i in ids.tolist():
            state = self.next[state, i]
            if state == REJECT:
                return REJECT
        return int(state)

    def _balanced(self, ids: np.ndarray) -> bool:
        """Whether every whole token of the ids is met between characters, so that leaving it out changes nothing."""
        broken = np.flatnonzero(~self.whole[ids])
        if not len(broken):
            return True
        state = ACCEPT
        for at, i in zip(broken.tolist(), ids[broken].tolist()):
            if state != ACCEPT and self.whole[ids[at - 1]]:
                return False
            state = self.next[state, i]
            if state == REJECT:
                return False
        return bool(state == ACCEPT or broken[-1] == len(ids) - 1)


class Stream:
    """Tokens in, whole characters out: bytes of a character that has not ended yet are held back, at most three of them."""

    def __init__(self, machine: TokenMachine):
        self.machine, self.state, self.held = machine, ACCEPT, b""

    def push(self, token: int) -> str:
        data = self.machine.bytes[token]
        self.state = int(self.machine.next[self.state, token])
        data, self.held = self.held + data, b""
        if self.state == REJECT:
            raise ValueError(f"token {token} breaks a character")
        if self.state != ACCEPT:  # the open character starts at the last byte that is not a continuation
            at = len(data) - 1
            while data[at] & 0xC0 == 0x80:
                at -= 1
            data, self.held = data[:at], data[at:]
        return data.decode()

    def close(self) -> None:
        if self.held:
            raise ValueError("the stream ends within a character")
