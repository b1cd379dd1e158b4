"""The least edits that give a conversation the roles (s?(ua)+)?, by cost layers.

For every turn one integer says which states of the grammar can still be finished, and at what cost: it holds
LAYERS layers of four bits, the layer of cost c having the states from which c more (above the turn's least cost, which is
kept beside it) are enough.  An edit of cost w moves all layers by w in one shift, so a turn is a handful of bit operations for all
costs at once, and the same (word, turn) pairs recur, so they are worked out once a task.  From any state any other's way
can be joined for 12 at most, so LAYERS never lose a state.  The first layer that has the start state is the cost.  The
audit follows the bits forward and takes the ASCII-least edit that stays on it; an edit decides the next state, so this gives
the least string.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

LAYERS = 32
#: Costs of edits.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The states from which a role leads to its state.
BEFORE = {SYSTEM: 1 << START, USER: 1 << START | 1 << SYSTEM | 1 << ASSISTANT, ASSISTANT: 1 << USER}
FINAL = 1 << START | 1 << ASSISTANT
SPACE = " \t\n\x0b\x0c\r"
FINE, CUT, OUT = range(3)  # a fault: none, truncated, one that has to go

_ONES = sum(1 << 4 * layer for layer in range(LAYERS))
_FULL = (1 << 4 * LAYERS) - 1
_ROLES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_INSERTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_FAR = 1 << 60


def code_of(role: str, fault: int) -> int:
    """All that the edits of a turn depend on: the state its role leads to (0: none) and its fault."""
    return 4 * fault + _ROLES.get(role[:1], 0)


def _onto(word: int, state: int) -> int:
    """For every layer with `state`, the states before it."""
    return ((word >> state) & _ONES) * BEFORE[state]


def _inserted(word: int) -> int:
    for _ in range(2):
        word |= (_onto(word, USER) | _onto(word, ASSISTANT)) << 4 * INSERT & _FULL
    return word


def _lowest(word: int) -> tuple[int, int]:
    """The word from its first layer that has a state, and how many layers were before it."""
    at = ((word & -word).bit_length() - 1) // 4
    top = word >> 4 * (LAYERS - 1)
    return word >> 4 * at | sum(top << 4 * layer for layer in range(LAYERS - at, LAYERS)), at


def word_of(costs: Iterable[int | None]) -> tuple[int, int]:
    """The word of costs by state (None: no way), and the least of them."""
    costs = list(costs)
    least = min(c for c in costs if c is not None)
    word = 0
    for state, cost in enumerate(costs):
        if cost is not None and cost - least < LAYERS:
            word |= sum(1 << 4 * layer + state for layer in range(cost - least, LAYERS))
    return word, least


def layer_of(word: int, state: int) -> int | None:
    """The first layer that has a state."""
    found = (word >> state) & _ONES
    return ((found & -found).bit_length() - 1) // 4 if found else None


ACCEPTED = word_of(layer_of(_inserted(_ONES * FINAL), state) for state in range(4))[0]


@lru_cache(maxsize=1 << 16)
def before(word: int, code: int) -> tuple[int, int]:
    """The word before a turn, from that after it, and by how much its least cost is greater."""
    fault, own = divmod(code, 4)
    out = word << 4 * DELETE
    if fault != OUT:
        more = TRUNCATED if fault == CUT else 0
        if own:
            out |= _onto(word, own) << 4 * more
        out |= (_onto(word, USER) | _onto(word, ASSISTANT)) << 4 * (more + REROLE)
    return _lowest(_inserted(out & _FULL))


@lru_cache(maxsize=1 << 16)
def edits(word: int, code: int, state: int) -> tuple[str, int]:
    """The ASCII-least edits up to and with a turn from a state before it, given the word after it, and the state
    that they lead to."""
    here, gained = before(word, code)
    fault, own = divmod(code, 4)
    more = TRUNCATED if fault == CUT else 0
    left, done = layer_of(here, state) + gained, ""
    on = lambda cost, to: cost <= left and left - cost < LAYERS and word >> 4 * (left - cost) + to & 1
    while True:
        # left is the exact cost from here, so a state in layer left - cost is one that the edit leads to for `left` in all
        if on(DELETE, state):
            return done + "D", state
        to = _INSERTED[state]
        if layer_of(here, to) is not None and layer_of(here, to) + gained + INSERT == left:
            done, state, left = done + "I", to, left - INSERT
            continue
        if fault != OUT and own and BEFORE[own] >> state & 1 and on(more, own):
            return done + "K", own
        return done + "R", to


def words_after(codes: bytes, end: int = ACCEPTED) -> tuple[list[int], int]:
    """The word after every turn, with that before the first one in front, and the least cost there."""
    words, total, word = [end], 0, end
    for code in reversed(codes):
        word, gained = before(word, code)
        total += gained
        words.append(word)
    words.reverse()
    return words, total


def audit_of(codes: bytes, words: list[int], state: int, last: bool = True) -> tuple[list[str], int]:
    """The edits of every turn, and of what follows the last one; and the state after them."""
    out = []
    for i, code in enumerate(codes):
        done, state = edits(words[i + 1], code, state)
        out.append(done)
    if last:
        out.append({SYSTEM: "II", USER: "I"}.get(state, ""))
        state = ASSISTANT if out[-1] else state
    return out, state


def matrix(codes: bytes) -> list[int | None]:
    """The least cost of a run of turns from each state (rows) to each state (columns) at its end."""
    out: list[int | None] = [None] * 16
    for to in range(4):
        words, total = words_after(codes, _ONES << to)
        for state in range(4):
            layer = layer_of(words[0], state)
            out[4 * state + to] = None if layer is None else layer + total
    return out


def joined(costs: list[int | None], after: list[int | None]) -> list[int | None]:
    """Costs by state before a run, from its matrix and the costs after it."""
    found = [min((m + a for m, a in zip(costs[4 * s : 4 * s + 4], after) if m is not None and a is not None), default=_FAR) for s in range(4)]
    return [None if c == _FAR else c for c in found]


def faults_of(roles: list[str], texts: list[str], known: set | None = None) -> list[str]:
    """blank, duplicate, truncated or nothing for every turn."""
    seen = set() if known is None else known
    out = []
    for role, text in zip(roles, texts):
        shown = text.rstrip(SPACE)
        if not shown:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


CODE = {"": FINE, "truncated": CUT, "blank": OUT, "duplicate": OUT}


def turns_of(done: list[str], roles: list[str], texts: list[str], state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of what the edits leave, and the state after it."""
    out = []
    for i, own in enumerate(done):
        for edit in own:
            if edit == "D":
                continue
            if edit == "K":
                state = _ROLES[roles[i][:1]]
                out.append((edit, roles[i], texts[i]))
                continue
            state = _INSERTED[state]
            out.append((edit, ROLE[state], texts[i] if edit == "R" else ""))
    return out, state


def illegal_pairs(initials: Iterable[str]) -> int:
    initials = list(initials)
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def gaps_of(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0
