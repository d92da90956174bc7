"""Alignment of lines: shapes around slots, records of a shape, pages as templates."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: What stands in a slot: a variable of certain syntax, another variable, a default or blank, a filling; or a whole page.
CERTAIN, VARIABLE, DEFAULT, FILLED, PAGE = range(5)
BITS = 1 << 26  # bits of the map of asked shapes, 8 MiB; the fuller it is, the more lines are brought to the exact join in vain
WIDEST = 3  # tokens of a filling
SIGNS = tuple(b",.!:;()")  # signs that count as tokens; others are blanks
TO_TOKENS = bytes(c if chr(c).isalnum() and c < 128 or c > 127 or c in SIGNS else 32 for c in bytes(range(256)).lower())
BOUND, SLOT = 1, 2  # numbers of the place beyond a line's ends and of a slot
MIX = [np.int64(x) for x in (-7046029254386353131, -4417276706812531889, 1609587929392839161, -8663945395140668459, 2870177450012600261)]
DEFAULTS = re.compile(r"(?:undefined|null|NaN|None|N/A|John Doe|Jane Doe|)$")


def tokens(line: bytes) -> list[bytes]:
    line = line.translate(TO_TOKENS)
    for sign in SIGNS:
        if sign in line:
            line = line.replace(b"%c" % sign, b" %c " % sign)
    return line.split()


def number(text: str | bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def shapes(t: np.ndarray, first: np.ndarray, after: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys of the slots from `first` to before `after`: (all tokens before counted, the last two of them, one behind)
    and (one before, the first two behind, all behind counted), so that the other side may be of any length.

    `t` has two BOUND tokens around each line; `left` and `right` are the numbers of tokens on either side.
    """
    with np.errstate(over="ignore"):
        near = t[first - 1] * MIX[0] + t[after] * MIX[1]
        a = near + t[first - 2] * MIX[2] + left * MIX[3]
        b = near - t[after + 1] * MIX[2] + right * MIX[4] + 1
        return tuple((k ^ (k >> np.int64(29))) * MIX[1] ^ (k >> np.int64(47)) for k in (a, b))


def line_slots(line: str, found: list[tuple[int, int, bool]]) -> list[tuple]:
    """(key, value, state, record, tokens) twice for each of the places (start, end, certain) of a line that hold residue."""
    t, slots, at = [BOUND, BOUND], [], 0
    for start, end, certain in found:
        if start < at:
            continue
        t += [number(x) for x in tokens(line[at:start].encode("utf-8", "replace"))]
        value = line[start:end]
        if not certain and (blank := re.match(r"(\w+(?: \w+)?)[ \t]+$", value)):
            t += [number(x) for x in tokens(blank[1].encode("utf-8", "replace"))]  # a greeting without its name
            value = ""
        slots.append((len(t), value, CERTAIN if certain else DEFAULT if DEFAULTS.match(value) else VARIABLE))
        t.append(SLOT)
        at = end
    t += [*(number(x) for x in tokens(line[at:].encode("utf-8", "replace"))), BOUND, BOUND]
    own, record, out = np.array(t, np.int64), number(line), []
    for i, value, state in slots:
        rest = own[2:i].tolist() + own[i + 1 : -2].tolist()
        for k in shapes(own, np.array([i]), np.array([i + 1]), np.array([i - 2]), np.array([len(t) - i - 3])):
            out.append((int(k[0]), number(value), state, record, rest))
    return out


def aligned_records(lines: list[bytes], bits: np.ndarray) -> list[tuple]:
    """(key, value, state, record, tokens) of fillings of one to WIDEST tokens whose shape may be among the asked ones."""
    numbers: dict[bytes, int] = {}
    t: list[int] = []
    bounds = [0]
    words: list[list[bytes]] = []
    for line in lines:
        own = tokens(line)
        words.append(own)
        t += (BOUND, BOUND)
        for x in own:
            n = numbers.get(x)
            if n is None:
                n = numbers[x] = number(x)
            t.append(n)
        t += (BOUND, BOUND)
        bounds.append(len(t))
    if not t:
        return []
    all_, starts = np.array(t, np.int64), np.array(bounds[:-1])
    sizes = np.diff(bounds) - 4
    of = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # of a token within its line
    out = []
    for width in range(1, WIDEST + 1):
        fits = np.flatnonzero(place + width <= sizes[of])
        line, left = of[fits], place[fits]
        first = starts[line] + 2 + left
        right = sizes[line] - left - width
        for k in shapes(all_, first, first + width, left, right):
            bit = k % BITS
            for j in np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).tolist():
                i, at = int(line[j]), int(left[j])
                own = all_[starts[i] + 2 : starts[i] + 2 + sizes[i]]
                out.append((int(k[j]), number(b" ".join(words[i][at : at + width])), FILLED, number(lines[i]), own[:at].tolist() + own[at + width :].tolist()))
    return out


# Words of which an error page's first line has one.
ERROR_WORDS = frozenset("error errors fehler hata erreur failed failure fehlgeschlagen başarısız denied verweigert forbidden unavailable unreachable timeout timed expired maintenance wartung bakım mantenimiento found blocked suspended offline again retry".encode().split())


def sentence(line: bytes) -> bool:
    line = line.rstrip()
    return line[-1:] in (b".", b"!", b"?") and len(line.split()) >= 6


def page_of(lines: list[bytes]) -> tuple | None:
    """(key, value, PAGE, record, tokens) of a page that speaks of an error and of nothing else; the key leaves out numbers and ids."""
    if not lines or ERROR_WORDS.isdisjoint(tokens(lines[0])) or any(sentence(x) and ERROR_WORDS.isdisjoint(tokens(x)) for x in lines):
        return None
    text = b"\n".join(lines)
    return number(re.sub(rb"\b\w*\d\w*\b", b"0", text.lower())), None, PAGE, number(text), None
